"""JSON objects inside other text, whole ones and ones that were cut: one pass with a stack."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"""[\x20\t\n\r]+|(?P<mark>[{}\[\]:,])|(?P<string>"(?:[^"\\]|\\.)*")|(?P<value>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9A-Za-z.+-])|(?:true|false|null)(?![0-9A-Za-z_]))|(?P<cut>"(?:[^"\\]|\\.)*\\?\Z)|(?P<other>[^\x20\t\n\r{}\[\]:,"]+)""", re.S)
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')

#: What has been read of an object or array: nothing, a key, its colon, a value, a comma.
START, KEY, COLON, VALUE, COMMA = range(5)


@dataclass
class Frame:
    open: int
    close: str
    state: int = START
    #: Where the last whole member ends, or the bracket does.
    whole: int = 0
    #: Not JSON; then what encloses it isn't either.
    bad: bool = False

    def value(self, end: int) -> None:
        """A value was read."""
        if self.state == COLON or self.close == "]" and self.state in (START, COMMA):
            self.state, self.whole = VALUE, end
        else:
            self.bad = True

    def text(self, end: int) -> None:
        """A string was read: a key or a value."""
        if self.close == "}" and self.state in (START, COMMA):
            self.state = KEY
        else:
            self.value(end)


def read(text: str, repair: bool = False) -> str | None:
    """The first whole JSON object inside a text. With ``repair`` one that the text's end cuts, and that begins before, comes closed after its last whole member.

    Quotes begin strings within braces only. A number at the end of a text may be cut and isn't a whole member. Of nested
    objects the outer one counts, unless it isn't JSON. Every character is read once.
    """
    stack: list[Frame] = []
    found: tuple[int, int] | None = None
    at, n = text.find("{"), len(text)
    while 0 <= at < n:
        if not stack:
            if found:
                break
            at = text.find("{", at)
            if at < 0:
                break
        m = _TOKEN.match(text, at)
        end, kind, top = m.end(), m.lastgroup, stack[-1] if stack else None
        if kind == "mark":
            mark = m[0]
            if mark in "{[":
                if top and not (top.state == COLON or top.close == "]" and top.state in (START, COMMA)):
                    top.bad = True
                stack.append(Frame(at, "}" if mark == "{" else "]", whole=end))
            elif mark in "}]":
                if top.close != mark:
                    if mark == "]":
                        top.bad = True  # a stray bracket
                    else:
                        while stack and stack[-1].close == "]":
                            stack.pop()  # arrays left open within an object make it bad
                        stack[-1].bad = True
                        stack.pop()
                        if stack:
                            stack[-1].bad = True
                else:
                    good = not top.bad and top.state in (START, VALUE)
                    stack.pop()
                    if good and mark == "}" and (found is None or top.open < found[0]):
                        found = (top.open, end)
                    if stack:
                        if good:
                            stack[-1].value(end)
                        else:
                            stack[-1].bad = True
            elif mark == ":":
                if top.state == KEY and top.close == "}":
                    top.state = COLON
                else:
                    top.bad = True
            elif top.state == VALUE:
                top.state = COMMA
            else:
                top.bad = True
        elif kind == "string":
            if _STRING.fullmatch(m[0]):
                top.text(end)
            else:
                top.bad = True
        elif kind == "value":
            if end == n and m[0][-1].isdigit():
                break  # perhaps cut
            top.value(end)
        elif kind == "other" and end < n:
            top.bad = True
        at = end
    while stack and (any(f.bad for f in stack) or stack[0].close != "}"):
        bad = max((i for i, f in enumerate(stack) if f.bad), default=0)
        stack = stack[bad + 1 :]
    if found and not (repair and stack and stack[0].open < found[0]):
        return text[found[0] : found[1]]
    if not repair or not stack:
        return None
    # the innermost one open may lack a value for its key; what is whole of it ends where its last member does
    return text[stack[0].open : stack[-1].whole] + "".join(f.close for f in reversed(stack))
