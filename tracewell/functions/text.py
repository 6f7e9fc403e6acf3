"""Prompt cleaning, previews, formats: built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How messages begin that no person wrote.
SYSTEM_PREFIXES = (
    "[Request interrupted by user",
    "<command-name>",
    "<command-message>",
    "<local-command-caveat>",
    "<local-command-stdout>",
    "<task-notification>",
    "<bash-input>",
    "<bash-stdout>",
)
#: Lines of a pasted terminal session, matched on the trimmed line.
TERMINAL_LINES = (
    r"^(?i)last login:",
    r"^[➜❯]\s+",
    r"^(?i)github(?:\.com|\.rbx\.com)?$",
    r"^[✓✔]",
    r"^(?i)-\s+(?:active account|git operations protocol|token|token scopes):",
    r"^(?i)(?:credential|init|user|filter|alias|core|remote|branch)\.[^=]+=",
    r"^(?i)branch\.[^.]+\.",
)
SUMMARY = r"^(?i)(?:\[previous conversation summary\]:|summary:\s*1\.\s*primary request and intent:|and merge infrastructure was built for human-paced output)"
TERMINAL_NOISE = r"(?i)last login:|gh auth status|github\.com|credential\.helper=|branch\."


def is_system_generated(text: Column) -> Column:
    """Messages that the tool wrote in the user's name."""
    out = F.lit(False)
    for p in SYSTEM_PREFIXES:
        out = out | text.startswith(p)
    return out


#: What ``\s`` stands for in a pattern.
BLANKS = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _replaced(text: Column, mark: str, pattern: str) -> Column:
    """``text`` without what matches; texts that lack ``mark``, which every match holds, aren't searched."""
    return once(text, lambda v: F.when(v.contains(mark), F.regexp_replace(v, pattern, "")).otherwise(v))


def clean_prompt(text: Column) -> Column:
    """What a person asked, without pasted noise and tags, on one line; empty if nothing is left."""
    noise = "|".join(f"(?:{p})" for p in TERMINAL_LINES)
    behind = lambda x: F.slice(x, 2, F.greatest(F.size(x), F.lit(1)))

    def wanted(lines: Column) -> Column:
        greeting = lambda x: strip(F.coalesce(F.try_element_at(x, F.lit(1)), F.lit(""))).rlike(r"^(?i)(?:hello|hi)\b")
        said = once(behind(lines), lambda x: F.when(greeting(x), behind(x)).otherwise(x))
        own = F.when(F.element_at(lines, 1).rlike(r"^(?i)\S.*\[\d{1,2}:\d{2}\s?[ap]m\]$"), said).otherwise(lines)
        return strip(F.array_join(F.filter(own, lambda x: ~strip(x).rlike(noise)), "\n"))

    def bare(out: Column) -> Column:
        out = _replaced(out, "<", r"(?i)</?[a-z][^>]*>")
        out = _replaced(out, "|", r"(?m)^\s*\d+\|\s*")
        out = _replaced(out, "Caveat:", r"Caveat:\s*The messages below were generated by the user while running local commands\.[^.]*")
        out = _replaced(out, "DO NOT", r"DO NOT respond to these messages[^.]*")
        out = _replaced(out, "/", r"^/\w+\s*")
        return strip(F.regexp_replace(out, r" \s+|[^\S ]\s*", " "))  # single blanks stay

    def cleaned(whole: Column, kept: Column, out: Column) -> Column:
        attached = kept.contains("<") & kept.rlike(r"(?i)<attached_files>|<code_selection\b")
        short = out.rlike(r"^(?i)[a-z0-9._:-]{1,12}$") & whole.rlike(TERMINAL_NOISE)
        return F.when(attached | whole.rlike(SUMMARY) | out.rlike(SUMMARY) | short, "").otherwise(out)

    of = lambda whole: once(once(F.split(whole, "\n"), wanted), lambda kept: once(bare(kept), lambda out: cleaned(whole, kept, out)))
    return once(strip(F.coalesce(text, F.lit(""))), of)


def normal_title(text: Column) -> Column:
    """Whitespace collapsed, empty as null."""
    return F.nullif(strip(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def classify_injection(content: Column) -> Column:
    """What an injected message is about."""
    skill = F.element_at(F.split(strip(F.regexp_replace(F.substring_index(content, "\n", 1), "^Base directory for this skill: ?", "")), "/"), -1)
    ran = F.regexp_extract(content, r"^The user just ran /([^\s/]*)", 1)
    usage = F.regexp_extract(content, r"^Usage: /(\S*)", 1)
    unknown = F.lit("unknown")
    return (
        F.when(content.startswith("Base directory for this skill:"), F.concat(F.lit("skill:"), F.coalesce(F.nullif(skill, F.lit("")), unknown)))
        .when(content.startswith("The user just ran /"), F.concat(F.lit("command:/"), F.coalesce(F.nullif(ran, F.lit("")), unknown)))
        .when(content.startswith("Usage: /"), F.concat(F.lit("command:/"), F.coalesce(F.nullif(usage, F.lit("")), unknown)))
        .when(content.startswith("[Image:"), "image")
        .when(content.startswith("<local-command-caveat>"), "local-command")
        .otherwise("system")
    )


def mcp_server(tool: Column) -> Column:
    """The server of a tool named mcp__server__tool, else null."""
    return F.when(tool.startswith("mcp__"), F.nullif(F.get(F.split(tool, "__"), F.lit(1)), F.lit("")))


def tool_short_name(tool: Column) -> Column:
    """Last part of a composite tool name."""
    return F.when(tool.startswith("mcp__"), F.element_at(F.split(tool, "__"), -1)).otherwise(tool)


def classify_command(command: Column) -> Column:
    """What a shell command does."""
    return (
        F.when(command.rlike(r"(?i)\b(?:test|jest|vitest|pytest|cargo\s+test|mocha|spec)\b"), "test")
        .when(command.rlike(r"(?i)\b(?:build|compile|tsc|webpack|vite\s+build|rollup)\b"), "build")
        .when(command.rlike(r"(?i)^\s*git "), "git")
        .when(command.rlike(r"(?i)\b(?:lint|biome|eslint|prettier|format)\b"), "lint")
        .otherwise("other")
    )


def first_word(command: Column) -> Column:
    return F.element_at(F.split(strip(command), r"[\s|;&]"), 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def last_two(path: Column) -> Column:
    """Last two segments of a path."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def tool_path(input_json: Column) -> Column:
    """The file that a tool call names, under any of its four keys."""
    return F.coalesce(*(F.nullif(F.get_json_object(input_json, f"$.{k}"), F.lit("")) for k in ("file_path", "filePath", "path", "notebook_path")))


def format_duration(ms: Column) -> Column:
    """1h 2m, 3m 4s or 5s (P50)."""
    s = F.floor(ms / 1000)
    hour, minute, second = F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60))
    return F.when(hour > 0, F.format_string("%dh %dm", hour, minute)).when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), second)).otherwise(F.format_string("%ds", s))


def _age_minutes(at: Column, now: str) -> Column:
    return F.floor((F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.try_to_timestamp(at))) / 60_000)


def time_ago(at: Column, now: str) -> Column:
    """just now, 5m ago, 3h ago or 2d ago; from 30 days on the date itself (P50). ``at`` is ISO text; null where it is no time."""
    m = _age_minutes(at, now)
    h, d = F.floor(m / 60), F.floor(m / 1440)
    return (
        F.when(m < 1, "just now").when(m < 60, F.format_string("%dm ago", m)).when(h < 24, F.format_string("%dh ago", h)).when(d < 30, F.format_string("%dd ago", d))
        .when(m.isNotNull(), F.date_format(F.try_to_timestamp(at), "MMM d, yyyy, HH:mm"))
    )


def compact_age(at: Column, now: str) -> Column:
    """5m, 3h or 2d; 0m for what isn't a time in the past, empty for null (P50)."""
    m = _age_minutes(at, now)
    some = F.when(m < 60, F.format_string("%dm", m)).when(m < 1440, F.format_string("%dh", F.floor(m / 60))).otherwise(F.format_string("%dd", F.floor(m / 1440)))
    return F.when(F.coalesce(at, F.lit("")) == "", "").when(m.isNull() | (m < 0), "0m").otherwise(some)


def compact_duration(ms: Column) -> Column:
    """5m, 1h 20m or 2d 3h (P50)."""
    m = F.floor(ms / 60_000)
    h, d = F.floor(m / 60), F.floor(m / 1440)
    two = lambda big, small, a, b: F.when(small > 0, F.format_string(f"%d{a} %d{b}", big, small)).otherwise(F.format_string(f"%d{a}", big))
    return F.when(m < 60, F.format_string("%dm", m)).when(h < 24, two(h, F.pmod(m, F.lit(60)), "h", "m")).otherwise(two(d, F.pmod(h, F.lit(24)), "d", "h"))


#: Names of models with the family after the version, and before it.
_MODEL_OLD = r"(?i)claude-(\d+)-(\d+)-(opus|sonnet|haiku)(?:-\d{8})?"
_MODEL_NEW = r"(?i)claude-(?:(opus|sonnet|haiku)-)?(\d+(?:[.-](?!\d{8})\d+)*)(?:-\d{8})?(?:-(opus|sonnet|haiku))?(?:$|\b)"


def short_model(model: Column) -> Column:
    """A model's family and version, else the first two parts of its name; empty for null (P50)."""
    family = F.coalesce(F.nullif(F.regexp_extract(model, _MODEL_NEW, 1), F.lit("")), F.regexp_extract(model, _MODEL_NEW, 3))
    version = F.replace(F.regexp_extract(model, _MODEL_NEW, 2), F.lit("-"), F.lit("."))
    old = F.concat(F.initcap(F.regexp_extract(model, _MODEL_OLD, 3)), F.lit(" "), F.regexp_extract(model, _MODEL_OLD, 1), F.lit("."), F.regexp_extract(model, _MODEL_OLD, 2))
    new = F.concat(F.when(family == "", "Claude").otherwise(F.initcap(family)), F.lit(" "), version)
    return F.when(F.coalesce(model, F.lit("")) == "", "").when(model.rlike(_MODEL_OLD), old).when(model.rlike(_MODEL_NEW), new).otherwise(F.array_join(F.slice(F.split(model, "[-/]"), 1, 2), "-"))


#: Projects that are no folders of a person's.
_PROJECTS = (("(globalStorage)", "Cursor Global Storage"), ("~", "Home"))


def project_label(project: Column, most: int = 26) -> Column:
    """A project's path in at most ``most`` characters where its first and last parts allow it."""
    bare = F.regexp_replace(project, "/$", "")
    parts = F.split(project, "/")
    n = F.size(parts)
    short = lambda k: F.concat(F.element_at(parts, 1), F.lit("/…/"), F.array_join(F.slice(parts, -k, k), "/"))
    out = F.when(bare == _PROJECTS[0][0], _PROJECTS[0][1]).when(bare == _PROJECTS[1][0], _PROJECTS[1][1]).when(bare.rlike(r"/\.cursor/projects/.+/terminals$"), "Cursor Terminals").when(bare.rlike(r"/\.cursor/extensions/"), "Cursor Extension")
    return out.when((F.length(project) <= most) | (n <= 2), project).when(F.length(short(2)) <= most, short(2)).otherwise(short(1))


def format_cost(dollars: Column) -> Column:
    return F.when(dollars < 0.01, "<$0.01").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", dollars)))


def format_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1_000, F.format_string("%.1fK", n / 1_000)).otherwise(n.cast("string"))


def format_size(n: Column) -> Column:
    return F.when(n >= 1 << 20, F.format_string("%.1f MB", n / float(1 << 20))).when(n >= 1 << 10, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def escape_html(text: Column) -> Column:
    """(K3)"""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Characters that a drawing has no glyph for.
NO_GLYPH = "[\U0001f600-\U0001f9ff\U0001fa00-\U0001faff\u2600-\u27bf\u2b50\u2b55\U0001f1e0-\U0001f1ff\ue000-\uf8ff\U000f0000-\U000ffffd\ufe0f\u200d\u20e3\U000e0020-\U000e007f]"


def strip_emoji(text: Column) -> Column:
    """Without emoji and private characters, white space runs as one blank."""
    return F.regexp_replace(F.regexp_replace(text, NO_GLYPH, ""), r"\s+", " ")


def escape_xml(text: Column) -> Column:
    """(P48)"""
    text = strip_emoji(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_markdown(text: Column) -> Column:
    """A backslash before brackets, stars, underscores, backticks and backslashes."""
    return F.regexp_replace(text, r"([\[\]()*_`\\])", r"\\$1")


def safe_filename(text: Column) -> Column:
    """Letters, digits, - and _, all else as one -, at most 60 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9_-]", "-"), "-+", "-"), 1, 60)


def strip_markdown(text: Column) -> Column:
    """Plain words of a Markdown text."""
    for pattern, to in ((r"```[\s\S]*?```", ""), (r"`([^`]*)`", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^\s*[-*]\s+", "")):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\\u001b\\[[0-9;]*[A-Za-z]", "")


#: Ranges of characters that are two columns wide.
WIDE = ("\u3000-\u9fff", "\uac00-\ud7af", "\uf900-\ufaff", "\uff00-\uff60", "\U00020000-\U0002fa1f")


def one_line(text: Column) -> Column:
    """White space collapsed."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def visual_width(text: Column) -> Column:
    """Wide East Asian characters count twice."""
    return F.length(F.regexp_replace(text, f"[{''.join(WIDE)}]", "xx"))


def snippet(text: Column, query: str, before: int = 40, after: int = 60) -> Column:
    """What surrounds the first match of a search."""
    at = F.instr(F.lower(text), query.lower())
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, text.substr(start, F.lit(len(query) + after) + at - start))


def coerce_time(value: Column) -> Column:
    """ISO text, or epoch seconds or milliseconds, as a timestamp; null where it is neither."""
    number = value.try_cast("double")
    epoch = F.timestamp_millis(F.when(number > 1e10, number).otherwise(number * 1000).cast("bigint"))
    return F.when(number.isNotNull(), epoch).otherwise(F.try_to_timestamp(value))


def model_label(labels: Column) -> Column:
    """Last distinct name of a comma list."""
    parts = F.array_distinct(F.filter(F.transform(F.split(labels, ","), strip), lambda x: x != ""))
    return F.try_element_at(parts, F.lit(-1))
