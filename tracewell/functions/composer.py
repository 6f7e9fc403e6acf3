"""What the second provider's conversations tell besides their text: branches, links, context files, project roots, plans.

Built-in functions over JSON columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import model_label, once, strip
from tracewell.operators import windows

#: Headings of a model's notes to itself, alone or with more words behind them.
PLANNING = ("planning", "planning next steps", "internal", "internal only", "waiting", "exploring", "investigating", "checking", "thinking", "next steps", "working notes", "scratchpad")
PLANNING_MORE = ("waiting for", "exploring", "investigating", "checking", "thinking")
#: Words that such notes hold.
INTENT = ("I need", "I think", "I should", "I might", "I could", "I'm", "I am", "I'll", "I will", "let's", "we need to", "we should")
HEADING = r"\n{2,}\*\*([^*\n]{3,120})\*\*\n{2,}"
#: Labels of the stores that a session was read from.
SOURCE_LABELS = {"sqlite": "SQLite (store.db)", "global-state": "SQLite (global state.vscdb)", "jsonl": "JSONL transcript", "jsonl+tools": "JSONL + agent-tools"}
CONTEXT_FILES = 200


def _is_planning(heading: Column) -> Column:
    name = F.lower(strip(heading))
    return name.isin(*PLANNING) | name.rlike(f"^(?:{'|'.join(PLANNING_MORE)}) .+$")


def _is_intent(body: Column) -> Column:
    """Whether the first 500 characters behind leading blanks speak of intentions."""
    words = "|".join(w.replace(" ", r"\s+") for w in INTENT)
    return F.regexp_extract(body, r"^\s*([\s\S]{0,500})", 1).rlike(rf"(?i)\b(?:{words})\b")


def without_plan(text: Column) -> Column:
    """A text up to the first planning heading that is followed by a plan; empty if it begins with one.

    Headings are lines in bold between blank lines, found from left to right without overlap. Null stays null.
    """
    t = strip(text)
    heads, parts = F.regexp_extract_all(t, F.lit(HEADING), F.lit(0)), F.split(t, HEADING)

    def step(state: Column, pair: Column) -> Column:
        behind = state["at"] + F.length(pair["h"])
        plan = _is_planning(F.regexp_extract(pair["h"], HEADING, 1)) & _is_intent(F.substring(t, behind + 1, F.lit(1 << 30)))
        cut = F.when(state["cut"].isNotNull(), state["cut"]).when(plan, state["at"])
        return F.struct((behind + F.length(pair["p"])).alias("at"), cut.alias("cut"))

    start = F.struct(F.length(parts[0]).alias("at"), F.lit(None).cast("int").alias("cut"))
    pairs = F.arrays_zip(heads.alias("h"), F.slice(parts, 2, F.greatest(F.size(heads), F.lit(0))).alias("p"))
    cut = F.aggregate(pairs, start, step)["cut"]
    first = r"^\*\*([^*\n]{3,120})\*\*\n{2,}"
    leading = _is_planning(F.regexp_extract(t, first, 1)) & _is_intent(F.regexp_replace(t, first, ""))
    return F.when(cut.isNotNull(), strip(F.substring(t, F.lit(1), cut))).when(t.rlike(first) & leading, "").otherwise(t)


def assistant_text(text: Column, has_tools: Column) -> Column:
    """An assistant's text without its plan, where it called tools or shows a planning heading."""
    t = strip(text)
    shown = F.exists(F.regexp_extract_all(t, F.lit(HEADING), F.lit(1)), _is_planning)
    return F.when(has_tools | shown, without_plan(t)).otherwise(t)


def thinking(value: Column) -> Column:
    """Thoughts that are a text or an object with one, without plans; empty for anything else."""
    inner = F.when(F.ltrim(value).startswith("{") & F.try_parse_json(value).isNotNull(), F.coalesce(F.get_json_object(value, "$.text"), F.lit(""))).otherwise(value)
    return F.coalesce(without_plan(inner), F.lit(""))


def merged_model(primary: Column, other: Column) -> Column:
    """The label of the first of two models that has one."""
    return F.coalesce(F.nullif(model_label(primary), F.lit("")), F.nullif(model_label(other), F.lit("")))


def tokens_added(a: Column, b: Column) -> Column:
    """Two usages together; a null one, or a null count, adds nothing."""
    names = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    return F.struct(*((F.coalesce(a[n], F.lit(0)) + F.coalesce(b[n], F.lit(0))).alias(n) for n in names))


def added_once(items: Column, value: Column) -> Column:
    """An array with a value at its end unless it holds it; repeats within the array stay."""
    own = F.coalesce(items, F.array().cast("array<string>"))
    return F.when(F.array_contains(own, value), own).otherwise(F.array_append(own, value))


def source_label(source: Column) -> Column:
    """How a store is called; its own name if unknown."""
    known = F.create_map(*(F.lit(x) for pair in SOURCE_LABELS.items() for x in pair))
    return F.when(F.coalesce(source, F.lit("")) == "", "unknown").otherwise(F.coalesce(F.try_element_at(known, source), source))


def without_image_lines(text: Column) -> Column:
    """A text without lines that only stand for an image."""
    return strip(F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(r"(?i)^\s*\[image\]\s*$")), "\n"))


def without_images(text: Column) -> Column:
    """A text without its image blocks and the lines that stand for images."""
    return without_image_lines(F.regexp_replace(text, r"(?i)<image_files>[\s\S]*?</image_files>", ""))


def image_paths(text: Column, home: str) -> Column:
    """Distinct paths of image files listed in a text's image blocks, in order."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?i)<image_files>([\s\S]*?)</image_files>"), F.lit(1))
    listed = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?i)(?:^|\n)\s*(?:\d+\.\s*)?((?:~/|/)[^\n]+\.(?:png|jpe?g|gif|webp))"), F.lit(1))))
    return F.array_distinct(F.transform(listed, lambda p: F.when(p.startswith("~/"), F.concat(F.lit(home.rstrip("/") + "/"), F.substring(p, 3, 1 << 30))).otherwise(p)))


def workspace_hash(path: Column) -> Column:
    """The name of a workspace's folder among stores."""
    return F.md5(path)


def workspaces_hash(paths: Column) -> Column:
    """One short hash of several workspaces, whatever their order and repeats."""
    return F.substring(F.sha1(F.array_join(F.array_sort(F.array_distinct(F.filter(paths, lambda p: p != ""))), "\n")), 1, 16)


def encoded_dir(path: Column, home: str) -> Column:
    """The folder name that stands for a project's path."""
    full = F.when(path == "~", F.lit(home)).when(path.startswith("~/"), F.concat(F.lit(home.rstrip("/") + "/"), F.substring(path, 3, 1 << 30))).otherwise(path)
    return F.replace(full, F.lit("/"), F.lit("-"))


def decoded_dir(name: Column) -> Column:
    """The path that a folder name may stand for: hyphens within names come out as slashes, so :func:`known_dirs` goes first."""
    return F.when(name.startswith("-"), F.concat(F.lit("/"), F.replace(F.substring(name, 2, 1 << 30), F.lit("-"), F.lit("/")))).otherwise(name)


def known_dirs(rows: DataFrame, known: DataFrame, home: str) -> DataFrame:
    """Rows (name, …) with ``project``: the known path of which ``name`` is the code, else the name decoded.

    ``known`` (path) are paths that exist; of several with one code the one with most slashes counts.
    """
    codes = known.select(encoded_dir(F.col("path"), home).alias("name"), "path").groupBy("name").agg(F.max_by("path", F.struct(F.size(F.split("path", "/")), "path")).alias("project"))
    return rows.join(codes, "name", "left").withColumn("project", F.coalesce("project", decoded_dir(F.col("name"))))


def fields(json: Column, *names: str) -> Column:
    """An object's values as texts, all from one reading; nulls where the text is no object."""
    whole = F.when(json.rlike(r"^\s*\{"), json)
    return F.from_json(whole, ", ".join(f"{n} string" for n in names), {"allowUnquotedControlChars": "true"})


def listed(json: Column) -> Column:
    """The elements of a list as texts; none where the text is no list."""
    return F.coalesce(F.when(F.ltrim(json).startswith("["), F.from_json(json, "array<string>")), F.array().cast("array<string>"))


# --- branches and links --------------------------------------------------------------------------------------------


def _named_branch(value: Column, depth: int) -> Column:
    plain = F.when(value.rlike(r"\S"), strip(value))
    is_object = F.ltrim(value).startswith("{")
    if depth == 0:
        return F.when(~is_object, plain)
    inner = once(fields(value, *_BRANCH), lambda p: F.coalesce(*(_named_branch(p[k], depth - 1) for k in _BRANCH)))
    return F.when(is_object, inner).otherwise(plain)


_BRANCH = ("branchName", "name", "branch", "ref")


def branch_name(value: Column, depth: int = 2) -> Column:
    """The branch that a text, or an object up to ``depth`` levels deep, names; null if none (P25)."""
    return once(value, lambda v: _named_branch(v, depth))


def branches(composer: Column) -> Column:
    """(branch, chain) of a conversation's JSON: where it ended, and all its branches in order where there are two or more (P25)."""
    ends = ("committedToBranch", "prBranchName", "activeBranch")

    def in_order(timed: Column) -> Column:
        return F.transform(F.when(F.forall(timed, lambda s: s["t"].isNotNull()), F.sort_array(timed)).otherwise(timed), lambda s: s["name"])

    def of(c: Column) -> Column:
        timed = F.transform(listed(c["branches"]), lambda x, i: F.struct(F.get_json_object(x, "$.lastInteractionAt").try_cast("double").alias("t"), i.alias("i"), _named_branch(x, 2).alias("name")))
        first, last = _named_branch(c["createdOnBranch"], 2), F.struct(*(_named_branch(c[k], 2).alias(k) for k in ends))
        return once(last, lambda e: once(F.array_distinct(F.array_compact(F.concat(F.array(first), once(timed, in_order), F.array(*(e[k] for k in ends))))), lambda chain: F.struct(
            F.coalesce(e["activeBranch"], e["committedToBranch"], F.try_element_at(chain, F.lit(-1))).alias("branch"), F.when(F.size(chain) > 1, chain).alias("chain"),
        )))

    return once(fields(composer, "createdOnBranch", "branches", *ends), of)


def branch_chain(branch: Column, chain: Column) -> Column:
    """The branches with the current one last; null without one (P25)."""
    back = F.array_position(F.reverse(chain), branch)
    moved = F.array_append(F.filter(chain, lambda _, i: i != F.size(chain) - back), branch)
    return F.when(branch.isNotNull() & (branch != ""), F.when(F.coalesce(F.size(chain), F.lit(0)) <= 1, F.array(branch)).when(back > 1, moved).otherwise(chain))


def pull_requests(bubbles: DataFrame) -> DataFrame:
    """(session, pr_url, pr_number, pr_repository, position) of (session, position, bubble): each link once, where it first stands."""
    listed = F.get_json_object("bubble", "$.pullRequests")
    each = bubbles.where(F.ltrim(listed).startswith("[")).select("session", "position", F.posexplode(F.from_json(listed, "array<string>")).alias("at", "p"))
    get = lambda k: F.nullif(F.get_json_object("p", f"$.{k}"), F.lit(""))
    url = F.coalesce(*(get(k) for k in ("prUrl", "url", "htmlUrl", "html_url")))
    number = F.coalesce(get("prNumber"), get("number")).try_cast("double").cast("long")
    number = F.coalesce(F.when(number > 0, number), F.regexp_extract(url, r"/pull/(\d+)(?:[/?#]|$)", 1).try_cast("long"))
    repository = F.coalesce(get("prRepository"), get("repository"), get("repoFullName"), F.regexp_extract(url, r"(?i)github\.com/([^/]+/[^/]+)/pull/\d+", 1))
    rows = each.select("session", url.alias("pr_url"), number.alias("pr_number"), repository.alias("pr_repository"), "position", "at").where("pr_url is not null and pr_number > 0")
    return rows.groupBy("session", "pr_url").agg(F.min_by(F.struct("pr_number", "pr_repository", "position"), F.struct("position", "at")).alias("r")).select("session", "pr_url", "r.*")


# --- context files -------------------------------------------------------------------------------------------------


def _path(value: Column) -> Column:
    def of(v: Column) -> Column:
        uri = F.try_url_decode(F.replace(F.regexp_replace(v, r"^(?i)file://(?:localhost)?", ""), F.lit("+"), F.lit("%2B")))
        return F.when((v != "") & ~v.contains("\n"), F.when(v.rlike(r"^(?i)file://"), F.regexp_replace(uri, r"^/(?i)([a-z]:/)", "$1")).otherwise(v))

    return once(strip(value), of)


def context_file(value: Column) -> Column:
    """A path as it is written, or that of a file URI; null for empty texts, several lines and broken URIs."""
    return _path(value)


_PATHS = ("filePath", "path", "fsPath", "uri", "relativeWorkspacePath", "relativePath")


def _named(item: Column, *keys: str) -> Column:
    """The first of the keys' values that is a file, of an object of ``fields``."""
    return F.coalesce(*(F.when(~item[k].startswith("{") & ~item[k].startswith("["), _path(item[k])) for k in keys))


def _is_object(item: Column) -> Column:
    return F.ltrim(item).startswith("{") & F.try_parse_json(item).isNotNull()


def _of_item(item: Column) -> Column:
    """The file of a list's element, a text or an object."""
    likely = lambda name: F.when(name.contains("/") | name.contains(".") | name.startswith("~"), name)
    named = once(fields(item, *_PATHS, "name"), lambda p: F.coalesce(_named(p, *_PATHS), once(_named(p, "name"), likely)))
    plain = F.when(F.try_parse_json(item).isNull(), _path(item))  # braces that are no JSON
    return F.when(F.ltrim(item).startswith("{"), F.coalesce(named, plain)).otherwise(_path(item))


def _of_folder(folder: Column) -> Column:
    """The files of a folder's listing, below the folder where it is named."""

    def below(at: Column, f: Column) -> Column:
        def of(p: Column) -> Column:
            name = F.when(p.isNotNull(), _named(p, "name")).otherwise(_path(f))
            named = lambda n: F.when(at.isNotNull() & n.isNotNull(), F.when(at == ".", n).otherwise(F.concat_ws("/", at, n))).otherwise(F.coalesce(_named(p, *_PATHS), n))
            return once(name, named)

        return once(F.when(_is_object(f), fields(f, *_PATHS, "name")), of)

    def of(p: Column) -> Column:
        at = F.regexp_replace(F.regexp_replace(_named(p, "directoryRelativeWorkspacePath", "directoryPath"), "/+$", ""), r"^(?:\./)+", "")
        return once(at, lambda at: F.transform(F.from_json(p["files"], "array<string>"), lambda f: below(at, f)))

    return once(fields(folder, "directoryRelativeWorkspacePath", "directoryPath", "files"), of)


def context(bubbles: DataFrame, requests: DataFrame, limit: int = CONTEXT_FILES) -> DataFrame:
    """(session, context_files, request_contexts, has_rules): the files that a session was shown, first seen first.

    ``bubbles`` (session, position, bubble) come before ``requests`` (session, position, request), both JSON. Requests
    without a list that holds something don't count. The first ``limit`` files of a session are kept; parts "." and ".."
    within a folder's files stay as they are.
    """
    seen = once(fields(F.col("bubble"), "relevantFiles", "recentlyViewedFiles"), lambda b: F.concat(listed(b["relevantFiles"]), listed(b["recentlyViewedFiles"])))
    of_bubbles = bubbles.select("session", F.lit(0).alias("side"), "position", F.transform(seen, _of_item).alias("files"))
    lists = ("terminalFiles", "cursorRules", "attachedFoldersListDirResults", "summarizedComposers")
    full = requests.select("session", "position", once(fields(F.col("request"), *lists), lambda r: F.struct(*(listed(r[k]).alias(k) for k in lists))).alias("r")).where(" or ".join(f"size(r.{k}) > 0" for k in lists))
    folders = F.flatten(F.filter(F.transform("r.attachedFoldersListDirResults", _of_folder), lambda x: x.isNotNull()))
    of_requests = full.select("session", F.lit(1).alias("side"), "position", F.concat(F.transform("r.terminalFiles", _of_item), folders).alias("files"))
    each = of_bubbles.unionByName(of_requests).select("session", "side", "position", F.posexplode("files").alias("at", "file")).where("file is not null")
    first = each.groupBy("session", "file").agg(F.min(F.struct("side", "position", "at")).alias("o"))
    files = windows.top_k(first, ["session"], ["o", "file"], limit).groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "file"))), lambda x: x["file"]).alias("context_files"))
    counts = full.groupBy("session").agg(F.count("*").alias("request_contexts"), F.max(F.size("r.cursorRules") > 0).alias("has_rules"))
    return files.join(counts, "session", "full_outer").select("session", "context_files", F.coalesce("request_contexts", F.lit(0)).alias("request_contexts"), F.coalesce("has_rules", F.lit(False)).alias("has_rules"))


# --- project roots -------------------------------------------------------------------------------------------------


def is_low_signal(root: Column) -> Column:
    """Whether a root is that of many projects."""
    return root.isin("/home", "/tmp", "/workspace", "/workspaces") | root.rlike(r"^/home/[^/]+$")


def is_direct(root: Column) -> Column:
    """Whether a root has the shape of a project's, so that it holds without a known one."""
    return root.rlike(r"^/workspaces?/[^/]+$|^/home/[^/]+/[^/]+$|^/Users/[^/]+/[^/]+/[^/]+$")


def root_of(path: Column) -> Column:
    """The project root that a path tells; null if none."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"""[)"',]+$""", "")
    other = p.contains("/.config/") | p.contains("/.cursor/skills/") | p.contains("/.cursor/extensions/")
    marked = F.coalesce(*(F.when(p.contains(m), F.substring_index(p, m, 1)) for m in ("/.git/", "/.devcontainer/", "/.cursor/")))
    shaped = F.coalesce(*(F.nullif(F.regexp_extract(p, r, 1), F.lit("")) for r in (r"^(/workspaces?/[^/.][^/]*)", r"^(/Users/+[^/]+/+[^/]+/+[^/]+)", r"^(/home/+[^/]+/+[^/.][^/]*)")))
    return F.when(p.startswith("/") & ~other, F.when(marked.isNotNull(), F.nullif(marked, F.lit(""))).otherwise(shaped))


def root_hints(raw: Column) -> Column:
    """The project roots that a text's paths tell, longest first, then in the text's order."""
    found = F.regexp_extract_all(raw, F.lit(r"""/(?:Users|home|workspace|workspaces|tmp)/[^"'\s,}{]{1,240}"""), F.lit(0))
    roots = F.array_distinct(F.array_compact(F.transform(found, root_of)))
    ranked = F.transform(roots, lambda r, i: F.struct((-F.length(r)).alias("n"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(ranked), lambda s: s["r"])


def with_project(composers: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Conversations (session, raw, …) with ``project``.

    That is, in this order: the longest known workspace (path) that the text names or lies above a path in it; the only
    known one whose last part is that of the best root hint; the best hint; null. Joins are by equal paths: each text's
    paths are spread out into their parents, so no text is compared with all workspaces.
    """
    known = workspaces.select(F.regexp_replace("path", "/+$", "").alias("path")).where("path <> ''").distinct()
    token = F.regexp_extract_all("raw", F.lit(r"""[^"'\s,}{]{2,400}"""), F.lit(0))
    clean = F.transform(F.filter(token, lambda x: x.contains("/")), lambda x: F.concat(F.lit("/"), F.regexp_replace(x, r"^(?:[a-z]+:)?/*|/+$", "")))
    parents = F.transform(F.array_distinct(clean), lambda p: F.transform(F.sequence(F.lit(2), F.size(F.split(p, "/"))), lambda n: F.array_join(F.slice(F.split(p, "/"), 1, n), "/")))
    named = composers.select("session", F.explode(F.array_distinct(F.flatten(parents))).alias("path")).join(known, "path")
    longest = named.groupBy("session").agg(F.max_by("path", F.struct(F.length("path"), "path")).alias("__named"))
    single = known.groupBy(F.substring_index("path", "/", -1).alias("__base")).agg(F.count("*").alias("n"), F.min("path").alias("__same")).where("n = 1").drop("n")
    hints = root_hints(F.col("raw"))
    best = F.coalesce(F.try_element_at(F.filter(hints, lambda h: ~is_low_signal(h)), F.lit(1)), F.try_element_at(F.filter(hints, is_direct), F.lit(1)))
    rows = composers.withColumn("__hint", best).withColumn("__base", F.substring_index("__hint", "/", -1))
    rows = rows.join(longest, "session", "left").join(single, "__base", "left")
    return rows.withColumn("project", F.coalesce("__named", "__same", "__hint")).drop("__hint", "__base", "__named", "__same")
