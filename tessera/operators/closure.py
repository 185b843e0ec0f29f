"""References between files: extraction, resolution, transitive closure and the records they leave.

All references are extracted and resolved once, as tables; the closure then walks the edge table only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from .recon import SHOWN, first_few, gap
from .sweep import identify

# Names, suffixes and the shapes of references.
LOCKFILES = ["uv.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "Gemfile.lock", "composer.lock"]
STRUCTURED = [".json", ".yaml", ".yml", ".toml", ".ini", ".cfg"]
EXTRA_SUFFIXES = [".bin", ".so", ".dylib", ".dll", ".exe", ".wasm", ".node", ".zip", ".tar", ".gz", ".tgz", ".whl", ".jar", ".mdc", ".rst", ".lock", ".env", ".conf", ".service", ".plist"]
ESM = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}
ROOTS = ["SKILL.md", ".mcp.json", "mcp.json", "plugin.json", "hooks.json", "settings.json", "CLAUDE.md", "AGENTS.md", "AGENT.md"]
VARIABLES = ["appdata", "home", "homepath", "localappdata", "programdata", "programfiles", "systemroot", "temp", "tmp", "tmpdir", "userprofile", "xdg_cache_home", "xdg_config_home", "xdg_data_home"]
VERSION = "1"
PRECISION = {"remote_resource": "low", "missing_reference": "low", "escaping_reference": "medium", "content_changed": "high", "ambiguous_reference": "medium", "unresolved_citations": "low"}
QUESTIONS = {
    "remote_resource": "Is this remote resource loaded, and who controls what it holds?",
    "missing_reference": "Nothing here is at this path; what puts it there before it is used?",
    "escaping_reference": "What is read at this place beyond the root, and who controls it?",
    "content_changed": "The file changed between two reads; which one was reviewed?",
    "ambiguous_reference": "Several files have this name; which one is loaded?",
    "unresolved_citations": "Does the document rely on any of these paths?",
}
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,31}://[^\s'\"`<>)\]},]{1,2048}")
_LINK = re.compile(r"!?\]\(\s*([^)\s]{1,512})\s*\)")
_EDGE = r"(?<![\w./@+~*:-])"
_FOREIGN = re.compile(_EDGE + r"((?:\$\{?([A-Za-z_]\w{0,63})\}?|%([A-Za-z_][\w()]{0,63})%|[A-Za-z]:)[/\\](?:[\w@.+-]{1,128}[/\\]){0,16}[\w@.+-]{0,127}[\w@+-])(?![\w/\\-])")
_ABSOLUTE = re.compile(_EDGE + r"((?:~/(?:[\w@.+-]{1,128}/){0,16}|/(?:[\w@.+-]{1,128}/){1,16})[\w@.+-]{0,127}[\w@+-])(?![\w/-])")
_PATH = re.compile(r"(?<![\w./@+-])((?:\.{1,2}/)?(?:[\w@.+-]{1,128}/){0,16}[\w@+-]{1,128}(\.[A-Za-z0-9]{1,8}))(?![\w/-])")
_IMPORT = re.compile(r"^\s*(?:import|export)\b|\bfrom\s*[\"']|\brequire\s*\(|\bimport\s*\(")
_SOMETIMES = re.compile(r"\b(?:if|when|unless|optional(?:ly)?|progressive(?:ly)?|lazy|lazily|conditional(?:ly)?|on[-\s]demand|as[-\s]needed|only[-\s]for|depending)\b", re.I)
_KNOWN = frozenset(T.LANGUAGES) | frozenset(EXTRA_SUFFIXES)


def on_line(line: str) -> list[tuple[str, str]]:
    """(reference, load) of a line. Each shape takes its text, so that no later shape reads it again."""
    load = "conditional" if _SOMETIMES.search(line) else "direct"
    taken: list[tuple[int, int]] = []
    free = lambda a, b: all(b <= x or y <= a for x, y in taken)
    out = []
    for m in _URL.finditer(line):
        taken.append(m.span())
        out.append((m[0], "fetch"))
    for m in _LINK.finditer(line):
        taken.append(m.span(1))
        if not m[1].startswith("#") and not _URL.match(m[1]):
            out.append((m[1], load))
    for m in _FOREIGN.finditer(line):
        if free(*m.span(1)):
            taken.append(m.span(1))
            variable = m[2] or m[3]
            if variable is None or variable.lower() in VARIABLES:
                out.append((m[1], load))
    out += [(m[1], load) for m in _ABSOLUTE.finditer(line) if free(*m.span(1))]
    imports = bool(_IMPORT.search(line))
    for m in _PATH.finditer(line):
        if m[2].lower() in _KNOWN and free(*m.span(1)) and line[m.end(1) : m.end(1) + 1] != "(" and not (imports and m[1][0] not in "./"):
            out.append((m[1], load))
    return out


def references(corpus: DataFrame) -> DataFrame:
    """(from_path, line, raw, load) of every readable file that is not a lock file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, raw, load) for p, n, x in zip(batch["path"], batch["line"], batch["text"], strict=True) for raw, load in on_line(x)]
            yield pd.DataFrame(rows, columns=["from_path", "line", "raw", "load"])

    files = corpus.filter(F.col("content").isNotNull() & ~T.basename(F.col("path")).isin(LOCKFILES))
    lines = files.select("path", F.posexplode(T.split_lines(F.col("content"))).alias("pos", "text")).filter(F.col("text").rlike(r"[/.]"))
    return lines.select("path", (F.col("pos") + 1).alias("line"), "text").mapInPandas(run, "from_path string, line int, raw string, load string")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def resolve(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """refs with dst, or rule_id and reason: beside the file, from the root, as a compiled source, then by name."""
    paths = inventory.select("path")
    # of a name that stands in very many folders only the first few are gathered
    named = paths.withColumn("name", T.basename(F.col("path")))
    place = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    few = named.withColumn("place", place).filter(F.col("place") <= SHOWN).groupBy("name").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    names = named.groupBy("name").agg(F.count("*").alias("count")).join(few, "name")
    beside, atop = T.lexical_join(folder(F.col("from_path")), F.col("raw")), T.lexical_join(F.lit(""), F.col("raw"))
    rooted = F.col("raw").rlike(r"^(?:/|~/|\$|%|[A-Za-z]:[/\\])")
    own = refs.withColumn("rel", F.when(~rooted, beside)).withColumn("top", F.when(~rooted, atop))
    ending = F.lower(F.regexp_extract("raw", r"(\.[^./]*)$", 1))
    swap = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in ESM.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), ending), F.array().cast("array<string>"))
    relative = F.col("raw").rlike(r"^\.{1,2}/")
    stem = lambda p: F.regexp_replace(p, r"\.[^./]*$", "")
    tried = F.when(relative, F.concat(F.transform(swap, lambda s: F.concat(stem(F.col("rel")), s)), F.transform(swap, lambda s: F.concat(stem(F.col("top")), s)))).otherwise(F.array().cast("array<string>"))
    order = F.filter(F.concat(F.array("rel", "top"), tried), lambda x: x.isNotNull())
    numbered = own.withColumn("ref", F.monotonically_increasing_id()).withColumn("tried", order)
    numbered = cut(numbered)
    found = numbered.filter("load <> 'fetch' and rel is not null").select("ref", F.posexplode("tried").alias("rank", "path")).join(paths, "path").groupBy("ref").agg(F.min_by("path", "rank").alias("hit"))
    joined = numbered.join(found, "ref", "left").join(names, (F.col("name") == F.col("raw")) & ~F.contains("raw", F.lit("/")), "left")
    shown = F.concat(F.array_join("paths", ", "), F.when(F.col("count") > SHOWN, F.concat(F.lit(", and "), (F.col("count") - SHOWN).cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    fetch, gone = F.col("load") == "fetch", F.col("rel").isNull()
    dst = F.when(fetch | gone, None).otherwise(F.coalesce("hit", F.when(F.col("count") == 1, F.element_at("paths", 1))))
    rule = F.when(fetch, "closure.remote_resource").when(gone, "closure.escaping_reference").when(dst.isNotNull(), None).when(F.col("count") > 1, "closure.ambiguous_reference").otherwise("closure.missing_reference")
    reason = F.when(fetch, F.concat(F.lit("a "), F.lower(F.substring_index("raw", ":", 1)), F.lit(" resource that was not fetched"))).when(gone, "outside the root, not read").when(dst.isNotNull(), None).when(F.col("count") > 1, F.concat(F.col("count").cast("string"), F.lit(" files have this name: "), shown)).otherwise("no such file")
    return joined.select("from_path", "line", "raw", "load", dst.alias("dst"), rule.alias("rule_id"), reason.alias("reason"))


def reach(edges: DataFrame, roots: DataFrame, every: int = 8) -> DataFrame:
    """path of every node reachable over (src, dst) from roots (path), each once; cycles end the walk of themselves.

    Each level is written once, as what it adds; levels are put together after each `every` of them.
    """
    edges = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    seen = front = cut(roots.select("path").distinct())
    level = 0
    while not front.isEmpty():
        step = edges.join(front, edges["src"] == front["path"]).select(F.col("dst").alias("path")).distinct()
        front = cut(step.join(seen, "path", "left_anti"))
        level += 1
        seen = seen.unionByName(front)
        if level % every == 0:
            seen = cut(seen)
    return seen


def given(spark, entries: list[str]) -> DataFrame:
    """Roots (path) that a caller names, in composed form; one that leaves the target is the caller's fault: ValueError."""
    composed = [(unicodedata.normalize("NFC", e),) for e in entries]
    named = spark.createDataFrame(composed, "said string").select("said", T.lexical_join(F.lit(""), F.col("said")).alias("path"))
    outside = [r[0] for r in named.filter("path is null or path = ''").select("said").distinct().orderBy("said").collect()]
    if outside:
        raise ValueError("an entry must name a path inside the target: " + ", ".join(outside))
    return named.select("path").distinct()


def absent(roots: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rows in the shape of resolve() for roots that the inventory doesn't have: a hole in what was to be reviewed."""
    gone = roots.select("path").distinct().join(inventory.select("path"), "path", "left_anti")
    return gone.select(F.col("path").alias("from_path"), F.lit(0).alias("line"), F.col("path").alias("raw"), F.lit("direct").alias("load"), F.lit(None).cast("string").alias("dst"), F.lit("closure.missing_reference").alias("rule_id"), F.lit("named as an entry and not there").alias("reason"))


def members(resolved: DataFrame, reached: DataFrame) -> DataFrame:
    """(path, load, referenced_from): how each reached file is loaded at best, and from which lines."""
    rank = F.when(F.col("load") == "direct", 0).when(F.col("load") == "conditional", 1).otherwise(2)
    seen = resolved.filter("dst is not null").join(reached.withColumnRenamed("path", "from_path"), "from_path", "left_semi")
    by = seen.groupBy(F.col("dst").alias("path")).agg(F.min(F.struct(rank.alias("rank"), F.col("load").alias("load"))).alias("best"), F.sort_array(F.collect_set(F.concat("from_path", F.lit(":"), F.col("line").cast("string")))).alias("referenced_from"))
    return reached.join(by, "path", "left").select("path", F.coalesce("best.load", F.lit("direct")).alias("load"), F.coalesce("referenced_from", F.array().cast("array<string>")).alias("referenced_from"))


def described(members: DataFrame, inventory: DataFrame, contents: DataFrame) -> DataFrame:
    """members() with kind (binary, source or data), size, sha256 and lines; null where the file was not read or is not there."""
    code = F.coalesce(~T.language_of(F.col("path")).isin(T.NOT_CODE), F.lit(False))
    facts = inventory.select("path", "size", "sha256", "is_binary")
    read = contents.filter("content is not null").select("path", F.size(T.split_lines(F.col("content"))).alias("lines"))
    kind = F.when(F.coalesce("is_binary", F.lit(False)), "binary").when(code, "source").otherwise("data")
    return members.join(facts, "path", "left").join(read, "path", "left").select("path", kind.alias("kind"), "load", "size", "sha256", "lines", "referenced_from")


def gaps(described: DataFrame, inventory: DataFrame, reached: DataFrame) -> DataFrame:
    """(gap): what the closure says nothing of: members in languages without rules, members of no known kind, files not reached."""
    language = T.language_of(F.col("path"))
    no_rules = described.filter(language.isNotNull() & ~language.isin([*T.NOT_CODE, "python"]))
    no_kind = described.filter(language.isNull() & (F.col("kind") != "binary"))
    return (
        gap(no_rules, "members are in a language that no rule set reads")
        .unionByName(gap(no_kind, "members have a name that says no language, so no rule set reads them"))
        .unionByName(gap(unreachable(inventory, reached), "files are reached from no entry, and so lie outside the closure"))
    )


def unreachable(inventory: DataFrame, reached: DataFrame) -> DataFrame:
    return inventory.select("path").join(reached, "path", "left_anti")


def unresolved(resolved: DataFrame, reached: DataFrame) -> DataFrame:
    """Failures of reached files, grouped, with the lines they stand on."""
    seen = resolved.filter("rule_id is not null").join(reached.withColumnRenamed("path", "from_path"), "from_path", "left_semi")
    return seen.groupBy(F.col("raw").alias("reference"), "rule_id", "reason", "load").agg(F.sort_array(F.collect_set(F.concat("from_path", F.lit(":"), F.col("line").cast("string")))).alias("referenced_from"))


def referrer_kind(path: Column, is_root: Column) -> Column:
    code = F.coalesce(~T.language_of(path).isin(T.NOT_CODE), F.lit(False))
    return F.when(T.suffix(path).isin(STRUCTURED), "manifest").when(code, "code").when(is_root, "root").otherwise("prose")


def records(resolved: DataFrame, corpus: DataFrame, reached: DataFrame, roots: DataFrame, altered: DataFrame | None = None) -> DataFrame:
    """Ledger rows of failures, anchored on the line that names what is not there.

    A row for each failure of a file that loads what it names, and of a file that nobody read (a named entry that is
    absent); one row for all citations of a document. altered has (path, was, now): files whose digest changed
    between two reads, a row each.
    """
    seen = resolved.filter("rule_id is not null").join(reached.withColumnRenamed("path", "from_path"), "from_path", "left_semi")
    marked = seen.join(roots.select(F.col("path").alias("from_path"), F.lit(True).alias("root")).distinct(), "from_path", "left")
    read = corpus.filter("content is not null").select(F.col("path").alias("from_path"), F.lit(True).alias("read"))
    marked = marked.join(read, "from_path", "left")
    kind = referrer_kind(F.col("from_path"), F.coalesce("root", F.lit(False)))
    wide = F.col("rule_id").isin("closure.remote_resource", "closure.escaping_reference")
    marked = marked.withColumn("alone", F.col("read").isNull() | kind.isin("code", "manifest") | (wide & (kind == "root")))
    files = corpus.filter("content is not null").select(F.col("path").alias("from_path"), T.split_lines(F.col("content")).alias("lines"))
    alone = marked.filter("alone").select("from_path", "line", "rule_id", "raw", "reason").distinct().join(files, "from_path", "left")
    there = F.coalesce(F.col("line").between(1, F.size("lines")), F.lit(False))
    said = F.when(there, F.try_element_at("lines", F.greatest("line", F.lit(1)))).otherwise(F.col("raw"))
    window = F.when(there, T.window(F.col("lines"), F.col("line") - 1)).otherwise(F.col("raw"))
    alone = alone.select(F.col("from_path").alias("path"), "line", "rule_id", F.col("raw").alias("reference"), "reason", said.alias("said"), T.window_sha(window).alias("window_sha256"), F.lit("lines-20").alias("window_spec"))
    cited = marked.filter("not alone").groupBy(F.col("from_path").alias("path")).agg(F.sort_array(F.collect_set("raw")).alias("refs"))
    counted = F.concat(F.size("refs").cast("string"), F.lit(" paths named here lead nowhere: "), first_few(F.col("refs")))
    cited = cited.select("path", F.lit(0).alias("line"), F.lit("closure.unresolved_citations").alias("rule_id"), F.array_join("refs", "\n").alias("reference"), counted.alias("reason"), counted.alias("said"), T.window_sha(F.array_join("refs", "\n")).alias("window_sha256"), F.lit("citation-set").alias("window_spec"))
    pending = alone.unionByName(cited)
    if altered is not None:
        both = F.concat(F.lit("the file changed between two reads: the first had digest "), "was", F.lit(", the second "), "now")
        pending = pending.unionByName(altered.select("path", F.lit(0).alias("line"), F.lit("closure.content_changed").alias("rule_id"), F.col("path").alias("reference"), both.alias("reason"), both.alias("said"), T.window_sha(both).alias("window_sha256"), F.lit("digest-pair").alias("window_spec")))
    ranked = identify(pending, ["line", "reference", "reason"])
    short = F.substring_index("rule_id", ".", -1)
    look = lambda table: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), short)
    shown = T.excerpt(F.col("said"), F.lit(0), F.length("said"))
    return ranked.select("id", F.col("path").alias("file"), "line", F.lit("code").alias("layer"), F.lit("closure").alias("source"), "rule_id", look(PRECISION).alias("precision"), look(QUESTIONS).alias("question"), shown.alias("match_excerpt"), F.lit("unresolved").alias("status"), F.lit(VERSION).alias("catalog_version"), "window_spec")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose digest differs between two snapshots (path, sha256)."""
    return before.join(after.select("path", F.col("sha256").alias("now")), "path").filter("sha256 <> now").select("path", F.col("sha256").alias("was"), "now")


def default_roots(inventory: DataFrame) -> DataFrame:
    return inventory.filter(T.basename(F.col("path")).isin(ROOTS)).select("path")
