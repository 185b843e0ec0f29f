"""Pattern and surface candidates: files x lines x rules, in one pass over each file.

A file's whole text is held against the literals without which a rule can't match, then, where a rule looks at nothing
beyond its match, against the rule; only files that pass are cut into lines. There every rule is a literal condition over
the array of lines, so nothing is exploded before it has matched; windows are taken from the same array. Only candidates
are shuffled, once, for ordinals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.needs import holds
from ..plans.rules import Rule

LEDGER = ["id", "file", "line", "layer", "source", "rule_id", "precision", "question", "match_excerpt", "status", "catalog_version", "window_spec"]


def lines_of(corpus: DataFrame) -> DataFrame:
    """(path, line, text), one row for each line."""
    numbered = corpus.select("path", F.posexplode(T.split_lines("content")).alias("pos", "text"))
    return numbered.select("path", (F.col("pos") + 1).alias("line"), "text")


def readable(inventory: DataFrame) -> DataFrame:
    """Regular, readable text files within the size bound; links are not followed."""
    return inventory.filter("is_regular and is_readable and is_within_size_bound and not is_symlink and not is_binary")


def applies(rule: Rule, path: Column, language: Column | None = None, prose: Column | None = None) -> Column:
    """Whether a rule is for a path; language and prose are the path's, where they are at hand."""
    ok = F.lit(True)
    for glob in rule.paths_exclude:
        ok = ok & ~path.rlike("(?s)" + T.glob_regex(glob))
    if rule.files:
        any_file = F.lit(False)
        for glob in rule.files:
            any_file = any_file | path.rlike("(?siu)" + T.glob_regex(glob))
        return ok & any_file
    if rule.layer == "instruction" and not rule.id.startswith("generic."):
        return ok & (T.is_prose(path) if prose is None else prose)
    if rule.languages:
        return ok & F.coalesce((T.language_of(path) if language is None else language).isin(list(rule.languages)), F.lit(False))
    return ok


def _open(rules: list[Rule]) -> Column:
    """For each rule, whether it may match in a file: its literals are there, it is for the path, and where it is local it matches the text."""

    def of(file: Column) -> Column:
        each = []
        for k, rule in enumerate(rules):
            wanted = F.col("held")[k] & applies(rule, F.col("path"), file["language"], file["prose"])
            each.append(wanted & F.col("content").rlike(rule.java) if _local(rule.java) else wanted)
        return F.array(*each)

    # a lambda's argument is worked out once for all rules
    return F.element_at(F.transform(F.array(F.struct(T.language_of(F.col("path")).alias("language"), T.is_prose(F.col("path")).alias("prose"))), of), 1)


def _spans(line: Column, rule: Rule) -> Column:
    """Starts (from 0) and ends of all matches: gaps between matches and matches alternate."""
    found, gaps = F.regexp_extract_all(line, F.lit(rule.java), F.lit(0)), F.split(line, rule.java, -1)
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        return F.struct(b.alias("at"), F.concat(s["all"], F.array(F.struct(a.alias("start"), b.alias("stop")))).alias("all"))

    return F.aggregate(steps, start, step, lambda s: s["all"])


def _hits(rule: Rule, every: bool, wanted: Column) -> Column:
    """Candidates of one rule in a file: array of (rule, line index, start, stop, excerpt)."""
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    matched = F.filter(numbered, lambda x: x["x"].rlike(rule.java))

    def entry(line: Column, start: Column, stop: Column) -> Column:
        return F.struct(F.lit(rule.id).alias("rule_id"), line["i"].alias("index"), start.cast("int").alias("start"), T.excerpt(line["x"], start, stop).alias("match_excerpt"))

    if every:
        found = F.flatten(F.transform(matched, lambda x: F.transform(_spans(x["x"], rule), lambda s: entry(x, s["start"], s["stop"]))))
    else:
        found = F.transform(matched, lambda x: entry(x, F.lit(0), F.length(x["x"])))
    empty = F.array().cast("array<struct<rule_id:string,index:int,start:int,match_excerpt:string>>")
    return F.when(wanted, found).otherwise(empty)


def _local(pattern: str) -> bool:
    """Whether what the pattern matches in a line it also matches in the whole text: nothing in it looks beyond the match."""
    plain = re.sub(r"\\\\|\\[\^$]|\[\^", "", pattern)
    return not re.search(r"\(\?(?:[=!]|<[=!]|>)|[\^$]|\\[ABZzG]|[*+?}]\+", plain)


def identify(hits: DataFrame, order: list[str]) -> DataFrame:
    """Adds id to (path, rule_id, window_sha256, ...): ordinals count equal windows of a rule in a file."""
    place = Window.partitionBy("path", "rule_id", "window_sha256").orderBy(*order)
    ranked = hits.withColumn("ordinal", F.row_number().over(place) - 1)
    return ranked.withColumn("id", T.candidate_id(F.col("path"), F.col("rule_id"), F.col("window_sha256"), F.col("ordinal")))


def candidates(corpus: DataFrame, rules: list[Rule], source: str, window_spec: str, every: bool) -> DataFrame:
    """Ledger rows with start, window_sha256 and ordinal beside them. corpus has path and content (null: unread)."""
    files = corpus.filter("content is not null").select("path", F.col("content").cast("string").alias("content"))
    # most files hold no match and go no further; inline, as a filter on open would be pushed below it and work it out twice
    tried = F.filter(F.array(F.struct("path", "content", F.when(F.array_contains("held", True), _open(rules)).alias("open"))), lambda x: F.array_contains(x["open"], True))
    files = files.withColumn("held", holds(F.col("content"), [r.condition for r in rules])).select(F.inline(tried)).select("path", "open", "content", T.split_lines(F.col("content")).alias("lines"))
    found = files.select("path", T.composed(F.col("content")).alias("composed"), F.concat(*[_hits(r, every, F.col("open")[k]) for k, r in enumerate(rules)]).alias("hits"))
    # windows by line, not by match: a line with many matches has one, which is dropped when it is hashed
    index = F.array_distinct(F.transform("hits", lambda h: h["index"]))
    shas = T.once(T.once(F.split("composed", T.BREAK, -1), T.unended), lambda lines: F.transform(index, lambda i: F.sha2(T.window(lines, i), 256)))
    hit = lambda by: F.transform("hits", lambda h: F.struct(by[h["index"]].alias("window_sha256"), h["rule_id"].alias("rule_id"), h["index"].alias("index"), h["start"].alias("start"), h["match_excerpt"].alias("match_excerpt")))
    # an outer inline, as a filter on hits or an inner one would be pushed below them and work them out twice
    rows = found.select("path", F.inline_outer(T.once(F.map_from_arrays(index, shas), hit))).filter("rule_id is not null")
    facts = F.create_map(*[x for r in rules for x in (F.lit(r.id), F.struct(F.lit(r.layer).alias("layer"), F.lit(r.precision).alias("precision"), F.lit(" ".join(r.question.split())).alias("question"), F.lit(r.version).alias("version")))])
    ranked = identify(rows.withColumn("line", F.col("index") + 1), ["line", "start"])
    fact = F.element_at(facts, F.col("rule_id"))
    return ranked.select("id", F.col("path").alias("file"), "line", fact["layer"].alias("layer"), F.lit(source).alias("source"), "rule_id", fact["precision"].alias("precision"), fact["question"].alias("question"), "match_excerpt", F.lit("unresolved").alias("status"), fact["version"].alias("catalog_version"), F.lit(window_spec).alias("window_spec"), "start", "window_sha256", "ordinal")


def pattern_hits(corpus: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every match of every pattern is a row; rows are never merged."""
    return candidates(corpus, rules, "pattern", "lines-20", True)


def surface_hits(corpus: DataFrame, kinds: list[Rule]) -> DataFrame:
    """One row for each line and kind that declares a surface."""
    return candidates(corpus, kinds, "surface", "decl-20", False)
