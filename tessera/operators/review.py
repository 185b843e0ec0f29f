"""The ledger's later life: merging, gates, re-review, severity, lifecycle, composition."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sweep import LEDGER

#: The ledger as a table: a source whose block is empty leaves no file to read it from.
SCHEMA = ", ".join(f"{c} {'int' if c == 'line' else 'string'}" for c in LEDGER)
SOURCES = ["pattern", "surface", "structure", "closure"]
STATUSES = ["unresolved", "finding", "verified-ok", "deferred"]
SEVERITIES = ["informational", "observation", "low", "medium", "high", "critical"]
# How a finding is reached, from a remote party to not at all.
REACHABILITY = ["network", "mcp-tool", "skill-autoload", "hook-lifecycle", "agent-instruction", "untrusted-content", "cli-only", "config-file", "local-privileged", "unreachable"]
POC_OUTCOMES = ["still-vulnerable", "no-longer-vulnerable", "inconclusive"]


def replace_block(existing: DataFrame, source: str, block: DataFrame) -> DataFrame:
    """The ledger with one source's rows replaced; rows of other sources stay. Unknown sources are refused."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    return existing.select(*LEDGER).filter(F.col("source") != source).unionByName(block.select(*LEDGER))


def foreign(existing: DataFrame) -> DataFrame:
    """Rows that no source of ours has written: a ledger with any is refused before it is replaced."""
    return existing.filter(~F.coalesce(F.col("source").isin(SOURCES) & F.col("id").rlike("^[0-9a-f]{16}$") & F.col("status").isin(STATUSES) & (F.col("line") >= 0), F.lit(False)))


def write_ledger(block: DataFrame, folder: str, source: str) -> None:
    """Replaces one source's partition by block, also where block is empty; those of other sources stay."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    spark = block.sparkSession
    own = block.select(*LEDGER).filter(F.col("source") == source)
    if own.isEmpty():
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/source={source}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        top = place.getParent()
        if not top.getFileSystem(spark._jsc.hadoopConfiguration()).exists(top):
            own.limit(0).write.partitionBy("source").parquet(folder)
        return
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(folder)


def to_jsonl(ledger: DataFrame, path: str) -> int:
    """The ledger as one JSON file in a fixed order of keys and rows, by way of a temporary file; rows stream through the driver."""
    place = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    n = 0
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
        for row in ledger.select(*LEDGER).orderBy(place, "file", "line", "rule_id", "id").toLocalIterator():
            f.write(json.dumps(row.asDict(), ensure_ascii=False) + "\n")
            n += 1
    os.replace(temporary, path)
    return n


def lost(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("id").exceptAll(after.select("id"))


def gate(ledger: DataFrame) -> DataFrame:
    """(unresolved, passes): the gate opens when nothing is unresolved."""
    return ledger.agg(F.count_if(F.col("status") == "unresolved").alias("unresolved")).select("unresolved", (F.col("unresolved") == 0).alias("passes"))


def version_key(version):
    """A column whose order is that of dotted versions: numbers as numbers, 2026.9 before 2026.10."""
    return F.array_join(F.transform(F.split(version, r"\."), lambda x: F.lpad(x, 16, "0")), ".")


def resolution_faults(resolutions: DataFrame) -> DataFrame:
    """(id, fault) of resolutions that may not stand.

    Columns: id, status, rationale, and of a verification verified_by, verified_at, catalog_version, target_version,
    window_sha256, window_spec, anchor. Every status but unresolved needs a rationale; verified-ok needs the whole record of what was
    verified, without which it can't be judged later.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    record = ["verified_by", "verified_at", "catalog_version", "target_version", "window_sha256", "window_spec", "anchor"]
    unscoped = F.lit(False)
    for c in record:
        unscoped = unscoped | blank(c)
    known = F.coalesce(F.col("status").isin(STATUSES), F.lit(False))
    fault = F.when(~known, "unknown status").when((F.col("status") != "unresolved") & blank("rationale"), "no rationale").when((F.col("status") == "verified-ok") & unscoped, "no verification record")
    return resolutions.select("id", fault.alias("fault")).filter("fault is not null")


def rereview(now: DataFrame, prior: DataFrame) -> DataFrame:
    """(id, freshness, queue) over two snapshots.

    Columns: id, window_sha256, window_spec, catalog_version, target_version, manifest_sha256, and in prior
    verified_day, ttl_days, by_grant (whether the judgment rests on a grant); now has today, rule_changed (whether its rule
    is new or changed since the prior version). Digests are compared only where both windows have one spec. What is
    invalidated is reviewed again one by one (hard), what is expired may be affirmed in batch (soft); the queues are never merged.
    """
    a, b = now.alias("a"), prior.alias("b")
    same = F.col("a.window_spec") == F.col("b.window_spec")
    newer = (version_key(F.col("a.catalog_version")) > version_key(F.col("b.catalog_version"))) & F.col("a.rule_changed")
    void = ~same | (same & (F.col("a.window_sha256") != F.col("b.window_sha256"))) | newer | ((F.col("a.manifest_sha256") != F.col("b.manifest_sha256")) & F.col("b.by_grant"))
    old = (F.col("a.target_version") != F.col("b.target_version")) | (F.datediff("a.today", "b.verified_day") > F.col("b.ttl_days"))
    state = F.when(F.col("b.id").isNull(), "new").when(F.col("a.id").isNull(), "vanished").when(void, "invalidated").when(old, "expired").otherwise("fresh")
    queue = F.when(state.isin("new", "invalidated"), "hard").when(state == "expired", "soft").when(state == "vanished", "follow-up")
    return a.join(b, F.col("a.id") == F.col("b.id"), "full_outer").select(F.coalesce("a.id", "b.id").alias("id"), state.alias("freshness"), queue.alias("queue"))


def follow_up(vanished: DataFrame) -> DataFrame:
    """(id, step, outcome) of hits that are gone, by the strongest check that says something; none is closed by being gone.

    Columns: id, poc (an outcome of POC_OUTCOMES, or null), anchor (whether its symbol or section was found again),
    widened (matches of the looser pattern). A proof that doesn't run says nothing, and is never a fix.
    """
    step = F.when(F.col("poc").isin("still-vulnerable", "no-longer-vulnerable"), "poc").when(F.col("anchor"), "anchor").when(F.col("widened") > 0, "sweep").otherwise("manual")
    outcome = F.when(step == "poc", F.when(F.col("poc") == "still-vulnerable", "survives").otherwise("probably fixed, to be confirmed")).when(step == "anchor", "moved, to be reviewed").when(step == "sweep", "rephrased, to be reviewed").otherwise("to be judged")
    return vanished.select("id", step.alias("step"), outcome.alias("outcome"))


def severity(findings: DataFrame) -> DataFrame:
    """(id, severity, capped_by): the impact under every cap that holds, and the caps that lowered it.

    Columns: id, impact, reachability (one of REACHABILITY), evidence_type (poc, instruction or other), dangerous (an
    unambiguous instruction to do concrete harm), crosses_boundary. Without a proof or an instruction on record: observation
    at most. An instruction: medium, if not dangerous. Reached by a command only: medium, if it crosses no boundary. Unreachable:
    informational. An unknown impact or reachability gives null. No score of another scheme takes part.
    """
    rank = lambda c: F.array_position(F.array(*map(F.lit, SEVERITIES)), c)
    at = {name: k for k, name in enumerate(SEVERITIES, 1)}
    evidence, reach = F.coalesce("evidence_type", F.lit("")), F.col("reachability")
    caps = [
        ("no proof", ~evidence.isin("poc", "instruction"), at["observation"]),
        ("instruction", (evidence == "instruction") & ~F.coalesce("dangerous", F.lit(False)), at["medium"]),
        ("cli-only", (reach == "cli-only") & ~F.coalesce("crosses_boundary", F.lit(False)), at["medium"]),
        ("unreachable", reach == "unreachable", at["informational"]),
    ]
    impact = rank(F.col("impact"))
    top = F.least(impact, *[F.when(when, bound).otherwise(len(SEVERITIES)) for _, when, bound in caps])
    lowered = F.filter(F.array(*[F.when(when & (impact > bound), name) for name, when, bound in caps]), lambda x: x.isNotNull())
    known = reach.isin(REACHABILITY) & (impact > 0)
    return findings.select("id", F.when(known, F.try_element_at(F.array(*map(F.lit, SEVERITIES)), top.cast("int"))).alias("severity"), F.array_join(lowered, ",").alias("capped_by"))


def lifecycle(history: DataFrame) -> DataFrame:
    """history (id, version, present, declined) as open, wont-fix, fixed, regressed or absent at each version."""
    by = Window.partitionBy("id").orderBy("version")
    ever = F.max(F.col("present").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    before = F.lag("present").over(by)
    state = F.when(F.col("present") & ~F.coalesce(before, F.lit(True)) & (F.coalesce(ever, F.lit(0)) == 1), "regressed").when(F.col("present") & F.col("declined"), "wont-fix").when(F.col("present"), "open").when(F.coalesce(ever, F.lit(0)) == 1, "fixed").otherwise("absent")
    return history.select("id", "version", state.alias("state"))


def residues(closed: DataFrame) -> DataFrame:
    """(id, status, derived_from): a partial fix closes its finding as fixed and opens another for what is left.

    closed has id and residue_id, null where nothing is left.
    """
    done = closed.select("id", F.lit("fixed").alias("status"), F.lit(None).cast(closed.schema["id"].dataType).alias("derived_from"))
    return done.unionByName(closed.filter("residue_id is not null").select(F.col("residue_id").alias("id"), F.lit("open").alias("status"), F.col("id").alias("derived_from")))


def composition(grants: DataFrame) -> DataFrame:
    """(writer, loader, path): a component that may write where another loads from.

    grants has component, access (write or load), path. Each loaded path is matched on the folders above it,
    which makes the prefix test a join on equal keys.
    """
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    loads = grants.filter("access = 'load'").select(F.col("component").alias("loader"), F.col("path").alias("loaded"), F.explode(above).alias("path"))
    writes = grants.filter("access = 'write'").select(F.col("component").alias("writer"), "path")
    return writes.join(loads, "path").filter("writer <> loader").select("writer", "loader", F.col("loaded").alias("path")).distinct()


def redundancy(hits: DataFrame) -> DataFrame:
    """(rule_a, rule_b, places): pairs of rules that stand on one line."""
    own = hits.select("file", "line", "rule_id").distinct()
    pairs = own.alias("a").join(own.alias("b"), ["file", "line"]).filter("a.rule_id < b.rule_id")
    return pairs.groupBy(F.col("a.rule_id").alias("rule_a"), F.col("b.rule_id").alias("rule_b")).agg(F.count("*").alias("places"))
