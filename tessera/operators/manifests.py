"""Declared entry points, versions of a target, archetypes, and the report's order."""

from __future__ import annotations

import json
import os
import re
import tomllib
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .review import SEVERITIES

#: Surfaces that speak for an archetype.
SIGNALS = {"surface.skill_activation": "skill", "surface.mcp_server": "mcp-server", "surface.mcp_tool": "mcp-server", "surface.mcp_tool_listing": "mcp-server"}
QUESTION_COUNTS = {"core": 27, "skill": 10, "mcp-server": 10}


def declared(name: str, content: str) -> tuple[list[tuple[str, str]], list[str]]:
    """((command, target), ...) that a manifest declares, and what of it can't be read."""
    try:
        data = tomllib.loads(content) if name == "pyproject.toml" else json.loads(content)
    except (ValueError, RecursionError) as e:
        return [], [f"{name}: {type(e).__name__}"]
    if not isinstance(data, dict):
        return [], [f"{name}: not a table"]
    bad: list[str] = []

    def table(of: dict, key: str) -> dict:
        value = of.get(key)
        if value is not None and not isinstance(value, dict):
            bad.append(f"{name}: {key} is {type(value).__name__}, not a table")
        return value if isinstance(value, dict) else {}

    if name == "pyproject.toml":
        found = table(table(data, "project"), "scripts")
    else:
        found = {"": data["bin"]} if isinstance(data.get("bin"), str) else table(data, "bin")
    return sorted((k, v) for k, v in found.items() if isinstance(v, str)), bad


def entry_points(corpus: DataFrame) -> DataFrame:
    """(path, command, target, unreadable) of each declaration in pyproject.toml and package.json files."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found, bad = declared(path.rsplit("/", 1)[-1], content)
                rows += [(path, c, t, None) for c, t in found] + [(path, None, None, b) for b in bad]
            yield pd.DataFrame(rows, columns=["path", "command", "target", "unreadable"])

    own = corpus.select("path", "content").filter(T.basename(F.col("path")).isin("pyproject.toml", "package.json") & F.col("content").isNotNull())
    return own.mapInPandas(run, "path string, command string, target string, unreadable string")


def roots(entries: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, reason): the first file that is there of those a declaration may mean: a module below src or not, or a package."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    module = F.regexp_replace(F.trim(F.substring_index("target", ":", 1)), r"\.", "/")
    python = T.basename(F.col("path")) == "pyproject.toml"
    tried = F.when(python, F.array(*[F.concat(folder, F.lit(a), module, F.lit(b)) for a, b in (("src/", ".py"), ("", ".py"), ("src/", "/__init__.py"), ("", "/__init__.py"))])).otherwise(F.array(T.lexical_join(folder, F.col("target"))))
    each = entries.filter("target is not null").select(F.concat(F.col("path"), F.lit(" declares "), F.coalesce("command", F.lit(""))).alias("reason"), "path", "command", F.posexplode(tried).alias("rank", "file"))
    hit = each.join(inventory.select(F.col("path").alias("file")), "file").groupBy("path", "command", "reason").agg(F.min_by("file", "rank").alias("file"))
    return hit.groupBy(F.col("file").alias("path")).agg(F.min("reason").alias("reason"))


def git_identity(root: str) -> tuple[str, str | None]:
    """(source, sha): the commit a tree stands on, from its git folder by plain reads; links and odd refs are not followed."""
    home = os.path.join(root, ".git")

    def read(*parts: str) -> str | None:
        path = os.path.join(home, *parts)
        try:
            if os.path.islink(path) or not os.path.isfile(path) or os.path.getsize(path) > 10_000_000:
                return None
            with open(path, encoding="utf-8", errors="replace") as f:
                return f.read()
        except OSError:
            return None

    if os.path.islink(home) or (head := read("HEAD")) is None:
        return "directory", None
    head = head.strip()
    sha = r"[0-9a-f]{40}(?:[0-9a-f]{24})?"
    if re.fullmatch(sha, head):
        return "git", head
    ref = head.removeprefix("ref:").strip()
    if not re.fullmatch(r"refs/[\w./@+-]+", ref) or ".." in ref:
        return "git", None
    if (own := read(*ref.split("/"))) and re.fullmatch(sha, own.strip()):
        return "git", own.strip()
    for line in (read("packed-refs") or "").split("\n"):
        if (m := re.fullmatch(rf"({sha}) (\S+)", line)) and m[2] == ref:
            return "git", m[1]
    return "git", None


def version_of(root: str) -> str:
    return (git_identity(root)[1] or "")[:12] or "unversioned"


def record_run(folder: str, command: str, facts: dict) -> None:
    """run.json: one entry for each command, replaced by the same command only; the one place that holds a time."""
    path = os.path.join(folder, "run.json")
    try:
        with open(path, encoding="utf-8") as f:
            runs = json.load(f)
    except FileNotFoundError:
        runs = {}
    runs[command] = facts | {"started_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(runs, f, indent=2, sort_keys=True)
    os.replace(path + ".new", path)


def archetypes(hits: DataFrame) -> DataFrame:
    """(archetype, signals): every archetype that a surface speaks for, and the core; none matched is a gap of its own."""
    known = F.create_map(*[F.lit(x) for pair in SIGNALS.items() for x in pair])
    found = hits.select(F.try_element_at(known, F.col("rule_id")).alias("archetype")).filter("archetype is not null").groupBy("archetype").agg(F.count("*").alias("signals"))
    every = hits.sparkSession.createDataFrame([("core", 0)], "archetype string, signals long").unionByName(found)
    return every


def report_order(findings: DataFrame) -> DataFrame:
    """(id, severity, cost, place): worst first, and of equal risk for its cost the cheapest fix first.

    findings has id, severity and cost (1 cheap, 2 some work, 3 a rebuild); a step of cost weighs as much as one of severity.
    """
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    scored = findings.withColumn("weight", rank - F.col("cost"))
    # places within a section of equal weight, so that no window spans the table
    sizes = scored.groupBy("weight").agg(F.count("*").alias("n"))
    above = sizes.alias("a").join(sizes.alias("b"), F.col("b.weight") > F.col("a.weight"), "left").groupBy(F.col("a.weight").alias("weight")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("weight").orderBy("cost", "id"))
    return scored.withColumn("own", own).join(above, "weight").select("id", "severity", "cost", (F.col("own") + F.col("before")).alias("place"))
