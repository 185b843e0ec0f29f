"""What a target holds: counts by language, what was not read, entry points, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Files that show a security process, and suffixes of assets that hold no code.
SAST = [".github/workflows/codeql.yml", ".github/workflows/codeql.yaml", ".semgrep.yml", ".semgrep.yaml", ".bandit"]
TEST_FILE = r"(^|/)(test_[^/]+|[^/]+_test)\.[a-z]+$|(^|/)tests?/"
ASSETS = (".png .jpg .jpeg .gif .webp .bmp .ico .tiff .tif .woff .woff2 .ttf .otf .eot .mp3 .wav .ogg .flac .mp4 .m4a .mov .avi .webm .zip .gz .tgz .bz2 .xz .zst .7z .rar .tar .iso .img .dmg .pkg .deb .rpm .so .dylib .dll .exe .o .a .lib .class .jar .wasm .pyc .pyo .whl .bin .dat .db .sqlite .sqlite3 .pdf .pack .idx").split()
SHOWN = 5


def by_language(files: DataFrame) -> DataFrame:
    """Files and lines by recognised language; files (path, content) are readable text."""
    own = files.select(T.language_of(F.col("path")).alias("language"), F.size(T.split_lines(F.col("content"))).alias("lines"))
    return own.filter("language is not null").groupBy("language").agg(F.count("*").alias("files"), F.sum("lines").cast("long").alias("lines"))


def recon(inventory: DataFrame, contents: DataFrame) -> DataFrame:
    """One row: totals and sorted lists. inventory has the flags of a walk, contents (path, content) of what was read.

    Each list grows with the files it names: they are the report's own content.
    """
    listed = lambda cond: F.sort_array(F.coalesce(F.collect_list(F.when(cond, F.col("path"))), F.array().cast("array<string>")))
    found = F.expr("is_regular and not is_symlink")
    code = ~T.suffix(F.col("path")).isin(ASSETS)
    unread = (~F.col("is_readable") | ~F.col("is_regular") | ~F.col("is_within_size_bound") | F.col("is_binary")) & code
    top = inventory.agg(
        F.count("*").alias("files_total"),
        listed(F.col("is_binary")).alias("binary"),
        listed(~F.col("is_readable")).alias("unreadable"),
        listed(~F.col("is_regular")).alias("not_regular"),
        listed(~F.col("is_within_size_bound")).alias("too_large"),
        listed(unread).alias("unread_code"),
        listed(F.col("is_symlink")).alias("symlinks"),
        F.coalesce(F.max(found & (F.col("path") == "SECURITY.md")), F.lit(False)).alias("security_md"),
        F.coalesce(F.max(found & F.col("path").isin(".github/dependabot.yml", ".github/dependabot.yaml")), F.lit(False)).alias("dependabot"),
        F.coalesce(F.max(found & F.col("path").isin(SAST)), F.lit(False)).alias("sast_config"),
        F.count_if(F.col("path").rlike(TEST_FILE)).alias("test_files"),
        listed(found & F.startswith("path", F.lit(".github/workflows/")) & F.col("path").rlike(r"\.ya?ml$")).alias("workflows"),
    )
    lines = contents.agg(F.coalesce(F.sum(F.size(T.split_lines(F.col("content")))), F.lit(0)).cast("long").alias("loc_total"))
    languages = by_language(contents).agg(F.sort_array(F.collect_list(F.struct("language", "files", "lines"))).alias("by_language"))
    return top.crossJoin(lines).crossJoin(languages)  # one row each


def first_few(paths, shown: int = SHOWN):
    """`a, b, and N more` of an array column."""
    more = F.size(paths) - shown
    return F.concat(F.array_join(F.slice(paths, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(", and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def coverage_gaps(report: DataFrame) -> DataFrame:
    """(gaps): sentences on what the report's row says was not read."""
    said = [F.when(F.size(n) > 0, F.concat(F.size(n).cast("string"), F.lit(f" {what}: "), first_few(F.col(n)))) for n, what in (("unreadable", "could not be read"), ("not_regular", "not regular files"), ("too_large", "over the size bound"), ("unread_code", "may hold code and were not read"))]
    return report.select(F.filter(F.array(*said), lambda x: x.isNotNull()).alias("gaps"))


def gap(paths: DataFrame, before: str, after: str = "") -> DataFrame:
    """(gap): one sentence on paths (path) with their number and the first few by name, or no row where there are none.

    However many paths there are, only the first few of them meet in one task.
    """
    every = paths.select("path").distinct()
    few = every.orderBy("path").limit(SHOWN).agg(F.array_sort(F.collect_list("path")).alias("few"))
    count = every.agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > SHOWN, F.concat(F.lit(", and "), (F.col("n") - SHOWN).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    one = few.withColumn("k", F.lit(1)).join(count.withColumn("k", F.lit(1)), "k")
    return one.filter("n > 0").select(F.concat(F.col("n").cast("string"), F.lit(f" {before}: "), F.array_join("few", ", "), more, F.lit(after)).alias("gap"))


def verdict(report: DataFrame, manifests_unreadable: DataFrame | None = None) -> DataFrame:
    """(exit_code): 2 for a partial review, else 0.

    A review is partial where a file could not be read, where one that may hold code was not, or where a manifest
    (path) could not be understood, as the entry points it declares are then unknown.
    """
    partial = (F.size("unreadable") > 0) | (F.size("unread_code") > 0)
    if manifests_unreadable is None:
        return report.select(F.when(partial, 2).otherwise(0).alias("exit_code"))
    bad = manifests_unreadable.agg(F.count("*").alias("bad")).withColumn("k", F.lit(1))
    return report.withColumn("k", F.lit(1)).join(bad, "k").select(F.when(partial | (F.col("bad") > 0), 2).otherwise(0).alias("exit_code"))
