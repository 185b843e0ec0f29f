"""What a sweep over large tables rests on: literals that rules can't match without, work dealt over cores, windows hashed once."""

import hashlib
import re
import time
import unicodedata

import hashlib
import re
import time
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_rules import SAMPLES

from tessera import queries as Q
from tessera.functions import text as T
from tessera.operators import sweep
from tessera.plans import needs as N
from tessera.plans import rules as R
from tessera.sources import corpus as C

RULES = [*R.agentic(), *R.generic(), *R.kinds()]


def test_every_rule_but_one_needs_literals():
    assert [r.id for r in RULES if N.needs(r.condition) is None] == ["generic.opaque"]


@pytest.mark.parametrize(
    "condition, yes, no",
    [
        ("a(?:.b)?c", ["axbc", "ac"], ["ab"]), ("(?:ab|c?)d", ["abd", "d"], ["ab"]), ("(?:abc){2}d?", ["abcabc"], ["abd"]), ("(?:a|b)*", ["", "x"], []),
        ("[^a]x", ["bx"], ["b"]), ("(?:do|does)(?:[^\\n]{0,4})?n[o']?t\\s+ask", ["does n't ask", "do  NT ask"], ["do ask", "not ask"]), ("(?:a.|b)c", ["axc", "bc"], ["c", "ab"]),
        ("(?:.|b)+c", ["xc"], ["b"]), ("(ab)\\1", ["abab", ""], []), ("[[a]b]", ["", "x"], []), ("a(?=bc)b", ["abc"], ["ac"]), ("\\bé?s", ["ſ", "S"], ["é"]), ("kin", ["KıN", "Kİn"], ["kn"]),
    ],
)
def test_needs(condition, yes, no):
    assert N.held(pa.array(yes, pa.string()), N.needs(condition)).all()
    assert not N.held(pa.array(no, pa.string()), N.needs(condition)).any()


def test_letters_that_java_takes_for_others(spark):
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))
    letters = "abcdefghijklmnopqrstuvwxyz"
    found = spark.createDataFrame([(every,)], "x string").select(*[F.regexp_extract_all("x", F.lit("(?dUiu)" + c), F.lit(0)).alias(c) for c in letters]).first()
    for c in letters:
        assert N.held(pa.array(found[c]), ("has", c)).all(), c


def test_no_match_is_lost(spark):
    odd = [str, str.upper, *(lambda x, a=a, b=b: x.replace(a, b) for a, b in (("s", "ſ"), ("k", "K"), ("i", "ı"), ("i", "İ")))]
    rows = [(f"{n}/{k}/{path}", f"x\r\n{f(yes)}\n{f(no)}") for k, (path, yes, no) in SAMPLES.items() for n, f in enumerate(odd)] + [("none.md", "plain prose"), ("null.md", None)]
    rules = [*R.agentic(), *R.generic()]
    files = spark.createDataFrame(rows, "path string, content string")
    got = {(h["file"], h["rule_id"], h["line"]) for h in sweep.pattern_hits(files, rules).collect()}
    lines = sweep.lines_of(files)
    want = {(x["path"], r.id, x["line"]) for r in rules for x in lines.filter(sweep.applies(r, F.col("path")) & F.col("text").rlike(r.java)).collect()}
    assert got == want and len(want) > 100


def test_a_table_of_one_row_group_is_dealt_over_cores(spark, tmp_path):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit("-"), k.cast("string")), 256)))
    spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    busy = lambda files: files.groupBy(F.spark_partition_id()).count().count()
    assert busy(C.documents(spark, str(tmp_path))) == 1
    assert busy(C.documents(spark, str(tmp_path), even=True)) >= spark.sparkContext.defaultParallelism
    plan = Q._doc_hits(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_windows_agree_with_python(spark, tmp_path):
    lines = ["e\u0301 cafe\u0301", "plain", "", "\u0301starts with a mark", "\u212b \u1100\u1161", "é", "x" * 50]
    texts = [None, "", "\n", "\r\n\r", *(e.join(lines[(n + k) % 7] + str(k) for k in range(n)) + t for n in (1, 2, 20, 21, 22, 40, 41, 42, 43, 90) for e in ("\n", "\r\n", "\r") for t in ("", e))]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string()), "source": ["s"] * len(texts)}), f"{tmp_path}/documents.parquet")
    got = sorted((r["path"], r["line"], r["window_sha256"]) for r in Q.QUERIES["window_sha256"](spark, str(tmp_path)).collect())
    want = []
    for n, text in enumerate(texts):
        cut = re.split("\r\n|\r|\n", text or "")
        cut = cut[:-1] if cut[-1] == "" else cut
        for k in range(len(cut)):
            window = unicodedata.normalize("NFC", "\n".join(cut[max(0, k - 20) : k + 21]))
            want.append((f"docs/s/{n}.md", k + 1, hashlib.sha256(window.encode()).hexdigest()))
    assert got == sorted(want)


def test_windows_of_a_long_file(spark, tmp_path):
    line = "x" * 799
    spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(line + "\n"), 10_000).alias("text"), F.lit("s").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    found = Q.QUERIES["window_sha256"](spark, str(tmp_path)).groupBy("window_sha256").count().collect()
    want = {hashlib.sha256("\n".join([line] * n).encode()).hexdigest(): 2 if n < 41 else 10_000 - 40 for n in range(21, 42)}
    assert {r["window_sha256"]: r["count"] for r in found} == want


def test_python_gets_only_texts_that_nfc_may_change(spark, monkeypatch):
    def refuse(text: pd.Series) -> pd.Series:
        assert text.isna().all(), "a text that is NFC already"
        return text

    monkeypatch.setattr(T, "nfc", F.pandas_udf(refuse, "string"))
    files = spark.createDataFrame([("a.md", 'token = "abcdef"\nplain'), ("b.md", 'caf\u00e9\r\nsecret = "ghijkl"')], "path string, content string")
    assert files.select(T.window_sha(F.col("content")).alias("x")).distinct().count() == 2
    assert len(sweep.pattern_hits(files, R.generic()).collect()) == 2


def test_a_file_with_many_matching_lines(spark):
    n, began = 12_000, time.monotonic()
    text = F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.concat(F.lit("at 10.0.0.1 and 10.0.0.2 line "), k.cast("string"))))
    hits = sweep.pattern_hits(spark.range(1).select(F.lit("a.md").alias("path"), text.alias("content")), R.generic()).select("line", "window_sha256").collect()
    lines = [f"at 10.0.0.1 and 10.0.0.2 line {k}" for k in range(n)]
    shas = [hashlib.sha256("\n".join(lines[max(0, k - 20) : k + 21]).encode()).hexdigest() for k in range(n)]
    assert sorted((h["line"], h["window_sha256"]) for h in hits) == sorted((k + 1, x) for k, x in enumerate(shas) for _ in "ab")
    assert time.monotonic() - began < 45  # seconds; when each line's row held all matches, 8,000 lines took 39 and twice as many four times that
