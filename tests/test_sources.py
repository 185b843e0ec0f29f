"""Trees with hostile entries, recon, ledgers on disk, streams."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import recon, review, sweep
from tessera.plans import rules as R
from tessera.sources import filesystem
from tessera.streaming import ledger


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "t"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("x")
    (root / "src" / "a.py").write_bytes(b"eval(x)\r\nprint(1)\r\n")
    (root / "é.md").write_text("ñ")
    (root / "blob.bin").write_bytes(bytes(range(32)) * 9)
    (root / "big.txt").write_text("y" * 3000)
    (root / "bad.txt").write_bytes(b"ok \xff\xfe")
    os.mkfifo(root / "pipe")
    (root / "out").symlink_to("/etc/passwd")
    (root / "loop").symlink_to(root / "loop")
    (root / "SECURITY.md").symlink_to("/etc/passwd")
    return str(root)


def test_walk(spark, tree):
    rows = {r["path"]: r for r in filesystem.walk(spark, tree, maxBytes="2000", filesPerTask="2").collect()}
    assert set(rows) == {"src/a.py", "é.md", "blob.bin", "big.txt", "bad.txt", "pipe", "out", "loop", "SECURITY.md"}
    assert rows["blob.bin"]["is_binary"] and rows["blob.bin"]["content"] is None
    assert not rows["big.txt"]["is_within_size_bound"] and rows["big.txt"]["sha256"] is None
    assert not rows["pipe"]["is_regular"]
    assert rows["out"]["escapes_root"] and rows["loop"]["escapes_root"] and rows["loop"]["is_symlink"]
    assert rows["bad.txt"]["content"] == "ok ��"
    assert filesystem.present(tree) == ["node_modules"]
    assert [p for p, _ in filesystem.listing(tree)] == sorted(rows)


def test_names_that_become_equal(tmp_path):
    (tmp_path / "é").write_text("1")
    (tmp_path / "é").write_text("2")
    with pytest.raises(filesystem.Refused):
        filesystem.listing(str(tmp_path))


def test_recon(spark, tree):
    inventory = filesystem.walk(spark, tree, maxBytes="2000")
    report = recon.recon(inventory, sweep.readable(inventory).select("path", "content"))
    row = report.first()
    assert row["files_total"] == 9 and not row["security_md"] and row["too_large"] == ["big.txt"]
    assert {(x["language"], x["files"], x["lines"]) for x in row["by_language"]} == {("python", 1, 2), ("markdown", 1, 1), ("text", 1, 1)}
    assert recon.verdict(report).first()[0] == 2
    assert any("big.txt" in g for g in recon.coverage_gaps(report).first()[0])


def test_ledger(spark, tree, tmp_path):
    inventory = filesystem.walk(spark, tree)
    hits = sweep.pattern_hits(sweep.readable(inventory), R.agentic())
    review.write_ledger(hits, str(tmp_path / "l"), "pattern")
    review.write_ledger(hits.withColumn("source", F.lit("surface")).limit(1), str(tmp_path / "l"), "surface")
    back = spark.read.parquet(str(tmp_path / "l"))
    assert back.filter("source = 'pattern'").count() == hits.count() and back.filter("source = 'surface'").count() == 1
    assert review.foreign(back).isEmpty()
    review.write_ledger(hits.limit(0), str(tmp_path / "l"), "pattern")
    assert {r["source"] for r in spark.read.parquet(str(tmp_path / "l")).select("source").collect()} == {"surface"}
    assert spark.range(1).select(review.version_key(F.lit("2026.9")) < review.version_key(F.lit("2026.10"))).first()[0]
    assert review.to_jsonl(hits, str(tmp_path / "l.jsonl")) == hits.count()
    with pytest.raises(ValueError):
        review.replace_block(back, "other", hits)


def test_stream_equals_batch(spark, tmp_path, data):
    files = spark.createDataFrame([("a.md", "10.0.0.1"), ("b.md", "a@b.cd\n10.0.0.1")], "path string, content string")
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    ledger.follow(stream, R.generic(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["id"] for r in sweep.pattern_hits(files, R.generic()).collect()}
    events = spark.read.parquet(f"{data}/events.parquet")
    assert ledger.windowed(events).agg({"n": "sum"}).first()[0] == events.count()
