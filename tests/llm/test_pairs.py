"""Near duplicates and packing where the simple way fails: planted links, hot tokens, bins that best fit leaves."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import graph, jaccard, neardup, packing


def _links(sets, similarity=0.8):
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= similarity * len(a | b) - 1e-9}


def test_jaccard_recall_and_hot_tokens(spark):
    # 700 texts share most of a passage, so that thousands meet in nodes; pairs at just over and under the threshold
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 10**7)}"
    shared = [word() for _ in range(60)]
    texts = [" ".join([*shared, *(word() for _ in range(int(rng.integers(14, 60))))]) for _ in range(700)]
    for edits in rng.integers(1, 3, 300).tolist():
        own = [word() for _ in range(110)]
        texts.append(" ".join(own))
        for at in rng.choice(110, edits, replace=False):
            own[at] = word()
        texts.append(" ".join(own))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    want = Counter(i for pair in _links(sets) for i in pair)
    got = {r["doc_id"]: r["n_links"] for r in jaccard.join(frame).collect()}
    assert sum(got.values()) <= sum(want.values())
    assert sum(got.values()) >= 0.999 * sum(want.values()) > 500
    small = jaccard.walk(frame.withColumn("row", F.lit(None).cast("long")), jaccard.trees_for(0.8, 0.9999))
    # nodes over the block size: the same sets are joined as where all fit one block
    sets = jaccard.cut(small.select("node", "second", "fourth", "sketch"))
    joined = [{(r["node"], r["label"]) for r in graph.components(jaccard.meetings(sets, block=b)).collect()} for b in (16, 4096)]
    assert joined[0] == joined[1] and len(joined[0]) > 500


def test_finished_shuffles_are_removed(spark):
    import time

    from tessera.session import cut

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for k in range(found.size()) if (n := found.apply(k).getName()).startswith("shuffle_")} if (found := disk.getAllFiles()) else set()
    before = files()
    own = cut(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("id")).count())
    first = files() - before
    assert first
    for _ in range(4):  # a few steps later they are gone
        cut(own.filter("id > 1"))
        time.sleep(0.5)
    assert not files() & first


def test_jaccard_clashing_columns_and_nulls(spark):
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(None, base), (None, base), (None, "other words " + base), (5, None), (6, ""), (7, base + " end"), (7, base + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("mine")).withColumn("label", F.lit("x"))
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["_row"]) for r in kept.collect()) == [(5, "mine"), (6, "mine"), (7, "mine")]
    found = Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard.join(docs).collect())
    assert found == Counter({(None, 7, 2, 1): 2, (None, 7, 2, 0): 1, (5, 5, 0, 0): 1, (6, 6, 0, 0): 1, (7, 7, 2, 1): 2})


def _near(spark, x, labels, **how):
    rows = [(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("uid", F.lit("mine")).withColumn("sim", F.lit(0))
    return {r["vec_id"]: r["n_links"] for r in neardup.near(frame, **how).collect()}


def _brute(x, labels, threshold=0.98):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return ((u @ u.T >= threshold) & (np.array(labels)[:, None] == np.array(labels)[None, :])).sum(1) - 1


def test_neardup_planted_cosines(spark):
    # pairs at chosen cosines around the threshold among 1,500 others, and families of more than four cells
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 24))
    for k, cosine in enumerate([0.979, 0.9799999, 0.9800001, 0.981, 0.999] * 20):
        a = x[2 * k] / np.linalg.norm(x[2 * k])
        b = rng.normal(size=24)
        b -= a * (a @ b)
        x[2 * k + 1] = a * cosine + b / np.linalg.norm(b) * np.sqrt(1 - cosine**2)
    family = rng.normal(size=(2, 24)).repeat(300, 0) + rng.normal(size=(600, 24)) * 0.1
    x, labels = np.vstack([x, family]), [0] * 1500 + [0] * 300 + [1] * 300
    got, want = _near(spark, x, labels), _brute(x, labels)
    assert [got[i] for i in range(200)] == want[:200].tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 1, 1] * 20
    assert sum(got.values()) >= 0.999 * want.sum() and all(got[i] <= n for i, n in enumerate(want))


def test_descent_finds_what_cells_miss(spark):
    # two trees of small cells part many close vectors; their neighbours' neighbours bring them together again
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 16)).repeat(20, 0) + rng.normal(size=(1200, 16)) * 0.12
    labels, want = [0] * 1200, _brute(x, [0] * 1200).sum()
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)]
    base = neardup.units(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    first = neardup.cut(neardup._best(neardup.cells(base, 2, 20, 16, 17, 2.0), 20).filter("not star").drop("star"))
    close = lambda df: df.filter("sim >= 0.98").count()
    after = neardup.descend(base, first, 20, 0)
    assert close(after) > 1.05 * close(first)
    assert sum(_near(spark, x, labels).values()) >= 0.98 * want


def test_packing_search_empties_bins(spark):
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(200, 700, 3000))[::-1]
    plain = packing.best_fit(lengths.tolist(), 1024)
    rows = packing.pack(spark.createDataFrame([(i, 0, 0, int(n), 0, i, None) for i, n in enumerate(lengths)], packing.PIECES)).collect()
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert len(rows) == 3000 and max(fill.values()) <= 1024
    assert -(-int(lengths.sum()) // 1024) <= len(fill) < len(plain) - 5


@pytest.mark.parametrize("seed", range(4))
def test_packing_exchange_is_the_best(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 40, 24)
    bins, most = [list(range(k, 24, 6)) for k in range(6)], int(max(lengths[list(range(k, 24, 6))].sum() for k in range(6))) + 9
    fill = [int(lengths[b].sum()) for b in bins]
    donor = int(np.argmin(fill))
    others = [k for k in range(6) if k != donor]
    best = 0
    for a in others:
        for give in [[], *([i] for i in bins[a])]:
            for take in [[i] for i in bins[donor]] + [[i, j] for i in bins[donor] for j in bins[donor] if i < j]:
                moved = int(lengths[take].sum()) - int(lengths[give].sum() if give else 0)
                if fill[a] + moved <= most and fill[a] + moved > fill[donor]:
                    best = max(best, moved)
    step = packing._exchange(lengths, bins, fill, donor, others, most)
    assert (0 if step is None else int(lengths[step[2]].sum()) - int(lengths[step[1]].sum() if step[1] else 0)) == best
