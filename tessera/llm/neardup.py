"""Near duplicates of embeddings by NN-descent (operator 6).

Neighbour lists start from random-hyperplane cells and are refined by joins of neighbours' neighbours: two
vectors in one vector's neighbourhood are tried as neighbours of each other. Vectors whose whole list is over
the threshold are saturated; their lists are enlarged to all they can reach over close edges, compared
exactly in blocks. The recall of links is audited against brute force for a bounded set of vectors, and
more cells and rounds follow while it is under the target. If it stays under it, labels of up to `exact`
vectors are compared in full, and larger ones raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import mix
from .graph import components
from .jaccard import roots

EDGES = "u long, v long, sim float"
#: star: u and v are in one group of close vectors of a cell's part; such an edge is no place of a list.
STARRED = EDGES + ", star boolean"


def _matrix(column: pa.ChunkedArray, kind: str = "<f8") -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1) if raw else np.zeros((0, 1))


def units(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, label, x, y): the unit vector as bytes, in doubles and in floats, null where the row can have no link.

    Lists are found with floats, which is half of what is moved; links are decided in doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, short = [], []
            for value, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), strict=True):
                x = y = None
                if value and label is not None and None not in value:
                    a = np.array(value, np.float64)
                    if np.isfinite(a).all() and a.any():
                        a = a / np.abs(a).max()
                        a = a / np.linalg.norm(a)
                        x, y = a.tobytes(), a.astype("<f4").tobytes()
                out.append(x)
                short.append(y)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("uid", "vec_id", "label")), pa.array(out, pa.binary()), pa.array(short, pa.binary())], ["uid", "vec_id", "label", "x", "y"])

    own = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return cut(own.mapInArrow(run, "uid long, vec_id long, label string, x binary, y binary"))


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each list, and all stars where there are any."""
    star = ["star"] if "star" in edges.columns else []
    place = Window.partitionBy("u", *star).orderBy(F.desc("sim"), "v")
    kept = (F.col("place") <= k) | F.col("star") if star else F.col("place") <= k
    return edges.groupBy("u", "v", *star).agg(F.max("sim").alias("sim")).withColumn("place", F.row_number().over(place)).filter(kept).select("u", "v", "sim", *star)


def equals(base: DataFrame) -> DataFrame:
    """(a, b): each vector that has equals of its label, with the first of them."""
    own = base.select("uid", "label", F.xxhash64("x").alias("h"), F.length("x").alias("bytes"))
    first = own.groupBy("label", "h", "bytes").agg(F.min("uid").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return own.join(first, ["label", "h", "bytes"]).filter("uid <> b").select(F.col("uid").alias("a"), "b")


def cells(base: DataFrame, trees: int, k: int, cell: int, seed: int, close: float) -> DataFrame:
    """First lists: the nearest within cells of random hyperplanes, of some `cell` vectors of one label.

    A cell that holds more than four times as many is dealt into parts by a hash that has the tree and the seed
    in it, so a vector meets others each time. All vectors of a part that reach each other over cosines of at
    least `close` have an edge to the first of them (star), however full their lists are.
    """
    sizes = base.groupBy("label", F.length("x").alias("bytes")).agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            for wide in np.unique(width := batch.column("bytes").to_numpy()):
                own = batch.filter(pa.array(width == wide))
                x = _matrix(own.column("x"))
                depth = np.clip(np.ceil(np.log2(np.maximum(n[width == wide] / cell, 1))), 0, 60).astype(int)
                for t in range(trees):
                    rng = np.random.default_rng([seed, t])
                    bits = x @ rng.standard_normal((x.shape[1], max(1, int(depth.max())))) > 0
                    key = np.full(len(x), t + 1, np.uint64)
                    for d in range(int(depth.max())):
                        key = np.where(d < depth, mix(key, bits[:, d].astype(np.uint64) + np.uint64(1)), key)
                    yield pa.RecordBatch.from_arrays([own.column("uid"), own.column("label"), pa.array(key.view(np.int64)), own.column("y")], ["uid", "label", "key", "y"])

    spread = base.withColumn("bytes", F.length("x")).join(sizes, ["label", "bytes"]).mapInArrow(run, "uid long, label string, key long, y binary")
    spread = spread.withColumn("key", F.xxhash64("label", "key", F.length("y"), F.lit(seed)))
    counts = spread.groupBy("key").agg(F.count("*").alias("n"))
    dealt = spread.join(counts, "key").select("uid", "y", F.xxhash64("key", F.pmod(F.xxhash64("uid", "key"), F.ceil(F.col("n") / (4 * cell)))).alias("key"))

    def nearest(part: pa.Table) -> pa.Table:
        order = np.argsort(key := part.column("key").to_numpy(), kind="stable")
        uid, raw = part.column("uid").to_numpy()[order], part.column("y").to_pylist()
        edge = np.append(np.flatnonzero(np.diff(key[order], prepend=key[order][0] - 1)), len(order))
        out, stars = [], []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a > 1:
                x = np.frombuffer(b"".join(raw[i] for i in order[a:b]), "<f4").reshape(b - a, -1)
                sim = x @ x.T
                root = roots(b - a, *np.nonzero(np.triu(sim >= close, 1)))
                own = np.flatnonzero(root != np.arange(b - a))
                stars.append((uid[a:b][own], uid[a:b][root[own]], np.ones(len(own), np.float32)))
                out.append(_top(uid[a:b], sim, k))
        lists, joined = _edges(out), _edges(stars)
        mark = np.arange(len(lists) + len(joined)) >= len(lists)
        return pa.concat_tables([lists, joined]).append_column("star", pa.array(mark))

    return dealt.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(_bins(dealt)))).groupBy("bin").applyInArrow(nearest, STARRED)


def _bins(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _top(uid: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    np.fill_diagonal(sim, -2)
    k = min(k, len(uid) - 1)
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.repeat(uid, k), uid[near].ravel(), np.take_along_axis(sim, near, 1).ravel()


def _edges(out: list) -> pa.Table:
    u, v, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "sim": pa.array(s.astype(np.float32), pa.float32())})


def descend(base: DataFrame, lists: DataFrame, k: int, salt: int) -> DataFrame:
    """One round: in the neighbourhood of each vector (its list, and up to k that list it), all are tried with each other.

    Each member gets the k nearest of a neighbourhood as candidates, and keeps the k nearest of all.
    """
    back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"))
    place = Window.partitionBy("u").orderBy(F.xxhash64("v", F.lit(salt)), "v")
    back = back.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).drop("place")
    around = lists.select("u", "v").unionByName(back).distinct()
    worst = lists.groupBy("u").agg(F.min("sim").alias("least"), F.count("*").alias("held"))
    members = base.select(F.col("uid").alias("v"), "y").join(worst.select(F.col("u").alias("v"), F.when(F.col("held") >= k, F.col("least")).otherwise(F.lit(-2.0)).cast("float").alias("least")), "v")

    def local(part: pa.Table) -> pa.Table:
        order = np.argsort(pivot := part.column("u").to_numpy(), kind="stable")
        v, least, raw = part.column("v").to_numpy()[order], part.column("least").to_numpy()[order], part.column("y").to_pylist()
        pivot = pivot[order]
        edge = np.append(np.flatnonzero(np.diff(pivot, prepend=pivot[0] - 1)), len(order))
        out = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a > 1:
                x = np.frombuffer(b"".join(raw[i] for i in order[a:b]), "<f4").reshape(b - a, -1)
                i, j, s = _top(np.arange(b - a), x @ x.T, k)
                better = s > least[a:b][i]
                out.append((v[a:b][i[better]], v[a:b][j[better]], s[better]))
        return _edges(out)

    tried = around.join(members, "v")
    found = tried.withColumn("bin", F.pmod(F.xxhash64("u", F.lit(1)), F.lit(_bins(tried)))).groupBy("bin").applyInArrow(local, EDGES)
    return cut(_best(lists.unionByName(found), k))


def _split(part: pa.Table) -> list[np.ndarray]:
    key = np.stack([part.column(n).to_numpy().astype(np.int64) for n in ("label", "lo", "hi")], 1)
    which = np.unique(key, axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(which, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(which[order])) + 1)


def verify(base: DataFrame, groups: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """(u, root, n): exact links in doubles within each group, counted by vector, from pairs of blocks of its members."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("m"))
    own = groups.join(sizes, "label").join(base.select(F.col("uid").alias("node"), "x"), "node")
    cuts = F.ceil(F.col("m") / block).cast("int")
    own = own.withColumn("spot", F.pmod(F.xxhash64("node"), cuts).cast("int")).withColumn("cuts", cuts)
    pairs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least(k, F.col("spot")).alias("lo"), F.greatest(k, F.col("spot")).alias("hi")))
    dealt = own.select("node", "label", "spot", "x", F.explode(pairs).alias("pair")).select("node", "label", "spot", "x", "pair.lo", "pair.hi")

    def links(part: pa.Table) -> pa.Table:
        place = _split(part)
        node, count, root = [], [], []
        label, lo, hi, spot = (part.column(n).to_numpy() for n in ("label", "lo", "hi", "spot"))
        uid, raw = part.column("node").to_numpy(), part.column("x").to_pylist()
        for rows in place:
            rows = rows[np.argsort(uid[rows])]
            x = np.frombuffer(b"".join(raw[i] for i in rows), "<f8").reshape(len(rows), -1)
            same = lo[rows[0]] == hi[rows[0]]
            a = np.flatnonzero(spot[rows] == lo[rows[0]])
            b = a if same else np.flatnonzero(spot[rows] == hi[rows[0]])
            close = x[a] @ x[b].T >= threshold
            if same:
                close = np.triu(close, 1)
            i, j = np.nonzero(close)
            i, j = a[i], b[j]
            own_root = roots(len(rows), i, j)
            node.append(uid[rows])
            count.append(np.bincount(np.concatenate([i, j]), minlength=len(rows)))
            root.append(uid[rows][own_root])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"u": pa.array(cat(node), pa.int64()), "root": pa.array(cat(root), pa.int64()), "n": pa.array(cat(count).astype(np.int64))})

    # small groups share a bin, the pairs of blocks of a large one have bins of their own
    small = F.pmod(F.xxhash64("label"), F.lit(_bins(dealt)))
    binned = dealt.withColumn("bin", F.when((F.col("lo") == 0) & (F.col("hi") == 0), small).otherwise(F.xxhash64("label", "lo", "hi")))
    return binned.groupBy("bin").applyInArrow(links, "u long, root long, n long").filter("n > 0")


def audit(base: DataFrame, links: DataFrame, threshold: float, most: int = 512, seed: int = 5) -> tuple[float, int]:
    """(recall, vectors with links among those tried) of at most twice `most` vectors against brute force over all.

    The recall is the mean, over vectors that have links, of the share of a vector's links that was found: a
    vector with many links counts as much as one with few. Half of the vectors are those with the least hashes
    among all, which finds vectors whose links were all missed, half those among the vectors with links.
    """
    order = F.xxhash64("uid", F.lit(seed))
    wanted = base.select("uid", "label", "x")
    linked = wanted.join(links.select(F.col("u").alias("uid")), "uid", "left_semi")
    drawn = {r["uid"]: r for df in (wanted, linked) for r in df.orderBy(order, "uid").limit(most).collect()}
    if not drawn:
        return 1.0, 0
    sample = sorted(drawn.values(), key=lambda r: r["uid"])
    uid = np.array([r["uid"] for r in sample])
    sets: dict[tuple, list[int]] = {}
    for k, r in enumerate(sample):
        sets.setdefault((r["label"], len(r["x"])), []).append(k)
    x = {key: np.stack([np.frombuffer(sample[k]["x"], "<f8") for k in own]) for key, own in sets.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(uid), np.int64)
        for batch in batches:
            own: dict[tuple, list[int]] = {}
            raw, ids = batch.column("x").to_pylist(), batch.column("uid").to_numpy()
            for i, (label, value) in enumerate(zip(batch.column("label").to_pylist(), raw, strict=True)):
                own.setdefault((label, len(value)), []).append(i)
            for key in own.keys() & sets.keys():
                there = np.frombuffer(b"".join(raw[i] for i in own[key]), "<f8").reshape(len(own[key]), -1)
                close = (x[key] @ there.T >= threshold) & (uid[sets[key]][:, None] != ids[own[key]][None, :])
                total[sets[key]] += close.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(total)], ["u", "all"])

    true = wanted.mapInArrow(run, "u long, all long").groupBy("u").agg(F.sum("all").alias("all")).filter("all > 0")
    row = true.join(links, "u", "left").agg(F.count("*").alias("m"), F.avg(F.least("all", F.coalesce("n", F.lit(0))) / F.col("all")).alias("recall")).first()
    return (row["recall"] if row["m"] else 1.0), row["m"]


def full(base: DataFrame, exact: int) -> DataFrame:
    """(node, label): one group of each label and length, for verify() to compare all of it; an error for more than `exact` vectors."""
    first = base.groupBy(F.col("label").alias("name"), F.length("x").alias("bytes")).agg(F.min("uid").alias("label"), F.count("*").alias("n"))
    largest = first.agg(F.max("n")).first()[0] or 0
    if largest > exact:
        raise RuntimeError(f"near duplicates: recall under the target, and {largest} vectors of one label are too many to compare in full ({exact})")
    return base.select(F.col("uid").alias("node"), F.col("label").alias("name"), F.length("x").alias("bytes")).join(first, ["name", "bytes"]).select("node", "label")


def near(vectors: DataFrame, threshold: float = 0.98, k: int = 10, trees: int = 6, cell: int = 64, rounds: int = 6, target: float = 0.98, tries: int = 3, exact: int = 200_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link when labels are equal and not null and the cosine, in doubles, is at least the threshold; rows
    whose vector is null, empty, zero or holds null or non-finite components, and rows of different length,
    link with nothing. Rows with equal vec_id are rows of their own. component_id is the least vec_id
    reachable over links, kept says whether it is the row's own. Where the audited recall stays under the target,
    labels of up to `exact` vectors are compared in full and larger ones raise an error. Descent ends with the first
    round that adds no close edge to the lists, after `rounds` at most; other columns are ignored, an empty table gives no rows.
    """
    every = units(vectors)
    base = every.filter("x is not null")
    close = threshold - 1e-4
    lists, joined = None, equals(base)
    for step in range(tries):
        start = cut(_best(cells(base, trees, k, cell, 17 + step, close), k))
        joined = joined.unionByName(start.filter("star").select(F.col("u").alias("a"), F.col("v").alias("b")))
        start = start.filter("not star").drop("star")
        lists = start if lists is None else cut(_best(lists.unionByName(start), k))
        found = lists.filter(F.col("sim") >= close).count()
        for turn in range(rounds):
            lists = descend(base, lists, k, turn)
            before, found = found, lists.filter(F.col("sim") >= close).count()
            if found == before:
                break
        groups = cut(components(lists.filter(F.col("sim") >= close).select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(joined)))
        checked = cut(verify(base, groups, threshold))
        links = cut(checked.groupBy("u").agg(F.sum("n").alias("n")))
        recall, _ = audit(base, links, threshold)
        if recall >= target:
            break
    else:
        checked = cut(verify(base, full(base, exact), threshold))
        links = cut(checked.groupBy("u").agg(F.sum("n").alias("n")))
    final = components(checked.select(F.col("u").alias("a"), F.col("root").alias("b")))
    ids = every.select(F.col("uid").alias("node"), "vec_id")
    named = final.join(ids, "node")
    least = named.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    known = named.join(least, "label").join(links.withColumnRenamed("u", "node"), "node").select("node", "component_id", F.col("n").alias("n_links"))
    return ids.join(known, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
