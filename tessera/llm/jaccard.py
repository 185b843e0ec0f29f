"""Near duplicates on word shingles by a chosen-path join (operator 2).

Texts with equal shingle sets are one class from the start. Every set walks down a few random trees: a node
of a tree picks two tokens of the set's minhash signature, and the set goes on to the children that these
tokens' values name, so sets meet in a node through tokens they share. Nodes that few sets reach are done;
sets of larger nodes go two levels deeper, again and again, until their nodes are small or hold close copies that no
token parts. Sets of a node are held against each other, in blocks where there are many. Two sets of similarity s stay together in a tree with probability
q = 1 - (1 - s q)^2; trees are repeated until 1 - (1 - q)^trees passes the target recall. Sets that meet are
joined into groups, each group is compared exactly, in blocks where it is large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import column_ids, grouped, mapped, mix, slices
from .graph import components

TOKENS = 64
#: Nodes of more than SMALL sets are split while that parts them: a node below one keeps less than SHRINK of it.
SMALL, SHRINK = 64, 0.5
#: A node of which this share agrees with its least set holds close copies: splitting it would only repeat them in each child.
COPIES = 0.9
#: Of TOKENS bytes of two sketches, so many agree at least where sets are tried: 51 are expected at a similarity of 0.8,
#: with a deviation of 3.2.
AGREE = 34


def trees_for(similarity: float, recall: float) -> int:
    q = 1.0
    for _ in range(60):
        q = 1 - (1 - similarity * q) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def shingles(texts: list[str], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct runs of `words` lower-cased words, and bounds; a shorter text is one run."""
    flat: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = text.lower().encode().split()
        counts[k] = len(own)
        flat += own
    if not flat:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    encoded = pa.array(flat, pa.binary()).dictionary_encode()
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in encoded.dictionary.to_pylist()), np.uint64, len(encoded.dictionary))[encoded.indices.to_numpy()]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    runs = [hashed]
    value = hashed
    n = len(hashed)
    for k in range(1, words):
        value = mix(value[: n - k], hashed[k:]) if n > k else value[:0]
        runs.append(value)
    out, bounds = [], [0]
    for k, c in enumerate(counts.tolist()):
        own = runs[min(words, c) - 1][offsets[k] : offsets[k] + max(1, c - words + 1)] if c else hashed[:0]
        own = np.unique(own)
        out.append(own)
        bounds.append(bounds[-1] + len(own))
    return np.concatenate(out), np.array(bounds)


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """TOKENS minhash values of each non-empty set."""
    rng = np.random.default_rng(20)
    out = np.empty((len(bounds) - 1, TOKENS), np.uint64)
    part = np.empty_like(flat)
    for t in range(TOKENS):
        with np.errstate(over="ignore"):
            np.multiply(flat, rng.integers(1, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1), out=part)
        out[:, t] = np.minimum.reduceat(part, bounds[:-1])
    return out


def paths(tokens: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the second level (4 a tree) and of the fourth (16 a tree) that each set reaches."""
    rows = np.arange(len(tokens))
    second, fourth = [], []
    for tree in range(trees):
        level = [np.full(len(tokens), tree + 1, np.uint64)]
        for depth in range(1, 5):
            below = []
            for node in level:
                for child in (1, 2):
                    pick = (mix(node, child) % np.uint64(TOKENS)).astype(np.int64)
                    below.append(mix(mix(node, pick + 1), tokens[rows, pick]))
            level = below
            if depth == 2:
                second += level
        fourth += level
    return np.stack(second, 1), np.stack(fourth, 1)


def walk(docs: DataFrame, trees: int) -> DataFrame:
    """(doc_id, row, said, node, second, fourth, sketch) of every row; node is a hash of the shingle set, null for a text
    without words, said a hash of the text.

    row is a column of docs, or null where docs has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "text"):
            ids, known = column_ids(table, "doc_id")
            flat, bounds = shingles([x or "" for x in table.column("text").to_pylist()])
            sizes = np.diff(bounds)
            some = sizes > 0
            nodes = np.zeros(len(ids), np.int64)
            nodes[some] = [np.int64(np.uint64(xxhash.xxh64_intdigest(flat[a:b].tobytes())).view(np.int64)) for a, b in zip(bounds[:-1][some], bounds[1:][some], strict=True)]
            lists = []
            short = np.append(bounds[:-1][some], len(flat))
            tokens = signatures(flat, short) if some.any() else np.zeros((0, TOKENS), np.uint64)
            both = paths(tokens, trees)
            low = iter((mix(tokens, 1) & np.uint64(255)).astype(np.uint8))
            sketches = [next(low).tobytes() if x else None for x in some]
            for part in both:
                edges = np.concatenate([[0], np.cumsum(some * part.shape[1])]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(part.view(np.int64).ravel())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), table.column("row").combine_chunks(), table.column("said").combine_chunks(), pa.array(nodes, mask=~some), *lists, pa.array(sketches, pa.binary())], ["doc_id", "row", "said", "node", "second", "fourth", "sketch"])

    return docs.withColumn("said", F.xxhash64("text")).mapInArrow(mapped(run), "doc_id long, row long, said long, node long, second array<long>, fourth array<long>, sketch binary")


def below(path, sketch, levels: int = 2):
    """The 2 ** levels nodes under a node: each level picks a token by the node, and goes where its byte in the sketch says."""
    nodes = F.array(path)
    for _ in range(levels):
        nodes = F.flatten(F.transform(nodes, lambda x: F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.xxhash64(x, k, F.substring(sketch, F.pmod(F.xxhash64(x, k), F.lit(TOKENS)).cast("int") + 1, F.lit(1))))))
    return nodes


def meetings(sets: DataFrame, block: int = 512, levels: int = 12) -> DataFrame:
    """Edges (a, b) that join sets which meet in a tree node and whose sketches agree.

    Of a node's pairs only what joins them is kept, not each pair. Of a node with more than `block` sets, where splitting
    doesn't part them, nearly all are close copies, or after `levels` levels, each is held against the least one, and
    those that don't agree with it against all, in pairs of blocks with a task of their own.
    """
    agrees = F.size(F.filter(F.sequence(F.lit(1), F.lit(TOKENS)), lambda i: F.substring("sketch", i, F.lit(1)) == F.substring("first", i, F.lit(1)))) >= AGREE

    def against(rows: DataFrame) -> DataFrame:
        """rows with their sketch and other: whether they don't agree with the least set of their node."""
        firsts = rows.select("b").distinct().join(sets.select(F.col("node").alias("b"), F.col("sketch").alias("first")), "b")
        # many rows may have one first set: they are spread, and it is repeated (nodes here have more than SMALL sets)
        firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SMALL // 2 - 1))))
        salted = rows.join(sets.select("node", "sketch"), "node").withColumn("salt", F.pmod(F.xxhash64("node", "path"), F.lit(SMALL // 2)).cast("int"))
        return salted.join(firsts, ["b", "salt"]).withColumn("other", ~agrees).drop("first", "salt")

    level = sets.select("node", F.posexplode("second").alias("pos", "path")).withColumn("up", F.lit(None).cast("long"))
    done, depth = [], 2
    while True:
        sizes = level.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("b"), F.first("up").alias("up")).filter("n > 1")
        ready = (F.col("n") <= SMALL) | F.coalesce(F.col("n") > SHRINK * F.col("up"), F.lit(False)) | F.lit(depth >= levels)
        met = cut(level.drop("up").join(sizes.select("path", "n", "b", ready.alias("ready")), "path"))
        done.append(met.filter("ready").select("node", "path", "n", "b"))
        deep = met.filter("not ready")
        if deep.isEmpty():
            break
        copies = cut(against(deep).groupBy("path").agg(F.avg((~F.col("other")).cast("int")).alias("share")).filter(F.col("share") >= COPIES).select("path"))
        done.append(deep.join(copies, "path", "left_semi").select("node", "path", "n", "b"))
        deep = deep.join(copies, "path", "left_anti")
        if deep.isEmpty():
            break
        if depth == 2:  # a node at place i of the second level has places 4i to 4i+3 of the fourth below it
            nodes = F.slice("fourth", F.col("pos") * 4 + 1, 4)
        else:
            nodes = below(F.col("path"), F.col("sketch"))
        level = deep.join(sets.select("node", "fourth", "sketch"), "node").select("node", F.lit(0).alias("pos"), F.explode(nodes).alias("path"), F.col("n").alias("up"))
        depth += 2
    bins = 8 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tried = done[0]
    for more in done[1:]:
        tried = tried.unionByName(more)
    # small nodes share a bin, and so a call
    whole = tried.filter(F.col("n") <= block).select("node", "path", F.pmod(F.xxhash64("path"), F.lit(bins)).alias("bin")).join(sets.select("node", "sketch"), "node")
    large = cut(against(tried.filter(F.col("n") > block)))
    stars = large.filter("not other").select(F.col("node").alias("a"), "b")
    others = large.filter("other").groupBy("path").agg(F.count("*").alias("m"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    spot = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), blocks(n)).cast("int")
    kept = large.join(others, "path")
    ours = kept.filter("other").withColumn("row", spot("m", 3)).withColumn("column", F.explode(F.sequence(F.lit(0), blocks("n") - 1))).withColumn("asks", F.lit(True))
    all_of = kept.withColumn("column", spot("n", 2)).withColumn("row", F.explode(F.sequence(F.lit(0), blocks("m") - 1))).withColumn("asks", F.lit(False))
    pairs = ours.unionByName(all_of).select("node", "sketch", "other", "asks", F.xxhash64("path", "row", "column").alias("bin"))

    def apart(part: pa.Table) -> pa.Table:
        node, other, asks = (part.column(n).to_numpy() for n in ("node", "other", "asks"))
        sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)
        mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        loose = other[theirs]
        i, j = [], []
        for k in mine.tolist():
            close = (sketch[theirs] == sketch[k]).sum(1) >= AGREE
            tied = theirs[close & ~loose][:1]  # all of these are joined with the least one already
            hit = np.concatenate([tied, theirs[close & loose]])
            i.append(np.full(len(hit), k))
            j.append(hit)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        root = roots(len(node), cat(i), cat(j))
        moved = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": pa.array(node[moved], pa.int64()), "b": pa.array(node[root[moved]], pa.int64())})

    def near(part: pa.Table) -> pa.Table:
        order = np.argsort(path := part.column("path").to_numpy(), kind="stable")
        node, sketch = part.column("node").to_numpy()[order], np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)[order]
        edge = np.append(np.flatnonzero(np.diff(path[order], prepend=path[order][0] - 1)), len(order))
        size = np.diff(edge)
        first = edge[:-1][size == 2]
        close = (sketch[first] == sketch[first + 1]).sum(1) >= AGREE
        a, b = [node[first[close]]], [node[first[close] + 1]]
        for lo, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = sketch[lo : lo + n]
            i, j = np.nonzero(np.stack([(own == x).sum(1) >= AGREE for x in own]))
            if len(i):
                root = roots(n, i, j)
                other = np.flatnonzero(root != np.arange(n))
                a.append(node[lo : lo + n][other])
                b.append(node[lo : lo + n][root[other]])
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    close = whole.groupBy("bin").applyInArrow(near, "a long, b long").unionByName(stars).unionByName(pairs.groupBy("bin").applyInArrow(apart, "a long, b long"))
    return close.filter("a <> b").distinct()


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs at or over the similarity: within left (i < j), or of left with right."""
    every = left + (right or [])
    sizes = np.array([len(x) for x in every])
    flat = np.unique(np.concatenate(every), return_inverse=True)[1]
    doc = np.repeat(np.arange(len(every)), sizes)
    uses = np.bincount(flat)
    live = uses[flat] > 1
    column = np.unique(flat[live], return_inverse=True)[1]
    doc = doc[live]
    n, m = len(left), len(every)
    inter = np.zeros((n, m), np.float32)
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    width = 4096
    for lo in range(0, int(column.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        dense = np.zeros((m, width), np.float32)
        dense[doc[a:b], column[a:b] - lo] = 1
        inter += dense[:n] @ dense.T
    close = inter >= similarity * (sizes[:n, None] + sizes[None, :] - inter) - 1e-4
    if right is None:
        return np.nonzero(np.triu(close, 1))
    i, j = np.nonzero(close[:, n:])
    return i, j


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least place reachable from each place over pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def join(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9999, block: int = 512) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every row.

    class_id is the least doc_id that links of similarity or more reach; n_links counts the different shingle
    sets linked directly, n_copies the other rows with the same set. A text without words links with nothing:
    its class is its own doc_id. Repeated rows are copies; other columns are ignored. A row whose doc_id is
    null belongs to its class; a class of such rows only has a null id. An empty
    table gives no rows.
    """
    return _classes(docs, None, similarity, recall, block).select("doc_id", "class_id", "n_links", "n_copies")


def first_of_each(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9999, block: int = 512) -> DataFrame:
    """One row of each class of join(), with all its columns: that with the least doc_id (null last), of equal ones the first.

    Rows without words are all kept. docs is read twice and must give its rows in the same partitions, as files do.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    marked = docs.withColumn(row, F.monotonically_increasing_id())
    found = _classes(marked, row, similarity, recall, block)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    best = found.filter("label is not null").groupBy("label").agg(F.min(order).alias("best")).select(F.col("best.row").alias(row))
    kept = best.unionByName(found.filter("label is null").select(F.col("row").alias(row)))
    return marked.join(kept, row, "left_semi").drop(row)


def _classes(docs: DataFrame, row: str | None, similarity: float, recall: float, block: int) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(row) if row else F.lit(None)).cast("long").alias("row"))
    walked = cut(walk(own, trees_for(similarity, recall)))
    worded = walked.filter("node is not null")
    # a set's text is read again from one row, named by its id and the hash of its text: a null or repeated id is no hot key
    spot = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("said"))
    sets = cut(worded.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(spot).alias("at"), F.count("*").alias("n"), F.first("second").alias("second"), F.first("fourth").alias("fourth"), F.first("sketch").alias("sketch")))
    groups = components(meetings(sets))  # node, label
    sizes = groups.groupBy("label").agg(F.count("*").alias("m"))
    chosen = cut(groups.join(sizes, "label").join(sets.select("node", F.col("at.said").alias("said"), F.coalesce("at.id", F.lit(0).cast("long")).alias("id"), F.col("at.none").alias("none")), "node"))
    named = own.select(F.xxhash64("text").alias("said"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("none"), "text")
    text = named.join(chosen, ["said", "id", "none"]).groupBy("node", "label", "m").agg(F.first("text").alias("text"))
    cuts = F.ceil(F.col("m") / block).cast("int")
    spot = F.pmod(F.xxhash64("node"), cuts)
    pairs = F.transform(F.sequence(F.lit(0), cuts - 1), lambda k: F.struct(F.least(k, F.col("spot").cast("int")).alias("lo"), F.greatest(k, F.col("spot").cast("int")).alias("hi")))
    dealt = text.withColumn("spot", spot).select("node", "label", "spot", "text", F.explode(pairs).alias("pair")).select("node", "label", "spot", "text", "pair.lo", "pair.hi")

    def verify(part: pa.Table) -> pa.Table:
        nodes, spots, label, low, high = (part.column(n).to_numpy() for n in ("node", "spot", "label", "lo", "hi"))
        flat, bounds = shingles([x or "" for x in part.column("text").to_pylist()])
        order = np.lexsort((nodes, high, low, label))
        change = np.zeros(len(order), bool)
        change[:1] = True
        for column in (label, low, high):
            change[1:] |= column[order][1:] != column[order][:-1]
        out: list[tuple] = []
        for rows in np.split(order, np.flatnonzero(change)[1:]):
            lo, hi = low[rows[0]], high[rows[0]]
            held: dict[int, tuple[np.ndarray, int]] = {}
            for k in rows.tolist():
                node, own_set = int(nodes[k]), flat[bounds[k] : bounds[k + 1]]
                held[node] = (own_set, int(spots[k]))
            left = [k for k in held if held[k][1] == lo]
            right = [k for k in held if held[k][1] != lo] if lo != hi else []
            if (lo == hi and len(left) < 2) or (lo != hi and not (left and right)):
                continue
            ids = np.array(left + right, np.int64)
            i, j = compare([held[k][0] for k in left], [held[k][0] for k in right] if lo != hi else None, similarity)
            j = j + len(left) if lo != hi else j
            out.append((ids, ids[roots(len(ids), i, j)], np.bincount(np.concatenate([i, j]), minlength=len(ids)).astype(np.int64)))
        node, root, links = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64()), "links": pa.array(links, pa.int64())})

    # small groups share a bin, so that a call has work; each pair of blocks of a large one has a bin of its own
    bins = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    binned = dealt.withColumn("bin", F.when((F.col("lo") == 0) & (F.col("hi") == 0), F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.xxhash64("label", "lo", "hi")))
    checked = cut(binned.groupBy("bin").applyInArrow(grouped(verify), "node long, root long, links long").filter("links > 0"))
    links = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    final = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = sets.select("node", "least", "n").join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = classes.groupBy("label").agg(F.min("least").alias("class_id"))
    known = classes.join(named, "label").join(links, "node", "left").select("node", "label", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    found = worded.select("doc_id", "row", "node").join(known, "node").select("doc_id", "row", "label", "class_id", "n_links", "n_copies")
    empty = walked.filter("node is null").select("doc_id", "row", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    return found.unionByName(empty)
