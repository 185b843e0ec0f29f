"""Quality rules judged by an isolation forest (operator 10)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import column_ids, mapped, slices

COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, n_lines long, n_upper long, n_punct long, n_digits long, n_distinct long, n_long long"
NAMES = [x.split()[0] for x in COUNTS.split(", ")][1:]
#: Cells of the scores' grid on which the threshold lies.
GRID = 1 << 16
SYMBOLS = b"#*$%&|<>"
_WORDED = re.compile(rb"[^\x20\x09-\x0D]")
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,")


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of every row's whole text; a null or empty text has zeros, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "text"):
            ids, known = column_ids(table, "doc_id")
            rows = measure([x or "" for x in table.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), *(pa.array(rows[:, k]) for k in range(rows.shape[1]))], ["doc_id", *NAMES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(mapped(run), COUNTS)


def measure(texts: list[str]) -> np.ndarray:
    """A row of NAMES for each text."""
    out = np.zeros((len(texts), len(NAMES)), np.int64)
    flat: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        raw = text.encode()
        words = raw.split()
        counts[k] = len(words)
        flat += words
        white = len(raw) - sum(map(len, words))
        lines = raw.split(b"\n")
        worded = [x for x in lines if _WORDED.search(x)]
        upper = sum(map(str.isupper, text)) if not raw.isascii() else len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        punct = len(raw) - len(raw.translate(None, _PUNCT))
        digits = len(raw) - len(raw.translate(None, b"0123456789"))
        out[k] = (len(words), len(text) - white, symbols, len(worded) - len(set(worded)), 0, len(text), len(worded), upper, punct, digits, 0, sum(len(w) > 40 for w in words))
    codes = pd.factorize(pd.array(flat, dtype=pd.ArrowDtype(pa.binary())))[0].astype(np.int64) if flat else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    wide = int(codes.max(initial=0)) + 1
    for k in range(len(texts)):
        own = codes[offsets[k] : offsets[k + 1]]
        out[k, NAMES.index("n_distinct")] = len(np.unique(own))
        out[k, NAMES.index("n_repeat_words")] = _repeated(own, wide)
    return out


def _repeated(codes: np.ndarray, wide: int) -> int:
    """Words in windows of three that stand twice or more."""
    n = len(codes) - 2
    if n < 2:
        return 0
    if wide > 2_000_000:  # a code of three then needs more than 63 bits
        codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        wide = int(codes.max()) + 1
    pairs = np.unique(codes[:-1] * wide + codes[1:], return_inverse=True)[1].astype(np.int64) if wide > 2_000_000 else codes[:-1] * wide + codes[1:]
    keys = pairs[:-1] * wide + codes[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift : n + shift] |= again
    return int(covered.sum())


def features(rows: np.ndarray) -> np.ndarray:
    """Ratios of the counts, on scales where extremes stand apart."""
    c = {n: rows[:, k].astype(float) for k, n in enumerate(NAMES)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([np.log1p(c["n_words"]), c["word_chars"] / words, np.sqrt(c["n_symbols"] / words), c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars, np.sqrt(c["n_punct"] / words), np.sqrt(c["n_digits"] / chars), c["n_distinct"] / words ** 0.9, np.sqrt(c["n_long"] / words)], 1)


def grow(sample: np.ndarray, trees: int, size: int, seed: int) -> list[tuple[np.ndarray, ...]]:
    """An isolation forest: each tree halves `size` rows at random thresholds of random features."""
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows = sample[rng.choice(len(sample), min(size, len(sample)), replace=False)]
        limit = int(np.ceil(np.log2(max(2, len(rows)))))
        nodes: list[list[float]] = []

        def split(own: np.ndarray, depth: int, nodes: list = nodes, limit: int = limit) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, depth + _mean_path(len(own))])
            wide = np.flatnonzero(own.max(0) > own.min(0)) if len(own) else []
            if depth < limit and len(own) > 1 and len(wide):
                f = int(rng.choice(wide))
                cut = rng.uniform(own[:, f].min(), own[:, f].max())
                low = own[:, f] < cut
                nodes[at][:4] = [f, cut, split(own[low], depth + 1), split(own[~low], depth + 1)]
            return at

        split(rows, 0)
        table = np.array(nodes)
        forest.append((table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]))
    return forest


def _mean_path(n: float) -> float:
    """Expected depth of a leaf among n rows; between whole numbers under 2 on a line."""
    return min(max(n - 1, 0.0), 1.0) if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def leaves(forest: list, rows: np.ndarray) -> Iterator[np.ndarray]:
    """The leaf that each row reaches, tree by tree."""
    for feature, cut, low, high, _ in forest:
        at = np.zeros(len(rows), int)
        while (inner := feature[at] >= 0).any():
            f = feature[at]
            go = rows[np.arange(len(rows)), np.maximum(f, 0)] < cut[at]
            at = np.where(inner, np.where(go, low[at], high[at]), at)
        yield at


def anomaly(forest: list, rows: np.ndarray, size: int) -> np.ndarray:
    """2 ** -(mean path / expected path): near 1 for rows that few splits isolate."""
    total = np.zeros(len(rows))
    for tree, at in zip(forest, leaves(forest, rows), strict=True):
        total += tree[4][at]
    return 2.0 ** (-total / len(forest) / max(_mean_path(size), 1e-9))


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def fit(docs: DataFrame, labels: DataFrame, trees: int = 150, size: int = 256, seed: int = 7) -> dict:
    """The forest and its threshold, from the whole texts of all labelled rows (learn)."""
    return learn(statistics(docs), labels, trees, size, seed)


def learn(counted: DataFrame, labels: DataFrame, trees: int = 150, size: int = 256, seed: int = 7) -> dict:
    """The forest and its threshold, from statistics() and labels of all rows.

    As the method has it, each tree parts the space at random by `size` rows, drawn for it among as many as all trees take,
    those of the least hashes. How many rows lie in a leaf is then counted over all labelled rows, those labelled 0 weighed
    as the minority they are (a twentieth of the others at most). The threshold is calibrated on all labelled rows that
    the base rule keeps: the cut with the fewest errors, a row labelled 1 counting twice, on a grid of 2 ** -16.
    Without rows labelled 1 nothing is rejected.
    """
    pick = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("quality_label")).filter("quality_label in (0, 1)")
    pick = pick.groupBy("doc_id").agg(F.max("quality_label").cast("int").alias("quality_label"))
    known = cut(counted.join(pick, "doc_id"))
    n = {r["quality_label"]: r["count"] for r in known.groupBy("quality_label").count().collect()}
    good, bad = n.get(1, 0), n.get(0, 0)
    if not good + bad:
        return {"forest": [], "threshold": 2.0, "size": size}
    few = min(bad, max(1, good // 20)) if good else bad
    # as many rows as all trees need, with the labels' shares of the whole
    wanted = min(good + few, trees * size)
    share = -(-wanted * few // (good + few))
    some = [_least(known.filter(F.col("quality_label") == q), m, n[q], seed) for q, m in ((1, wanted - share), (0, share)) if m]
    forest = grow(features(np.array([r for rows in some for r in rows], np.int64).reshape(-1, len(NAMES))), trees, size, seed)
    reach = _tally(known, lambda x, label, failed: np.concatenate([np.bincount(2 * at + label, minlength=2 * len(t[0])) for t, at in zip(forest, leaves(forest, x), strict=True)]), sum(2 * len(t[0]) for t in forest))
    edge = 0
    for k, (feature, cuts, low, high, _) in enumerate(forest):
        own = reach[edge : edge + 2 * len(feature)].reshape(-1, 2) @ np.array([few / max(1, bad), 1.0])
        edge += 2 * len(feature)
        depth = np.zeros(len(feature))
        for at in np.flatnonzero(feature >= 0):  # a node stands before those below it
            depth[[low[at], high[at]]] = depth[at] + 1
        scaled = own * (min(size, good + few) / (good + few))
        forest[k] = (feature, cuts, low, high, depth + np.array([_mean_path(m) for m in scaled]))
    if not good:
        return {"forest": forest, "threshold": 2.0, "size": size}
    # rows the base rule keeps, by cell of the grid and label: a cut lies at a cell's end
    cells = _tally(known, lambda x, label, failed: np.bincount((2 * np.minimum((anomaly(forest, x, size) * GRID).astype(np.int64), GRID - 1) + label)[~failed], minlength=2 * GRID), 2 * GRID).reshape(-1, 2)
    if not cells[:, 1].any():
        return {"forest": forest, "threshold": 2.0, "size": size}
    used = np.flatnonzero(cells.sum(1))
    kept = cells[used].cumsum(0)
    lost = 2 * (kept[-1, 1] - kept[:, 1]) + kept[:, 0]
    # the middle of the widest of the best gaps between cells in use
    gap = np.append(np.diff(used), 0)
    best = max(range(len(used)), key=lambda k: (-lost[k], gap[k]))
    return {"forest": forest, "threshold": float((used[best] + 1 + max(0, gap[best] - 1) / 2) / GRID), "size": size}


def _least(rows: DataFrame, m: int, n: int, seed: int) -> list:
    """Statistics of m of n rows, those of the least hashes; tasks send few others to the driver."""
    hashed = rows.withColumn("hash", F.pmod(F.xxhash64("doc_id", *NAMES, F.lit(seed)), F.lit(1 << 32)))
    for most in (1.1 * m / n + 1000 / n, 1.0):
        found = hashed.filter(F.col("hash") <= F.lit(int(min(most, 1.0) * (1 << 32)))).orderBy("hash", "doc_id", *NAMES).limit(m).select(*NAMES).collect()
        if len(found) == min(m, n):
            break
    return found


def _tally(known: DataFrame, count: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """Sum over all rows of known of count(features, label, base_failed), vectors of that length for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            rows = np.stack([batch.column(n).to_numpy() for n in NAMES], 1)
            if len(rows):
                total = total + count(features(rows), batch.column("quality_label").to_numpy().astype(np.int64), base_failed(rows[:, 0], rows[:, NAMES.index("n_repeat_words")]))
        if not np.isscalar(total):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["at", "n"])

    rows = known.select(*NAMES, "quality_label").mapInArrow(mapped(run), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at = rows.column("at").to_numpy()
    out = np.zeros(length, np.int64)
    out[at] = rows.column("n").to_numpy()
    return out


def judge(docs: DataFrame, model: dict) -> DataFrame:
    """statistics() with base_failed, score (null where the base rule fails) and kept."""
    return verdicts(statistics(docs), model)


def verdicts(counted: DataFrame, model: dict) -> DataFrame:
    """judge() of rows of statistics()."""
    bound = counted.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bound.value
        for batch in batches:
            rows = np.stack([batch.column(n).to_numpy() for n in NAMES], 1) if batch.num_rows else np.zeros((0, len(NAMES)), np.int64)
            failed = base_failed(rows[:, 0], rows[:, NAMES.index("n_repeat_words")])
            score = anomaly(own["forest"], features(rows), own["size"]) if own["forest"] and len(rows) else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(score, mask=failed), pa.array(~failed & (score <= own["threshold"]))], [*batch.schema.names, "base_failed", "score", "kept"])

    return counted.mapInArrow(mapped(run), COUNTS + ", base_failed boolean, score double, kept boolean")


def passed(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps; no row is moved."""
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bound.value
        for table in slices(batches, "text"):
            rows = measure([x or "" for x in table.column("text").to_pylist()])
            kept = ~base_failed(rows[:, 0], rows[:, NAMES.index("n_repeat_words")])
            if own["forest"]:
                kept &= anomaly(own["forest"], features(rows), own["size"]) <= own["threshold"]
            yield from table.filter(pa.array(kept)).to_batches()

    return docs.mapInArrow(mapped(run), docs.schema)
