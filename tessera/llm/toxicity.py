"""Toxic spans from a linear-chain conditional random field over words (operator 4)."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_ids, drawn, mapped, remainder, slices

BITS = 18
_EDGE = ".,;:!?\"'()[]{}*_~#|<>«»“”„¡¿-"
#: Words a chain is cut after, and the context on both sides of a cut: a chain of two states forgets far faster.
CHAIN, CONTEXT = 1024, 48


def _parts(word: str) -> list[str]:
    w = word.lower().strip(_EDGE)
    return ["w" + w, "p" + w[:4], "q" + w[:5], "s" + w[-4:], "n" + str(min(len(w), 12))]


def indices(words: list[str]) -> np.ndarray:
    """Hashed features of each word, one row each."""
    mask = (1 << BITS) - 1
    return np.array([[zlib.crc32(x.encode()) & mask for x in _parts(w)] for w in words], np.int64).reshape(len(words), 5)


def messages(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds at each word of what is up to it, and of what comes after it; sequences lie one after another in emit.

    trans has the logs of moving 0-1, 1-0 and 1-1 against 0-0; emit is the log odds of a word alone.
    """
    order = np.argsort(-lengths, kind="stable")
    begin = (np.concatenate([[0], np.cumsum(lengths)])[:-1])[order]
    size = lengths[order]
    ahead, behind = np.zeros(len(emit)), np.zeros(len(emit))
    if not len(size) or size[0] == 0:
        return ahead, behind
    t01, t10, t11 = np.exp(trans)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # sequences with a word at each step
    r = np.ones(0)
    for t, n in enumerate(active.tolist()):
        at = begin[:n] + t
        prior = np.log((t01 + t11 * r[:n]) / (1 + t10 * r[:n])) if t else np.zeros(n)
        a = np.clip(prior + emit[at], -60, 60)
        ahead[at] = a
        r = np.exp(a)
    x = np.ones(len(size))
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        at = begin[:n] + t
        inner = int(active[t + 1]) if t + 1 < len(active) else 0
        b = np.zeros(n)
        b[:inner] = np.log((t10 + t11 * x[:inner]) / (1 + t01 * x[:inner]))
        behind[at] = b
        x[:n] = np.exp(np.clip(b + emit[at], -60, 60))
    return ahead, behind


def chain(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Forward-backward: P(toxic) at each word."""
    ahead, behind = messages(emit, lengths, trans)
    return 1 / (1 + np.exp(-np.clip(ahead + behind, -60, 60)))


def moves(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) at each word, and P(0-1), P(1-0) and P(1-1) of each word (but a sequence's first) with the one before it."""
    ahead, behind = messages(emit, lengths, trans)
    later = np.ones(len(emit), bool)
    later[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    b = np.flatnonzero(later)
    before, after = np.exp(ahead[b - 1]), np.exp(np.clip(emit[b] + behind[b], -60, 60))
    t01, t10, t11 = np.exp(trans)
    ways = np.stack([t01 * after, t10 * before, t11 * before * after])
    return 1 / (1 + np.exp(-np.clip(ahead + behind, -60, 60))), ways / (1 + ways.sum(0))


def long_chain(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """chain() with long sequences cut into parts that see CONTEXT words beyond both ends."""
    if not len(lengths) or lengths.max() <= CHAIN + 2 * CONTEXT:
        return chain(emit, lengths, trans)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    take, sizes, own = [], [], []
    for k, n in enumerate(lengths.tolist()):
        for lo in range(0, n, CHAIN):
            hi = min(n, lo + CHAIN)
            left, right = max(0, lo - CONTEXT), min(n, hi + CONTEXT)
            take.append(np.arange(begin[k] + left, begin[k] + right))
            sizes.append(right - left)
            mark = np.zeros(right - left, bool)
            mark[lo - left : hi - left] = True
            own.append(mark)
    index, mine = np.concatenate(take), np.concatenate(own)
    out = np.zeros(len(emit))
    out[index[mine]] = chain(emit[index], np.array(sizes), trans)[mine]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, most_chars: int = 20_000, held: tuple[int, int] = (5, 0), seed: int = 3, most_windows: int = 8000) -> dict:
    """A model from at most `sample` labelled rows of at most `most_chars` characters, none of which is held out.

    Training takes at most `most_windows` windows of 32 words with a toxic word, and at most twice as many others. A null
    doc_id has no label, so its row teaches nothing; in the query it counts as held out only if the crc32 of an empty text does.

    Labels are of documents; words get theirs from the sample: a word of a toxic document is toxic if it, or
    its first four or five letters, follow different words in toxic documents often enough (once for each
    hundred of them, and four times) and hardly stand in any other. Copies and near copies so count once.
    """
    pick = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("toxic_label")).filter(F.col("toxic_label").isNotNull()).groupBy("doc_id").agg(F.max("toxic_label").alias("toxic_label"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    open_to = pick.filter(remainder(F.col("doc_id"), held[0]) != held[1])
    texts: list[list[str]] = []
    marks: list[int] = []
    same: dict[str, str] = {}  # one string for each distinct word: the driver holds all words of the sample
    for label in (0, 1):
        for text in drawn(own, open_to.filter(F.col("toxic_label") == label), sample // 2, seed, most_chars):
            if words := [same.setdefault(w, w) for w in text.split()]:
                texts.append(words)
                marks.append(label)
    if not texts or not any(marks) or all(marks):
        return {"weights": np.zeros(1 << BITS, np.float32), "trans": np.zeros(3), "scale": [0.0, 0.0, -3.0]}
    return train(texts, marks, seed, most_windows)


def train(texts: list[list[str]], marks: list[int], seed: int = 3, most_windows: int = 8000) -> dict:
    once = {tuple(w): k for k, w in reversed(list(enumerate(texts)))}
    texts, marks = [texts[k] for k in sorted(once.values())], [marks[k] for k in sorted(once.values())]
    # documents with a feature, by label; and in toxic ones the pairs of a word with it and the word before,
    # as near copies repeat both
    seen, pairs = [Counter(), Counter()], set()
    for words, mark in zip(texts, marks, strict=True):
        seen[mark].update({p for w in set(words) for p in _parts(w)[:3] if len(p) > 3})
        if mark:
            pairs.update(zip(words, ["", *words[:-1]], strict=True))
    uses = Counter(p for word, _ in pairs for p in _parts(word)[:3])
    share = marks.count(1) / max(1, marks.count(0))
    least = max(4, 0.01 * marks.count(1))
    toxic = {p for p, n in seen[1].items() if uses[p] >= least and n >= max(2, least / 2) and n >= 20 * share * seen[0][p]}
    number: dict[str, int] = {}
    codes = [np.array([number.setdefault(w, len(number)) for w in words]) for words in texts]
    shown = list(number)
    table = indices(shown)
    bad = np.array([any(p in toxic for p in _parts(w)[:3]) for w in shown])
    rng = np.random.default_rng(seed)
    width = 32
    hit, calm = [], []
    for own, mark in zip(codes, marks, strict=True):
        for lo in range(0, len(own), width):
            part = own[lo : lo + width]
            target = bad[part] & bool(mark)
            (hit if target.any() else calm).append((part, target))
    calm = [calm[i] for i in rng.permutation(len(calm))[: max(most_windows // 2, 2 * min(len(hit), most_windows))]]
    hit = [hit[i] for i in rng.permutation(len(hit))[:most_windows]]
    pool = hit + calm
    weights, trans = np.zeros(1 << BITS), np.array([-2.0, 0.0, 0.0])
    bias = -3.0
    speed_w, speed_t = np.full(1 << BITS, 1e-6), np.full(3, 1e-6)
    for epoch in range(5):
        order = rng.permutation(len(pool))
        for lo in range(0, len(order), 512):
            rows = [pool[i] for i in order[lo : lo + 512]]
            flat, y = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(float)
            lengths = np.array([len(r[0]) for r in rows])
            feats = table[flat]
            emit = weights[feats].sum(1) + bias
            p, ways = moves(emit, lengths, trans)
            g = np.bincount(feats.ravel(), np.repeat(p - y, feats.shape[1]), 1 << BITS) / len(rows) + 1e-5 * weights
            speed_w += g * g
            weights -= 0.5 / (epoch + 1) ** 0.5 * g / np.sqrt(speed_w)
            later = np.ones(len(flat), bool)
            later[np.cumsum(lengths) - lengths] = False
            a, b = np.flatnonzero(later) - 1, np.flatnonzero(later)
            # expected moves, by the marginals of neighbours, against the observed ones
            gt = (ways - np.stack([(1 - y[a]) * y[b], y[a] * (1 - y[b]), y[a] * y[b]])).sum(1) / len(rows)
            speed_t += gt * gt
            trans -= 0.1 * gt / np.sqrt(speed_t)
    emit_of = weights[table].sum(1) + bias
    lengths = np.array([len(c) for c in codes])
    x = summaries(long_chain(emit_of[np.concatenate(codes)], lengths, trans), lengths)
    y = np.array(marks, float)
    a = np.zeros(3)
    for _ in range(60):  # Newton steps of a logistic regression, with a little ridge
        z = np.column_stack([x, np.ones(len(x))])
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        ridge = np.diag([0.05, 0.05, 1e-3])
        a += np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + ridge, z.T @ (y - p) - ridge @ a)
    return {"weights": weights.astype(np.float32), "bias": bias, "trans": trans, "scale": a.tolist()}


def summaries(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What a document's score sees of its marginals, a row each; no words count as no toxic word."""
    begin = np.cumsum(lengths) - lengths
    worded = lengths > 0
    out = np.tile(np.log([1e-3, 1e-2]), (len(lengths), 1))
    if worded.any():
        out[worded, 0] = np.log(1e-3 + np.maximum.reduceat(p, begin[worded]))
        out[worded, 1] = np.log(1e-2 + np.add.reduceat(p * p, begin[worded]))
    return out


class Scorer:
    """The model over batches of texts; keeps what it has worked out of words."""

    def __init__(self, model: dict) -> None:
        self.weights, self.bias, self.trans, self.scale = model["weights"], model.get("bias", 0.0), model["trans"], np.array(model["scale"])
        self.seen: dict[str, float] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each text, P(toxic) of each word, bounds of the texts' words)."""
        flat: list[str] = []
        lengths = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = text.split()
            lengths[k] = len(words)
            flat += words
        p = np.zeros(0)
        if flat:
            codes, shown = pd.factorize(pd.array(flat, dtype=pd.ArrowDtype(pa.string())))
            shown = list(shown)
            new = [w for w in shown if w not in self.seen]
            self.seen.update(zip(new, (self.weights[indices(new)].sum(1) + self.bias).tolist(), strict=True))
            p = long_chain(np.array([self.seen[w] for w in shown])[codes], lengths, self.trans)
            if len(self.seen) > 400_000:
                self.seen.clear()
        scores = 1 / (1 + np.exp(-np.clip(summaries(p, lengths) @ self.scale[:2] + self.scale[2], -30, 30)))
        return scores, p, np.concatenate([[0], np.cumsum(lengths)])


def tag(docs: DataFrame, model: dict, at_least: float = 0.5) -> DataFrame:
    """(doc_id, score, spans) of every row's whole text: spans are code point offsets of runs of words with P(toxic) >= at_least.

    A null or empty text has the score of a text without toxic words, and no span.
    """
    bound = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, spans array<struct<start:int,stop:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(bound.value)
        for table in slices(batches, "text"):
            ids, known = column_ids(table, "doc_id")
            texts = [x or "" for x in table.column("text").to_pylist()]
            scores, p, reach = score(texts)
            spans = []
            for k, text in enumerate(texts):
                mine = p[reach[k] : reach[k + 1]]
                spans.append(_spans(text, mine >= at_least) if len(mine) and mine.max() >= at_least else [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(mapped(run), schema)


def clean(docs: DataFrame, model: dict, below: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under `below`; no row is moved."""
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(bound.value)
        for table in slices(batches, "text"):
            yield from table.filter(pa.array(score([x or "" for x in table.column("text").to_pylist()])[0] < below)).to_batches()

    return docs.mapInArrow(mapped(run), docs.schema)


def _spans(text: str, toxic: np.ndarray) -> list[dict]:
    out: list[dict] = []
    at, last = 0, -2
    for k, word in enumerate(text.split()):
        start = text.index(word, at)
        at = start + len(word)
        if toxic[k]:
            if last == k - 1:
                out[-1]["stop"] = at
            else:
                out.append({"start": start, "stop": at})
            last = k
    return out
