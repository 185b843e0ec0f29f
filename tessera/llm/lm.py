"""Language-model scores from a causal self-attention model over subword ids (operator 1).

A text's score is the sum over its ids of the logarithm of what one layer of causal self-attention gives them: a
softmax over classes of ids, then one over the ids of the class. The model is trained in numpy on every window of every
training row: it starts from a few texts on the driver, then each part of the training rows goes through all of its
windows, and the parts' models are averaged by their windows. Which ids have a place of their own, how often each occurs,
what stands beside each (which gives the classes) and what the other ids share is counted over all training rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import drawn, grouped, mapped, pack, remainder, slices, texts_of
from .wordtable import Block, blocks, encoder, lower_words, resolved, unpack

END = 50256
#: Positions in a window, and how many of its last ones are scored: each id is scored once, with 16 to 48 ids before it.
WINDOW, STRIDE = 48, 32
WIDE, KEY, HIDDEN = 32, 8, 32
#: Windows whose attention is worked out at once: their weights fit a core's cache.
RUN = 64
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"


def windows(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (n, WINDOW) and targets (n, STRIDE) of sequences that lie one after another, each with its end.

    Position t of a sequence sees what is before it; places before its start hold -1, as targets beyond its end do.
    """
    lengths = np.diff(bounds)
    per = -(-lengths // STRIDE)
    seq = np.repeat(np.arange(len(lengths)), per)
    step = np.arange(len(seq)) - np.repeat(np.cumsum(per) - per, per)
    first = bounds[:-1][seq] + step * STRIDE
    target = first[:, None] + np.arange(STRIDE)
    goal = np.where(target < bounds[1:][seq][:, None], ids[np.minimum(target, len(ids) - 1)], -1)
    source = first[:, None] + np.arange(WINDOW) - (WINDOW - STRIDE) - 1
    begin = bounds[:-1][seq][:, None]
    given = np.where(source >= begin, ids[np.clip(source, 0, len(ids) - 1)], np.where(source == begin - 1, END, -1))
    given[source >= bounds[1:][seq][:, None]] = -1
    return given, goal


def _mask() -> np.ndarray:
    """Distance from each scored position back to each position of the window; those ahead count as -1."""
    return (np.arange(STRIDE)[:, None] + (WINDOW - STRIDE)) - np.arange(WINDOW)[None, :]


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _short(x: np.ndarray, most: int) -> np.ndarray:
    """Numbers under `most` in 16 bits where they fit, which are sorted by digits."""
    return x.astype(np.int16) if most < 1 << 15 else x


def _exp(x: np.ndarray, safe: bool) -> np.ndarray:
    """Exponentials in place, for sums along the last axis; with safe, off the maximum, so that no sum is beyond a float."""
    if safe:
        x -= x.max(-1, keepdims=True)
    return np.exp(x, out=x)


class Model:
    """One layer of causal self-attention with relative positions, and a softmax over classes and over a class's ids.

    Ids with a place of their own (known) lie by class; all others share one embedding, and together what they have of
    the counts: `other` is the share of all of them, spread among them as their counts are.
    """

    def __init__(self, counts: np.ndarray, known: np.ndarray, classes: np.ndarray, seed: int) -> None:
        """counts: of each id; known: the ids with a place of their own, and the class of each."""
        rng = np.random.default_rng(seed)
        order = np.argsort(classes, kind="stable")
        self.known, self.groups = known[order], classes[order].astype(np.int64)
        self.count = int(self.groups[-1]) + 1
        self.edges = np.searchsorted(self.groups, np.arange(self.count + 1))
        n = len(known)
        self.place = np.full(len(counts), -1)
        self.place[self.known] = np.arange(n)
        self.row = np.where(self.place >= 0, self.place, n)
        self.of = np.where(self.place >= 0, self.groups[np.minimum(self.row, n - 1)], -1)
        rest = np.where(self.place < 0, counts + 0.5, 0.0)
        own = counts[self.known].sum() + 0.5 * n
        self.other = rest.sum() / (rest.sum() + own) if n < len(counts) else 0.0
        with np.errstate(divide="ignore"):
            self.share = np.log(rest / max(rest.sum(), 1e-300)) + np.log(max(self.other, 1e-300))
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        usual = np.log(counts[self.known] + 0.5)
        mass = np.log(np.bincount(self.groups, counts[self.known] + 0.5))
        self.p = {
            "E": (rng.standard_normal((n + 2, WIDE)) * 0.3).astype(np.float32), "q": init(WIDE, KEY), "k": init(WIDE, KEY), "v": init(WIDE, HIDDEN), "r": np.zeros(WINDOW, np.float32), "w": init(WIDE, HIDDEN), "b": np.zeros(HIDDEN, np.float32),
            "o": init(HIDDEN, self.count) * np.float32(0.3), "c": (mass - mass.max()).astype(np.float32), "i": np.zeros((n, HIDDEN), np.float32), "d": (usual - mass[self.groups]).astype(np.float32),
        }

    def rows(self, given: np.ndarray) -> np.ndarray:
        return np.where(given >= 0, self.row[np.maximum(given, 0)], len(self.known) + 1)

    def step(self, given: np.ndarray, goal: np.ndarray) -> tuple[float, dict]:
        """Loss in nats a known id, and gradients."""
        with np.errstate(all="ignore"):
            loss, g = self.passed(given, goal)
        return (loss, g) if np.isfinite(loss) else self.passed(given, goal, safe=True)

    def passed(self, given: np.ndarray, goal: np.ndarray, safe: bool = False) -> tuple[float, dict]:
        """What step() returns; without safe, the loss is not finite where a sum of exponentials is beyond a float."""
        p, rows, ready = self.p, self.rows(given), self.tables()
        kind, n = p["E"].dtype.type, len(given)
        far, bias = _mask(), self.bias()
        runs = [slice(lo, lo + RUN) for lo in range(0, n, RUN)]
        seen = [self.attend(given[x], rows[x], ready, bias, safe) for x in runs]
        u = np.concatenate([x[-1] for x in seen])
        z = np.ones((n * STRIDE, HIDDEN + 1), kind)  # the last column takes the biases
        np.maximum(_flat(u), 0, out=z[:, :-1])
        target = self.place[np.maximum(goal, 0)].ravel()
        live = np.flatnonzero((goal.ravel() >= 0) & (target >= 0))
        live = live[np.argsort(_short(self.groups[target[live]], self.count), kind="stable")]
        z, target = z[live], target[live]
        group = self.groups[target]
        count = max(1, len(live))
        first = np.append(0, np.cumsum(np.bincount(group, minlength=self.count)))
        pick, got, dz = target - self.edges[group], np.empty((2, len(live)), kind), np.empty_like(z)
        top, inner = ready["out"]
        d_top, d_inner = np.zeros_like(top), np.zeros_like(inner)
        for c in np.flatnonzero(np.diff(first)):  # both softmaxes of a class's targets side by side
            (a0, b0), (lo, hi) = first[c : c + 2], self.edges[c : c + 2]
            x, w, at = z[a0:b0], np.concatenate([top, inner[lo:hi]]), np.arange(b0 - a0)
            y = x @ w.T
            for k, own, chosen in ((0, y[:, : self.count], c), (1, y[:, self.count :], pick[a0:b0])):
                _exp(own, safe)
                own *= (1 / (count * (own @ np.ones(own.shape[1], kind))))[:, None]
                got[k, a0:b0] = own[at, chosen]
                own[at, chosen] -= kind(1 / count)
            moved = y.T @ x
            d_top += moved[: self.count]
            d_inner[lo:hi] = moved[self.count :]
            np.matmul(y, w, out=dz[a0:b0])
        loss = -np.log(got * count + 1e-30).sum()
        du = np.zeros((n * STRIDE, HIDDEN + 1), kind)
        du[live] = dz
        du = du.reshape(n, STRIDE, HIDDEN + 1)
        du[..., :-1] *= u > 0
        g = {"o": d_top[:, :-1].T, "c": d_top[:, -1], "i": d_inner[:, :-1], "d": d_inner[:, -1], "b": _flat(du)[:, :-1].sum(0)}
        near, late = np.column_stack([p["k"], p["v"]]), np.column_stack([p["q"] * kind(KEY**-0.5), p["w"]])
        d_near, d_late, d_far = np.zeros_like(near), np.zeros_like(late), np.zeros((STRIDE, WINDOW), kind)
        de = np.empty((n, WINDOW, WIDE), kind)
        for at, (kv, qw, a, h, _) in zip(runs, seen, strict=True):
            d = du[at]
            np.einsum("ntj,ntj->nt", d[..., :-1], h, out=d[..., -1])  # what a's gradients weigh on average
            d[..., -1] *= -1
            ds = d @ kv[..., KEY:].transpose(0, 2, 1)
            ds *= a
            d_far += ds.sum(0)
            d_kv, d_qw = np.empty((len(a), WINDOW, KEY + HIDDEN), kind), np.empty((len(a), STRIDE, KEY + HIDDEN), kind)
            np.matmul(ds.transpose(0, 2, 1), qw[..., :KEY], out=d_kv[..., :KEY])
            np.matmul(a.transpose(0, 2, 1), d[..., :-1], out=d_kv[..., KEY:])
            np.matmul(ds, kv[..., :KEY], out=d_qw[..., :KEY])
            d_qw[..., KEY:] = d[..., :-1]
            d_kv[given[at] < 0] = 0  # weights of places without an id count nowhere
            e = p["E"][rows[at]]
            d_near += _flat(e).T @ _flat(d_kv)
            d_late += _flat(e[:, -STRIDE:]).T @ _flat(d_qw)
            np.matmul(_flat(d_kv), near.T, out=_flat(de[at]))
            de[at, -STRIDE:] += (_flat(d_qw) @ late.T).reshape(len(a), STRIDE, WIDE)
        g["k"], g["v"], g["q"], g["w"] = d_near[:, :KEY], d_near[:, KEY:], d_late[:, :KEY] * kind(KEY**-0.5), d_late[:, KEY:]
        g["r"] = np.bincount(np.maximum(far, 0).ravel(), (d_far * (far >= 0)).ravel(), WINDOW).astype(kind)
        order = np.argsort(_short(rows.ravel(), len(p["E"])), kind="stable")
        sorted_rows = rows.ravel()[order]
        edge = np.flatnonzero(np.diff(sorted_rows, prepend=-1))
        g["E"] = np.zeros_like(p["E"])
        pairs = np.add.reduceat(_flat(de)[order].view(np.result_type(kind, np.complex64)), edge, 0)  # two columns at once
        g["E"][sorted_rows[edge]] = pairs.view(kind)
        g["E"][-1] = 0  # places without an id
        return float(loss) / count, g

    def bias(self) -> np.ndarray:
        """What a position's distance adds to its score; nothing ahead is seen."""
        far, r = _mask(), self.p["r"]
        return np.where(far >= 0, r[np.maximum(far, 0)], r.dtype.type(-1e9))

    def attend(self, given: np.ndarray, rows: np.ndarray, ready: dict, bias: np.ndarray, safe: bool) -> tuple[np.ndarray, ...]:
        """Of some windows: the tables' rows of all positions and of the scored ones, weights, what they gather, and the
        hidden layer before its rectifier.

        Places without an id read a row of zeros, which has no part in sums, whatever its weight.
        """
        kv, qw = ready["near"][rows], ready["late"][rows[:, -STRIDE:]]
        a = qw[..., :KEY] @ kv[..., :KEY].transpose(0, 2, 1)
        a += bias
        if safe:
            np.copyto(a, bias.dtype.type(-1e9), where=(given < 0)[:, None, :])
        _exp(a, safe)
        h = a @ kv[..., KEY:]
        total = 1 / h[..., -1:]
        a *= total
        h = h[..., :-1] * total
        return kv, qw, a, h, h + qw[..., KEY:]

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes and of ids, a row each, with the biases in the last column."""
        return np.vstack([self.p["o"], self.p["c"]]).T.copy(), np.column_stack([self.p["i"], self.p["d"]])

    def learn(self, given: np.ndarray, goal: np.ndarray, steps: int, batch: int, seed: int, top: float = 2.5e-2, decay: float = 0.1, whole: bool = False) -> list[float]:
        """Adam with a rate that rises to `top` and falls, over random windows; the weights of single ids decay.

        With whole, windows are gone through in random order, and as many steps made as that takes, `steps` at least.
        """
        rng = np.random.default_rng(seed)
        if whole:
            steps = max(steps, -(-len(given) // batch))
            order = np.concatenate([rng.permutation(len(given)) for _ in range(-(-steps * batch // len(given)))])
        flat = np.concatenate([x.ravel() for x in self.p.values()])
        ends = np.cumsum([x.size for x in self.p.values()])
        self.p = {n: own.reshape(x.shape) for (n, x), own in zip(self.p.items(), np.split(flat, ends[:-1]), strict=True)}
        m, s, g, move = (np.zeros_like(flat) for _ in range(4))
        losses = []
        for t in range(1, steps + 1):
            pick = order[(t - 1) * batch : t * batch] if whole else rng.integers(0, len(given), batch)
            loss, own = self.step(given[pick], goal[pick])
            np.concatenate([own[n].ravel() for n in self.p], out=g)
            rate = top * min(1, 20 * t / steps) * (1 - t / (steps + 1)) ** 0.7 + 1e-5
            m *= 0.9
            m += np.multiply(g, 0.1, out=move)
            g *= g
            s *= 0.99
            s += np.multiply(g, 0.01, out=g)
            np.sqrt(s, out=move)
            move *= 1 / np.sqrt(1 - 0.99**t)
            move += 1e-8
            np.divide(m, move, out=move)
            flat -= np.multiply(move, rate / (1 - 0.9**t), out=move)
            for n in "Ei":
                self.p[n] *= 1 - rate * decay
            losses.append(loss)
        return losses

    def tables(self) -> dict:
        """Everything that depends on one id alone, by row; that of places without an id is empty on the side that is seen."""
        p, kind = self.p, self.p["E"].dtype.type
        near = np.ones((len(p["E"]), KEY + HIDDEN + 1), kind)  # the last column adds up the weights
        np.matmul(p["E"], np.column_stack([p["k"], p["v"]]), out=near[:, :-1])
        near[-1] = 0
        late = p["E"] @ np.column_stack([p["q"] * kind(KEY**-0.5), p["w"]])
        late[:, KEY:] += p["b"]
        return {"near": near, "late": late, "out": self.outputs()}

    def predict(self, ids: np.ndarray, bounds: np.ndarray, ready: dict, batch: int = 512) -> np.ndarray:
        """log10 of the probability of each id of the sequences."""
        given, goal = windows(ids, bounds)
        out, at = np.empty(len(ids)), 0
        for lo in range(0, len(given), batch):
            x, y = given[lo : lo + batch], goal[lo : lo + batch].ravel()
            with np.errstate(all="ignore"):
                own = self.logs(x, y, ready)
            if not np.isfinite(own).all():
                own = self.logs(x, y, ready, safe=True)
            out[at : at + len(own)] = own
            at += len(own)
        return out / np.log(10.0)

    def logs(self, given: np.ndarray, goal: np.ndarray, ready: dict, safe: bool = False) -> np.ndarray:
        """Logarithms of the probabilities of all targets of some windows; without safe, not finite where a sum of
        exponentials is beyond a float."""
        rows, bias, (top, inner) = self.rows(given), self.bias(), ready["out"]
        runs = [slice(lo, lo + RUN) for lo in range(0, len(given), RUN)]
        u = np.concatenate([self.attend(given[x], rows[x], ready, bias, safe)[-1] for x in runs])
        z = np.ones((goal.size, HIDDEN + 1), u.dtype)
        np.maximum(_flat(u), 0, out=z[:, :-1])
        live = np.flatnonzero(goal >= 0)
        goal = goal[live]
        group = self.of[goal]
        order = np.argsort(_short(group, self.count), kind="stable")
        z, goal = z[live[order]], goal[order]
        first = np.searchsorted(group[order], np.arange(self.count + 1))
        found = np.empty(len(goal))
        found[: first[0]] = self.share[goal[: first[0]]]  # those have no place of their own
        pick = self.place[goal]
        for c in np.flatnonzero(np.diff(first)):
            (a0, b0), (lo, hi) = first[c : c + 2], self.edges[c : c + 2]
            y = z[a0:b0] @ np.concatenate([top, inner[lo:hi]]).T
            total = np.zeros(b0 - a0, u.dtype)
            for own, chosen in ((y[:, : self.count], c), (y[:, self.count :], pick[a0:b0] - lo)):
                if safe:
                    own -= own.max(-1, keepdims=True)
                total += own[np.arange(b0 - a0), chosen]
                total -= np.log(_exp(own, False) @ np.ones(own.shape[1], u.dtype))
            found[a0:b0] = total + np.log1p(-self.other)
        out = np.empty(len(goal))
        out[order] = found
        return out


def beside(ids: np.ndarray, known: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """What stands before and after each known id in ids, as sums of random projections of the neighbours, rare ones more.

    counts are those of all texts, so that the sums of parts add up to that of the whole.
    """
    size = len(counts)
    proj = np.random.default_rng(seed).standard_normal((2, size, 24)).astype(np.float32)
    proj /= np.sqrt(counts + 1e-5 * counts.sum() + 1).astype(np.float32)[:, None]
    row = np.full(size, -1)
    row[known] = np.arange(len(known))
    pair, n = np.unique(ids[:-1].astype(np.int64) * size + ids[1:], return_counts=True)
    x = np.zeros((len(known), 48))
    for side, (own, other) in enumerate(((pair % size, pair // size), (pair // size, pair % size))):
        keep = np.flatnonzero(row[own] >= 0)
        keep = keep[np.argsort(row[own[keep]], kind="stable")]
        for lo in range(0, len(keep), 200_000):
            s = keep[lo : lo + 200_000]
            edge = np.flatnonzero(np.diff(row[own[s]], prepend=-1))
            x[row[own[s]][edge], 24 * side : 24 * side + 24] += np.add.reduceat(proj[side][other[s]] * n[s].astype(np.float32)[:, None], edge, 0)
    return x


def classify(near: np.ndarray, freq: np.ndarray, count: int, seed: int, most: int = 32) -> np.ndarray:
    """A class of each known id by what stands before and after it (beside): k-means over it.

    freq: how often each occurs. An id without neighbours is put with the others like it. Classes of more than `most` ids
    are cut by falling frequency, so that frequent ids lie in small classes; no class is empty.
    """
    rng = np.random.default_rng(seed)
    x = (near / (np.linalg.norm(near, axis=1, keepdims=True) + 1e-6)).astype(np.float32)
    near = _means(x, np.sqrt(freq + 0.1), count, rng)
    order = np.lexsort((-freq, near))
    place = np.empty(len(freq), np.int64)
    place[order] = np.arange(len(freq)) - np.searchsorted(near[order], near[order])
    # bands that double: the rarest ids of a class lie in a large one that few texts ask for
    band = np.floor(np.log2(place / most + 1)).astype(np.int64)
    return np.unique(near * 64 + band, return_inverse=True)[1]


def _means(x: np.ndarray, mass: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    centre = x[rng.choice(len(x), min(count, len(x)), replace=False, p=mass / mass.sum())]
    for _ in range(12):
        near = (x @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
        total = np.bincount(near, mass, len(centre))
        moved = np.stack([np.bincount(near, mass * x[:, j], len(centre)) for j in range(x.shape[1])], 1)
        centre = np.where(total[:, None] > 0, moved / np.maximum(total, 1e-9)[:, None], centre).astype(np.float32)
    return near


def kept(counts: np.ndarray, own_rows: int = 4096) -> np.ndarray:
    """The ids with a place of their own: the most frequent ones."""
    return np.argsort(-counts, kind="stable")[: max(1, min(own_rows, int((counts > 0).sum())))]


def train(docs: list[np.ndarray], counts: np.ndarray, classes: int = 16, own_rows: int = 4096, steps: int = 1200, batch: int = 64, seed: int = 11, near: np.ndarray | None = None) -> Model:
    """A model from sequences of ids, each with its end, and counts of all ids over the whole training part.

    near: what stands beside each known id (beside) in the whole training part; where it isn't given, docs are that part.
    """
    ids = np.concatenate(docs).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    known = kept(counts, own_rows)
    model = Model(counts, known, classify(beside(ids, known, counts, seed) if near is None else near, counts[known], classes, seed), seed)
    model.losses = model.learn(*windows(ids, bounds), steps, batch, seed)
    return model


def _encoded(text: str, encode) -> np.ndarray:
    return np.array(encode("".join(" " + w.decode() for w in text.encode().lower().split())) + [END])


def parts(batches: Iterator[pa.RecordBatch], path: str, part_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of all texts of the batches, each with its end, and their bounds: some `part_bytes` of text at once.

    Each distinct word of a part is encoded once.
    """
    encode = encoder(path)[0]
    for table in slices(batches, "text", part_bytes):
        codes, words, offsets = lower_words(texts_of(table, "text"))
        each = [encode(" " + w) for w in words.to_pylist()] + [[END]]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((k for x in each for k in x), np.int32, int(sizes.sum()))
        codes = np.insert(codes, offsets[1:], len(each) - 1)
        own = sizes[codes]
        first = (np.cumsum(sizes) - sizes)[codes] - (np.cumsum(own) - own)
        ids = flat[np.repeat(first, own) + np.arange(int(own.sum()))]
        yield ids, np.append(0, np.cumsum(own))[np.append(0, offsets[1:] + np.arange(1, len(offsets)))]


def sequences(block: Block, most: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of a block's documents of at most `most` ids, or of one document: which, their ids, each with its end, and bounds."""
    lengths = np.diff(block.offsets)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    per = np.bincount(doc, block.sizes[block.codes], len(lengths)).astype(np.int64)
    reach, lo = np.append(0, np.cumsum(per + 1)), 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(reach, reach[lo] + most, "right")) - 1)
        ids = block.ids(int(block.offsets[lo]), int(block.offsets[hi])).astype(np.int32)
        yield slice(lo, hi), np.insert(ids, np.cumsum(per[lo:hi]), END), reach[lo : hi + 1] - reach[lo]
        lo = hi


def learnt(batches: Iterator[pa.RecordBatch], part_ids: int = 1_600_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What parts() gives, of the training rows of a word table whose blocks lie one after another: no text is encoded again."""
    for block in blocks(batches):
        for run, ids, bounds in sequences(block, part_ids):
            marks, per = block.marks[run], np.diff(bounds)
            if marks.any():
                yield ids[np.repeat(marks, per)], np.append(0, np.cumsum(per[marks]))


def _training(docs: DataFrame, path: str, part_bytes: int) -> tuple[DataFrame, Callable]:
    """Rows of texts, all of which train, or of a word table with its marks, and what gives their ids in an executor."""
    if {"block", "kind", "payload"} <= set(docs.columns):
        return docs.filter("kind < 2").select("block", "kind", "payload").repartition("block").sortWithinPartitions("block"), learnt
    return docs.select(F.col("text").cast("string").alias("text")), lambda batches: parts(batches, path, part_bytes)


def surroundings(docs: DataFrame, path: str, known: np.ndarray, counts: np.ndarray, seed: int, part_bytes: int = 4_000_000) -> np.ndarray:
    """beside() over all texts of docs (text), or over the training rows of a word table."""
    bound = docs.sparkSession.sparkContext.broadcast((known, counts))
    rows, read = _training(docs, path, part_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((len(bound.value[0]), 48))
        for ids, _ in read(batches):
            total += beside(np.append(END, ids), *bound.value, seed)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pack(total.ravel())], pa.binary())], ["part", "payload"])

    sums = added(cut(rows.mapInArrow(mapped(run), "part int, payload binary")), 8)
    return sum((x[0] for x in sums), np.zeros(len(known) * 48)).reshape(-1, 48)


def refine(docs: DataFrame, path: str, model: Model, seed: int, steps: int, batch: int, part_bytes: int = 4_000_000, top: float = 4e-3) -> None:
    """Trains the model further on all windows of every part of docs (text; or the training rows of a word table), some
    `part_bytes` of text each, and averages what comes out by the parts' windows.

    Each part starts from the same model and makes `steps` steps at least. Sums of parts are added up in groups. An empty
    table changes nothing.
    """
    bound = docs.sparkSession.sparkContext.broadcast(model)
    names = list(model.p)
    rows, read = _training(docs, path, part_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copy import copy

        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        total, seen, count = None, 0, 0
        for ids, bounds in read(batches):
            local = copy(bound.value)
            local.p = {n: x.copy() for n, x in bound.value.p.items()}
            given, goal = (x.astype(np.int32) for x in windows(ids, bounds))
            local.learn(given, goal, steps, batch, int(np.random.default_rng([seed, number, count]).integers(1 << 62)), top, whole=True)
            moved = [(local.p[n].astype(np.float64) - bound.value.p[n]) * len(given) for n in names]
            total = moved if total is None else [a + b for a, b in zip(total, moved, strict=True)]
            seen, count = seen + len(given), count + 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pack(np.array([float(seen)]), *[x.ravel() for x in total])], pa.binary())], ["part", "payload"])

    sums = added(cut(rows.mapInArrow(mapped(run), "part int, payload binary")), 8)
    if sums:
        count = sum(float(x[0][0]) for x in sums)
        for k, name in enumerate(names):
            moved = sum(x[k + 1] for x in sums) / count
            model.p[name] = (model.p[name] + moved.reshape(model.p[name].shape)).astype(np.float32)


def sample(docs: DataFrame, path: str, rows: int, most_chars: int, seed: int) -> list[np.ndarray]:
    """Ids of at most `rows` training texts of at most `most_chars` characters, those with the least hash."""
    encode = encoder(path)[0]
    return [_encoded(text, encode) for text in drawn(docs, docs.filter("trained"), rows, seed, most_chars)] or [np.array([END])]


def added(rows: DataFrame, fan: int = 32) -> list[list[np.ndarray]]:
    """Packed vectors (part, payload) of all partitions, added up in groups of `fan` until so few are left for the driver."""

    def total(own: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        for payload in own.column("payload").to_pylist():
            for k, x in enumerate(unpack(payload)):
                if k == len(out):
                    out.append(x.copy())
                elif len(x) > len(out[k]):
                    x = x.copy()
                    x[: len(out[k])] += out[k]
                    out[k] = x
                else:
                    out[k][: len(x)] += x
        return pa.table({"part": pa.array([own.column("part")[0].as_py() // fan], pa.int32()), "payload": pa.array([pack(*out)], pa.binary())})

    parts = 1 + (rows.agg(F.max("part")).first()[0] or 0)
    while parts > fan:
        rows = rows.groupBy((F.col("part") / fan).cast("int").alias("group")).applyInArrow(grouped(total), "part int, payload binary")
        parts = -(-parts // fan)
    return [unpack(r["payload"]) for r in rows.select("payload").collect()]


def score(docs: DataFrame, path: str, held: tuple[int, int] = (7, 2), rows: int = 1200, most_chars: int = 20_000, classes: int = 16, steps: int = 1200, part_steps: int = 24, batch: int = 64, part_batch: int = 256, seed: int = 11) -> DataFrame:
    """Scores every row's whole text; learns from rows whose crc32(doc_id) modulo held[0] is not held[1].

    A null text is an empty one: its only token is the end. Repeated rows are scored each, and count each; a null
    doc_id is hashed as an empty text; other columns are ignored. The attention model learns from every id of every
    training row (refine), beginning with at most `rows` texts of at most `most_chars` characters on the driver, which only
    give all parts one start; classes, word counts, id counts and the totals are of all training rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("trained", remainder(F.col("doc_id"), held[0]) != held[1])
    table = cut(resolved(own, lower_words, path, counted=True, weight="trained", before=" "))
    n_docs = own.filter("trained").count()
    sums, counts = np.zeros(2), np.zeros(len(encoder(path)[1]))
    for part, by_id in added(table.filter("kind = 2").select("part", "payload")):
        sums += part
        counts[: len(by_id)] += by_id
    distinct, total = int(sums[0]) + (n_docs > 0), int(sums[1]) + n_docs
    counts[END] += n_docs
    near = surroundings(table, path, kept(counts), counts, seed)
    model = train(sample(own, path, rows, most_chars, seed), counts, classes, steps=steps, batch=batch, seed=seed, near=near)
    refine(table, path, model, seed, part_steps, part_batch)
    bound = docs.sparkSession.sparkContext.broadcast(model)
    end_known = np.log10(n_docs + 1)

    def join(part: pa.Table) -> pa.Table:
        block, own = Block(part), bound.value
        n = len(block.doc_ids)
        ready = own.tables()
        gain = np.log10(block.weights + 1.0)
        lengths = np.diff(block.offsets)
        doc = np.repeat(np.arange(n), lengths)
        base = np.bincount(doc, gain[block.codes], n) + end_known
        known = np.bincount(doc, block.weights[block.codes] > 0, n).astype(np.int64) + (n_docs > 0)
        scores = np.zeros(n)
        for run, ids, bounds in sequences(block, 750_000):
            scores[run] = np.add.reduceat(own.predict(ids, bounds, ready), bounds[:-1])
        return pa.table({"doc_id": pa.array(block.doc_ids, mask=~block.known), "held_out": pa.array(~block.marks), "n_tokens": pa.array(lengths + 1), "n_known": pa.array(known), "base_sum": pa.array(base), "score": pa.array(scores)})

    scored = table.filter("kind < 2").groupBy("block").applyInArrow(grouped(join), SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base_sum") - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), "score")
