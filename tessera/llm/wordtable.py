"""The distinct-word table behind encoding, packing and language-model scoring.

Documents are cut into blocks of consecutive rows. A block sends each of its distinct words once, with
how often it stands in training rows, to the word's bucket, and its documents as a sequence of word
numbers to itself. A bucket has every row of its words: it resolves each distinct word once (ids, counts
over the whole corpus) and answers each block. A block then joins the answers to its documents by
position. A word that a third of all rows hold is one entry per block, so no key is hot; a task holds
one block, or the distinct words of its buckets.
"""

from __future__ import annotations

import array
import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_ids, mapped, pack, slices, unpack

#: Unicode's White_Space, as the pre-tokenizer's \s has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
SPECIAL = "<|endoftext|>"
ROWS = "part int, block long, kind int, payload binary"


@functools.lru_cache(2)
def encoder(path: str):
    """A tokenizers JSON of a byte-level BPE as (encode one chunk, piece bytes by id).

    The library spends most of its time on offsets and objects that nothing here uses, so the same
    merges run through tiktoken; ids must be in merge order, which is checked.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = spec["model"]["vocab"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
    for i, merge in enumerate(spec["model"]["merges"]):
        pair = merge if isinstance(merge, list) else merge.split(" ")
        if vocab["".join(pair)] != 256 + i:
            raise ValueError("the vocabulary's ids are not in merge order")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (1 + max([*ranks.values(), *special.values()]))
    for piece, i in ranks.items():
        pieces[i] = piece
    for text, i in special.items():
        pieces[i] = text.encode()
    plain = core.encode_ordinary
    return (lambda chunk: [special[chunk]] if chunk in special else plain(chunk)), pieces


def chunks(texts: list[str]) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Texts as chunks that can be encoded apart: (number of the chunk, distinct chunks, first chunk of each text).

    A chunk is white space and what follows it; no piece of the pre-tokenizer crosses its edges. Texts
    with a run of spaces or a special token are cut by the rule, all others at each single space.
    """
    odd = [i for i, x in enumerate(texts) if "  " in x or SPECIAL in x or x[:1] == " " or x[-1:] == " " or not x]
    odd_set = set(odd)
    even = [i for i in range(len(texts)) if i not in odd_set]
    counts = np.zeros(len(texts), np.int64)
    words, firsts = _split([texts[i] for i in even])
    counts[even] = np.diff(np.append(firsts, len(words)))
    encoded = words.dictionary_encode()
    codes, shown = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    n = len(shown)
    starts, initial = np.unique(codes[firsts], return_inverse=True) if len(firsts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    codes[firsts] = n + initial
    tables = [pc.binary_join_element_wise(pa.scalar(""), shown, " ") if n else shown, shown.take(pa.array(starts))]
    more: dict[str, int] = {}
    runs = []
    for i in odd:
        cut = [x for part in re.split(f"({re.escape(SPECIAL)})", texts[i]) for x in ([part] if part == SPECIAL else _CHUNK.findall(part))]
        counts[i] = len(cut)
        runs.append(np.fromiter((more.setdefault(x, len(more)) for x in cut), np.int64, len(cut)))
    tables.append(pa.array(list(more), pa.string()))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if odd:
        joined = np.empty(int(offsets[-1]), np.int64)
        place = np.ones(int(offsets[-1]), bool)
        for i, run in zip(odd, runs, strict=True):
            joined[offsets[i] : offsets[i + 1]] = run + n + len(starts)
            place[offsets[i] : offsets[i + 1]] = False
        joined[place] = codes
        codes = joined
    return codes, pa.concat_arrays([x.cast(pa.string()) for x in tables]), offsets


def _split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    if not texts:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
    return parts.values, parts.offsets.to_numpy()[:-1].astype(np.int64)


def lower_words(texts: list[str]) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Words between ASCII white space with A-Z in lower case, numbered as chunks() does."""
    counts = np.zeros(len(texts), np.int64)
    flat: list[bytes] = []
    for i, x in enumerate(texts):
        cut = x.encode().lower().split()  # of bytes: A-Z and ASCII white space only
        counts[i] = len(cut)
        flat += cut
    encoded = pa.array(flat, pa.binary()).dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.cast(pa.string()), np.concatenate([[0], np.cumsum(counts)])


def deal(docs: DataFrame, split: Callable, buckets: int, weight: str | None = None, block_bytes: int = 16_000_000) -> DataFrame:
    """Blocks of documents (doc_id, text and, with weight, a boolean column) as rows for buckets and for themselves.

    kind 0: words of a block for a bucket; kind 1: a block's documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = (TaskContext.get().partitionId() << 18) - 1
        for table in slices(batches, "text", block_bytes):
            block += 1
            ids, known = column_ids(table, "doc_id")
            codes, words, offsets = split([x or "" for x in table.column("text").to_pylist()])
            n = len(words)
            marks = table.column(weight).to_numpy().astype(bool) if weight else np.ones(len(ids), bool)
            counts = np.bincount(codes, minlength=n)
            trained = np.bincount(codes[np.repeat(marks, np.diff(offsets))], minlength=n) if weight else np.zeros(0, np.int64)
            # slots: the most frequent first, then by first use; words used once need no number in the sequence
            first = np.empty(n, np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            by_slot = np.lexsort((first, -counts))
            slot = np.empty(n, np.int64)
            slot[by_slot] = np.arange(n)
            several = int((counts > 1).sum())
            raw = words.cast(pa.binary()).to_pylist()
            bucket = np.fromiter((zlib.crc32(raw[i]) % buckets for i in by_slot.tolist()), np.int64, n)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            parts, payloads = [], []
            for b in range(buckets):
                if (slots := order[edges[b] : edges[b + 1]]).size:
                    own = by_slot[slots]
                    text = b"".join(mine := [raw[i] for i in own.tolist()])
                    sizes = np.fromiter(map(len, mine), np.uint32, own.size)
                    parts.append(b)
                    payloads.append(pack(np.diff(slots, prepend=0).astype(np.uint32), trained[own].astype(np.uint32) if weight else np.zeros(0, np.uint32), sizes, np.frombuffer(text, np.uint8)))
            kinds = [0] * len(parts) + [1]
            parts.append(block % buckets)
            payloads.append(pack(ids, known.astype(np.uint8), marks.astype(np.uint8), offsets.astype(np.uint32), np.array([several], np.uint32), *halves(np.minimum(slot[codes], several))))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], ["part", "block", "kind", "payload"])

    return docs.mapInArrow(mapped(run), ROWS).repartition(buckets, "part")


def halves(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers as high parts, low bytes of those under 256 and of the others, which compress apart."""
    high, low = (codes >> 8).astype(np.uint32), (codes & 255).astype(np.uint8)
    return high, low[high == 0], low[high > 0]


def whole(high: np.ndarray, small: np.ndarray, large: np.ndarray) -> np.ndarray:
    low = np.empty(len(high), np.uint32)
    low[high == 0], low[high > 0] = small, large
    return (high << np.uint32(8)) | low


def answer(rows: DataFrame, path: str | None, counted: bool, before: str = "") -> DataFrame:
    """Resolves each distinct word once: ids of the encoder at path, and with counted its weight over all blocks.

    before stands before each word when it is encoded. Rows keep their shape; with counted, kind 2 has a
    partition's sums: words with weight and their weight, and the weight of each id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pieces = encoder(path) if path else (None, [])
        if len(pieces) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        number: dict[bytes, int] = {}
        ids: list[bytes] = []  # of each word, 16 bits an id: an array for each would take three times as much
        totals = np.zeros(1024, np.int64)

        def words(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nonlocal totals
            slots, weights, sizes, text = unpack(payload)
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            raw, at, mine = text.tobytes(), 0, []
            for end in ends:
                word = raw[at:end]
                at = end
                if (k := number.get(word)) is None:
                    k = number[word] = len(number)
                    if encode:
                        ids.append(array.array("H", encode(before + word.decode())).tobytes())
                mine.append(k)
            if len(number) > len(totals):
                totals = np.concatenate([totals, np.zeros(len(number), np.int64)])
            return slots, weights, np.array(mine, np.int64)  # slots as gaps, which a reply repeats

        def reply(slots: np.ndarray, mine: np.ndarray) -> bytes:
            own = [ids[k] for k in mine.tolist()] if encode else []
            sizes = np.fromiter(map(len, own), np.int64, len(own)) // 2
            return pack(slots, totals[mine] if counted else np.zeros(0, np.int64), sizes.astype(np.uint32), np.frombuffer(b"".join(own), np.uint16))

        held = []
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for part, block, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    slots, weights, mine = words(payload)
                    if counted:
                        totals[mine] += weights  # a block's words are distinct
                        held.append((part, block, pack(slots, mine.astype(np.uint32))))
                        continue
                    payload = reply(slots, mine)
                for column, value in zip(out, (part, block, kind, payload), strict=True):
                    column.append(value)
            yield _rows(out)
        for part, block, packed in held:
            slots, mine = unpack(packed)
            yield _rows([[part], [block], [0], [reply(slots, mine.astype(np.int64))]])
        if counted:
            own = totals[: len(number)]
            flat = np.frombuffer(b"".join(ids), np.uint16)
            each = np.repeat(own, [len(x) // 2 for x in ids]) if ids else np.zeros(0)
            by_id = np.bincount(flat, each).astype(np.int64)
            from pyspark import TaskContext

            yield _rows([[TaskContext.get().partitionId()], [-1], [2], [pack(np.array([(own > 0).sum(), own.sum()], np.int64), by_id)]])

    return rows.mapInArrow(mapped(run), ROWS)


def _rows(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], ["part", "block", "kind", "payload"])


class Block:
    """A block's documents with the answers to its words: the join by position."""

    def __init__(self, table: pa.Table) -> None:
        kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        replies = []
        for kind, payload in zip(kinds, payloads, strict=True):
            if kind == 1:
                self.doc_ids, known, marks, offsets, several, *parts = unpack(payload)
                self.codes = whole(*parts)
                once = self.codes == several[0]
                self.codes[once] = several[0] + np.arange(once.sum(), dtype=np.uint32)
                self.known, self.marks = known.astype(bool), marks.astype(bool)
                self.offsets = offsets.astype(np.int64)
            else:
                replies.append(unpack(payload))
        self.block = table.column("block")[0].as_py()
        n = sum(len(r[0]) for r in replies)
        slots = np.concatenate([np.cumsum(r[0], dtype=np.int64) for r in replies]) if replies else np.zeros(0, np.uint32)
        place = np.argsort(slots, kind="stable")
        if not np.array_equal(slots[place], np.arange(n)):
            raise ValueError("a block's words are not answered once each")
        self.weights = np.concatenate([r[1] for r in replies])[place] if replies and len(replies[0][1]) == len(replies[0][0]) else np.zeros(n, np.int64)
        sizes = np.concatenate([r[2] for r in replies]) if replies else np.zeros(0, np.uint32)
        if len(sizes) == n and n:
            begin = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]
            self.flat = np.concatenate([r[3] for r in replies])
            self.begin, self.sizes = begin[place], sizes[place].astype(np.int64)
        else:
            self.flat, self.begin, self.sizes = np.zeros(0, np.uint16), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids of the words at positions lo to hi."""
        codes = self.codes[lo:hi]
        sizes = self.sizes[codes]
        total = int(sizes.sum())
        shift = self.begin[codes] - np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(codes) else sizes
        return self.flat[np.repeat(shift, sizes) + np.arange(total)]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks, one at a time, of batches whose rows (block, kind, payload) lie by block."""
    held, last = [], None
    for batch in batches:
        numbers = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            if held and numbers[lo] != last:
                yield Block(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = numbers[lo]
    if held:
        yield Block(pa.Table.from_batches(held))


def resolved(docs: DataFrame, split: Callable, path: str | None, counted: bool = False, weight: str | None = None, before: str = "") -> DataFrame:
    """deal() and answer() with half as many buckets as the session has shuffle partitions."""
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    wanted = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")] + ([F.col(weight)] if weight else [])
    return answer(deal(docs.select(*wanted), split, buckets, weight), path, counted, before)
