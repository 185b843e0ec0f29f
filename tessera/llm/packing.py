"""Best-fit packing of token pieces by local search (operator 9)."""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, trim
from .wordtable import Block, chunks, resolved

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, alone long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, path: str, most: int = 1024, end: int = 2) -> DataFrame:
    """Pieces of at most `most` ids of every row's text with `end` after it; only a document's first piece may be shorter.

    A null text is an empty one and gives the end alone. uid tells rows with equal doc_id apart; alone is
    the number of the sequence that a piece of `most` ids fills by itself.
    """

    def join(table: pa.Table) -> pa.Table:
        block = Block(table)
        out: list[list] = [[], [], [], [], [], [], []]
        full = 0
        for k in range(len(block.doc_ids)):
            ids = np.append(block.ids(int(block.offsets[k]), int(block.offsets[k + 1])), end).astype("<u4")
            first = len(ids) % most or most
            start = 0
            for piece, stop in enumerate(range(first, len(ids) + 1, most)):
                for column, value in zip(out, (int(block.doc_ids[k]) if block.known[k] else None, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), (block.block << 24) + k, -1 - (block.block << 24) - full if stop - start == most else None), strict=True):
                    column.append(value)
                full += stop - start == most
                start = stop
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "piece", "start", "length", "ids_crc32", "uid", "alone"), out, kinds, strict=True)})

    return resolved(docs, chunks, path).groupBy("block").applyInArrow(grouped(join), PIECES)


def pack(items: DataFrame, most: int = 1024, group: int = 16_384, rounds: int = 4, spread: int | None = None) -> DataFrame:
    """Puts each piece into one sequence of at most `most` tokens: sequence_id, and offset in it without gaps.

    Groups of about `group` pieces, dealt by a hash, are packed each in one task, which wastes less than a
    sequence a group; what stays in underfull sequences after the local search is dealt and packed again
    in groups made from many (spread of them), so that waste falls with each level and no task sees an unbounded set.
    An empty table gives no rows; equal pieces are packed each.
    Pieces need 1 <= length <= most; ties go by length, uid and piece, so equal input is packed alike.
    """
    if spread is None:
        spread = max(1, math.ceil(items.count() / group))

    def settle(level: int, last: bool):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            order = np.lexsort((table.column("piece").to_numpy(), table.column("uid").to_numpy(), -table.column("length").to_numpy()))
            table = table.take(pa.array(order))
            lengths = table.column("length").to_numpy()
            place, offset, fill = fit(lengths, most, rounds)
            done = np.ones(len(lengths), bool) if last else fill[place] >= most - most // 64
            trim()
            number = (np.int64(level) << 58) + (np.int64(key[0].as_py()) << 24) + place
            columns = [table.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "uid")]
            return pa.table([*columns, pa.array(number, pa.int64(), mask=~done), pa.array(offset.astype(np.int64))], names=["doc_id", "piece", "start", "length", "ids_crc32", "uid", "sequence_id", "offset"])

        return run

    shape = PIECES.removesuffix(", alone long") + ", sequence_id long, offset long"
    dealt = lambda df, n, salt: df.withColumn("group", F.pmod(F.xxhash64("uid", "piece", F.lit(salt)), F.lit(n)))
    full = items.filter(F.col("length") >= most)
    rest = items.filter(F.col("length") < most).drop("alone")
    first = dealt(rest, spread, 0).groupBy("group").applyInArrow(settle(0, spread == 1), shape)
    whole = full.withColumn("sequence_id", F.col("alone")).withColumn("offset", F.lit(0).cast("long"))
    if spread == 1:
        return whole.select(*_columns()).unionByName(first.select(*_columns()))
    from ..session import cut

    first = cut(first)
    left = first.filter(F.col("sequence_id").isNull())
    fewer = max(1, spread // 32)
    second = dealt(left, fewer, 1).groupBy("group").applyInArrow(settle(1, True), shape)
    return whole.select(*_columns()).unionByName(first.filter(F.col("sequence_id").isNotNull()).select(*_columns())).unionByName(second.select(*_columns()))


def _columns() -> list[str]:
    return ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def fit(lengths: np.ndarray, most: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece (sorted by falling length), and fill of each bin."""
    bins = best_fit(lengths.tolist(), most)
    bins = [b for b in improve(lengths, bins, most, rounds) if b]
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, own in enumerate(bins):
        at = 0
        for i in own:
            place[i], offset[i] = k, at
            at += int(lengths[i])
    return place, offset, np.array([int(lengths[own].sum()) for own in bins], np.int64)


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Each piece, the longest first, into the bin with the least room that holds it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # distinct, sorted
    for i, n in enumerate(lengths):
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            k = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            room, k = most, len(bins)
            bins.append([])
        bins[k].append(i)
        if left := room - n:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(k)
    return bins


def improve(lengths: np.ndarray, bins: list[list[int]], most: int, rounds: int, patience: int = 64) -> list[list[int]]:
    """Local search among all underfull bins: moves, one-for-one and two-for-one exchanges that raise the sum of squared fills.

    A donor, from the emptiest bin on, gives one or two pieces to another underfull bin, against none or one of its
    pieces, so that what it gives is more by at most the other's room; of all such exchanges with all pieces of all
    other bins the one that moves most is made, until none is left or the donor is empty. Passes over the donors
    go on until nothing changes, for `rounds` at most. The search ends where as few bins are used as the lengths allow,
    and a pass after `patience` donors in turn that could not be emptied: those after them are fuller still.
    """
    fill = [int(lengths[b].sum()) for b in bins]
    least = -(-int(lengths.sum()) // most)
    used = sum(f > 0 for f in fill)
    for _ in range(rounds):
        changed = False
        under = sorted((k for k in range(len(bins)) if 0 < fill[k] < most), key=lambda k: fill[k])
        failed = 0
        for place, b in enumerate(under):
            if used <= least:
                return bins
            if failed == patience:
                break
            others = [k for k in under[place + 1 :] if fill[k] < most]
            while others and bins[b]:
                step = _exchange(lengths, bins, fill, b, others, most)
                if step is None:
                    break
                a, give, take = step
                moved = sum(int(lengths[i]) for i in take) - sum(int(lengths[i]) for i in give)
                bins[a] = [i for i in bins[a] if i not in give] + take
                bins[b] = [i for i in bins[b] if i not in take] + give
                fill[a] += moved
                fill[b] -= moved
                changed = True
                if fill[a] == most:
                    others.remove(a)
            used -= not bins[b]
            failed = failed + 1 if bins[b] else 0
        if not changed:
            break
    return bins


def _exchange(lengths: np.ndarray, bins: list[list[int]], fill: list[int], b: int, others: list[int], most: int) -> tuple[int, list[int], list[int]] | None:
    """The exchange that moves most out of bin b: (bin, pieces it gives, pieces it takes from b).

    Lengths are small whole numbers, so for each sum of one or two pieces of b the shortest piece that may go
    for it is looked up: no pair of bins is tried by itself.
    """
    held = np.concatenate([[-1], *[bins[k] for k in others]]).astype(np.int64)[1:]
    owner = np.repeat(others, [len(bins[k]) for k in others])
    # nothing at all, as a piece of length 0 in each bin, then their pieces
    size = np.concatenate([np.zeros(len(others), np.int64), lengths[held]])
    whose = np.concatenate([others, owner]).astype(np.int64)
    filled = np.array(fill, np.int64)[whose]
    reach = size + most - filled
    stays = filled - size  # in the other bin: the squared fill grows if more stays there than in b
    order = np.lexsort((-stays, -reach, size))
    size, reach, stays = size[order], reach[order], stays[order]
    sums: dict[int, list[int]] = {}
    own = sorted(bins[b], key=lambda i: -int(lengths[i]))
    distinct: dict[int, list[int]] = {}
    for i in own:
        distinct.setdefault(int(lengths[i]), []).append(i)
    for n, same in distinct.items():
        sums.setdefault(n, [same[0]])
    sizes = list(distinct)
    for x, n in enumerate(sizes):
        for m in sizes[x:]:
            if n + m <= most and n + m not in sums and (n != m or len(distinct[n]) > 1):
                sums[n + m] = [distinct[n][0], distinct[m][0] if n != m else distinct[n][1]]
    best, found = 0, None
    for total, take in sums.items():
        # shorter pieces come first: the first that fits moves most for this sum
        end = int(np.searchsorted(size, total - best, "left"))
        fits = np.flatnonzero((reach[:end] >= total) & (stays[:end] > fill[b] - total))
        if len(fits):
            at = int(fits[0])
            best, found = total - int(size[at]), (int(order[at]), take)
    if found is None:
        return None
    at, take = found
    return int(whose[at]), [] if at < len(others) else [int(held[at - len(others)])], take


def packed(docs: DataFrame, path: str, most: int = 1024, end: int = 2) -> DataFrame:
    """pieces() of all rows, packed; the pieces are cut off from their lineage once, as both counts and packing read them."""
    from ..session import cut

    return pack(cut(pieces(docs, path, most, end)), most)
