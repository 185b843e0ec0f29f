"""What several operators share: bounded slices of Arrow batches, packed arrays, hashes, words."""

from __future__ import annotations

import ctypes
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

_libc = ctypes.CDLL(None)
if not hasattr(_libc, "malloc_trim"):
    _libc = None
#: ASCII white space, as bytes.split() and the class [\x20\x09-\x0D] have it.
SPACE = b" \t\n\x0b\x0c\r"
#: Java form of a word of the contracts, for split() and regexp functions in Spark SQL.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def trim() -> None:
    """Gives memory that is free in this process back to the system: idle workers otherwise keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def mapped(run: Callable) -> Callable:
    """A function for mapInArrow after which its worker keeps no free memory."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return go


def grouped(run: Callable) -> Callable:
    """The same for a function of one group for applyInArrow."""

    def go(part: pa.Table) -> pa.Table:
        try:
            return run(part)
        finally:
            trim()

    return go


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000, rows: int = 65_536) -> Iterator[pa.Table]:
    """Runs of at most `rows` consecutive rows whose text has at most `most` bytes, or of one row; rows are never cut."""
    held, size, count = [], 0, 0
    for batch in batches:
        lengths = byte_lengths(batch.column(text))
        start = 0
        while start < batch.num_rows:
            reach = np.cumsum(lengths[start:])
            n = min(int(np.searchsorted(reach, most - size, side="right")), rows - count)
            if n == 0 and not held:
                n = 1
            if n:
                held.append(batch.slice(start, n))
                size += int(reach[n - 1])
                count += n
                start += n
            if start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size, count = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of one significance lie together."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T if a.size else np.zeros(0, np.uint8)
        blob = zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)
        head.append([a.dtype.str, int(a.size), len(blob)])
        body.append(blob)
    top = json.dumps(head).encode()
    return struct.pack("<I", len(top)) + top + b"".join(body)


def unpack(value: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", value)
    out, at = [], 4 + n
    for kind, size, length in json.loads(value[4 : 4 + n]):
        dtype = np.dtype(kind)
        if size:
            raw = np.frombuffer(zstandard.decompress(value[at : at + length]), np.uint8)
            out.append(np.ascontiguousarray(raw.reshape(dtype.itemsize, size).T).view(dtype).reshape(-1))
        else:
            out.append(np.zeros(0, dtype))
        at += length
    return out


def column_ids(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """An id column as longs, and where it is not null."""
    import pyarrow.compute as pc

    column = table.column(name)
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy().astype(np.int64), pc.is_valid(column).to_numpy()


def texts_of(table: pa.Table, name: str) -> list[str]:
    return [x or "" for x in table.column(name).to_pylist()]


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two 64-bit values, element by element (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def remainder(column, n: int):
    """crc32 of an id as text, modulo n; a null id counts as an empty text."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def drawn(docs, among, rows: int, seed: int, most_chars: int) -> list[str]:
    """At most `rows` texts of at most `most_chars` characters of docs whose doc_id is among those of `among`: those
    with the least hashes of their ids.

    Ids are chosen first, so no text is moved but those drawn. An id that stands on several rows gives one text, so no
    more than `rows` rows come to the driver however often an id is repeated.
    """
    from pyspark.sql import functions as F

    fits = F.coalesce(F.length("text"), F.lit(0)) <= most_chars
    order = F.xxhash64("doc_id", F.lit(seed))
    short = docs.filter("doc_id is not null").filter(fits).select("doc_id").distinct().join(among.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = [r[0] for r in short.orderBy(order, "doc_id").limit(rows).collect()]
    if not ids:
        return []
    own = docs.select("doc_id", "text").filter(F.col("doc_id").isin(ids)).filter(fits).groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()
    place = {d: k for k, d in enumerate(ids)}
    return [r["text"] for r in sorted(own, key=lambda r: place[r["doc_id"]])]
