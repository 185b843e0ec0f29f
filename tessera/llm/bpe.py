"""BPE encoding and decoding through a distinct-word table (operator 3)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import grouped
from .wordtable import Block, chunks, encoder, resolved

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row: whole texts, a null text as an empty one.

    Repeated rows and ids stay apart, a null doc_id stays null, other columns are ignored.
    """

    def join(table: pa.Table) -> pa.Table:
        block, pieces = Block(table), encoder(path)[1]
        ids, said = [], []
        for k in range(len(block.doc_ids)):
            own = block.ids(int(block.offsets[k]), int(block.offsets[k + 1]))
            ids.append(own.astype(np.int32))
            said.append(b"".join([pieces[i] for i in own.tolist()]).decode("utf-8", "replace"))
        return pa.table({"doc_id": pa.array(block.doc_ids, mask=~block.known), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(said, pa.string())})

    return resolved(docs, chunks, path).groupBy("block").applyInArrow(grouped(join), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """encode() with only digests of the ids and of the decoded text, so that neither is moved again."""

    def join(table: pa.Table) -> pa.Table:
        block, pieces = Block(table), encoder(path)[1]
        flat = block.flat.tolist()
        said, shown = [], []  # by distinct word: its ids as decimals, its pieces
        for at, n in zip(block.begin.tolist(), block.sizes.tolist(), strict=True):
            own = flat[at : at + n]
            said.append(",".join(map(str, own)))
            shown.append(b"".join([pieces[i] for i in own]))
        sizes = block.sizes[block.codes] if len(block.codes) else block.codes
        reach = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        out: list[list] = [[], [], [], []]
        for lo, hi in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
            codes = block.codes[lo:hi].tolist()
            text = b"".join([shown[c] for c in codes])
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode("utf-8", "replace").encode()
            for column, value in zip(out, (int(reach[hi] - reach[lo]), hashlib.sha256(",".join([said[c] for c in codes]).encode()).hexdigest(), hashlib.sha256(text).hexdigest(), len(text)), strict=True):
                column.append(value)
        return pa.table({"doc_id": pa.array(block.doc_ids, mask=~block.known), "n_tokens": pa.array(out[0], pa.int64()), "ids_sha256": pa.array(out[1], pa.string()), "decoded_sha256": pa.array(out[2], pa.string()), "n_bytes": pa.array(out[3], pa.int64())})

    return resolved(docs, chunks, path).groupBy("block").applyInArrow(grouped(join), DIGESTS)
