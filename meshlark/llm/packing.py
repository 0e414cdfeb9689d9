"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces (documents, or slices of ones longer than the greatest capacity) are taken longest first. A piece goes to the open bin that it
leaves the least room in; if none has room a bin is opened, of the capacity with the least net cost: its cost less what its free
room is worth, at the best cost per token and the share of free room that bins have been filled to so far. In the end each bin is
downsized to the least capacity that holds its contents.

Documents are dealt by hash to blocks of about ``BLOCK_DOCS``; each block is packed on its own, so no bin crosses blocks.

Defined results: null or empty text has its end id alone; a null doc_id is packed like any other; repeated rows are packed each.
An empty table gives no rows; other columns are ignored. A very long text is counted whole, in one task, and packed as slices of the greatest capacity.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm.bpe import tokenizer_path
from meshlark.llm.common import enter
from meshlark.llm.token_store import END_ID, word_encoder

CAPACITIES, BLOCK_DOCS = (512, 1024, 2048, 4096, 8192), 20_000
OUT = "doc_id bigint, piece int, start bigint, n_tokens bigint, bin_id bigint, capacity int, bin_offset int"


def bin_cost(capacity: int, overhead: float = 32.0, square: float = 1 / 65536) -> float:
    """Tokens, a fixed part for each sequence, and attention's square."""
    return capacity + overhead + square * capacity * capacity


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost=bin_cost) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset of each piece, capacity of each bin) for pieces no longer than the greatest capacity."""
    sizes = sorted(capacities)
    rate = min(cost(c) / c for c in sizes)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    which, offset, used, room = [0] * len(lengths), [0] * len(lengths), [], []  # room: sorted (free, bin)
    opened = placed = 0  # free room at opening, and what of it has been filled
    for i in order:
        n = lengths[i]
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
            placed += n
        else:
            fill = (placed + 1) / (opened + 1) if opened else 0.9
            c = min((c for c in sizes if c >= n), key=lambda c: (cost(c) - min(fill, 1.0) * rate * (c - n), c))
            free, b = c, len(used)
            used.append(0)
            opened += c - n
        which[i], offset[i] = b, used[b]
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return which, offset, [sizes[bisect_left(sizes, u)] for u in used]


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("words")
        enc = word_encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                p = b.slice(at, 256)
                n = enc.count_batch([t or "" for t in p.column(1).to_pylist()], END_ID)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(n, pa.int64()), p.column(2)], ["doc_id", "n_tokens", "block"])

    return run


def _pack(capacities: tuple[int, ...]):
    most = max(capacities)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("n_tokens").to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        block = table.column("block")[0].as_py()
        ids, piece, start, size = [], [], [], []
        for doc_id, n in rows:
            for k, at in enumerate(range(0, max(n, 1), most)):
                ids.append(doc_id)
                piece.append(k)
                start.append(at)
                size.append(min(most, n - at))
        which, offset, caps = best_fit(size, capacities)
        which, caps = np.array(which, dtype=np.int64), np.array(caps, dtype=np.int32)
        cols = (ids, piece, start, size, (np.int64(block) << 32) + which, caps[which], offset)
        return pa.table({f.split(" ")[0]: pa.array(c, t) for f, c, t in zip(OUT.split(", "), cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)})

    return run


def pack_lengths(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """``lengths``: doc_id, n_tokens, block -> one row per piece."""
    return lengths.groupBy("block").applyInArrow(_pack(tuple(capacities)), OUT)


def pack_documents(documents: DataFrame, capacities: tuple[int, ...] = CAPACITIES, path: str | None = None) -> DataFrame:
    """doc_id, piece, start (ids of the document before it), n_tokens, bin_id, capacity, bin_offset."""
    blocks = max(1, -(-documents.count() // BLOCK_DOCS))
    d = documents.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    n = d.mapInArrow(_lengths(path or tokenizer_path("word_bpe_49k.json")), "doc_id bigint, n_tokens bigint, block bigint")
    return pack_lengths(n, capacities)


def op2_packing(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return pack_documents(documents)
