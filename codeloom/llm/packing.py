"""Best-fit packing of documents into token sequences, by large-item matching.

Lengths are whole numbers up to the capacity, so the whole corpus is a histogram of that many
entries at most. The packing is made on the histogram: each step places all documents of one
length into one class of equal bins, so its work and its result depend on the capacity and
not on the number of documents. Documents then find their place by their length and their
rank among documents of that length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.scratch import cut, ranked
from codeloom.llm.tokens import by_bytes, chunk_tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Bins:
    """Classes of equal open bins, found by the room left."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.by_room: dict[int, list[list[int]]] = {}

    def add(self, room: int, first: int, count: int, used: int) -> None:
        if room not in self.by_room:
            bisect.insort(self.rooms, room)
            self.by_room[room] = []
        self.by_room[room].append([first, count, used])

    def tightest(self, size: int) -> int | None:
        k = bisect.bisect_left(self.rooms, size)
        return self.rooms[k] if k < len(self.rooms) else None

    def take(self, room: int) -> list[int]:
        group = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.pop(bisect.bisect_left(self.rooms, room))
        return group


def plan_packing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows ``length, first_rank, count, first_bin, offset, per_bin``, ordered by length and rank.

    Documents of ``length`` with ranks first_rank + i, i < count, go to bin
    first_bin + i // per_bin, at offset + (i % per_bin) * length.

    Lengths over a third of the capacity meet at most in pairs: from the longest down, each
    takes the longest partner that still fits, which is an optimal matching for such items.
    Shorter ones, from the longest down, go to the fullest bin with room for them.
    """
    rows: list[tuple[int, ...]] = []
    placed: dict[int, int] = {}
    bins, n_bins = _Bins(), 0

    def place(length: int, count: int, first_bin: int, offset: int, per_bin: int = 1) -> None:
        rank = placed.get(length, 0)
        rows.append((length, rank, count, first_bin, offset, per_bin))
        placed[length] = rank + count

    left = {s: n for s, n in counts.items() if n > 0 and s > 0}
    if left and max(left) > capacity:
        raise ValueError("a length exceeds the capacity")
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        k = bisect.bisect_right(large, capacity - s) - 1
        t = large[k] if k >= 0 else None
        n = left[s] if t is None else left[s] // 2 if t == s else min(left[s], left[t])
        if t is None or n == 0:  # alone: no partner fits, or one is left of its own kind
            if t is not None and k > 0:
                t, n = large[k - 1], 1
            else:
                t, n = None, left[s]
        place(s, n, n_bins, 0)
        if t is not None:
            place(t, n, n_bins, s)
        bins.add(capacity - s - (t or 0), n_bins, n, s + (t or 0))
        n_bins += n
        for x in (s, t) if t is not None else (s,):
            left[x] -= n
            if not left[x]:
                large.remove(x)
                del left[x]
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            room = bins.tightest(s)
            if room is None:
                per_bin = min(capacity // s, n)
                full = n // per_bin
                place(s, full * per_bin, n_bins, 0, per_bin)
                bins.add(capacity - per_bin * s, n_bins, full, per_bin * s)
                n_bins += full
                n -= full * per_bin
                continue
            first, count, used = bins.take(room)
            per_bin = min(room // s, n)
            full = min(count, n // per_bin)
            place(s, full * per_bin, first, used, per_bin)
            n -= full * per_bin
            bins.add(room - per_bin * s, first, full, used + per_bin * s)
            if full < count:
                bins.add(room, first + full, count - full, used)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """``docs`` (doc_id, text; null text: empty) as pieces of at most ``capacity`` ids, the end id included.

    Only documents with more ids than that are cut, every ``capacity`` ids.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chunk_tokenizer(tokenizer)
        for batch in batches:
            for first, stop in by_bytes(batch.column(1)):
                ids, stops = tok.encode_column(batch.column(1).slice(first, stop - first), end_id)
                begins = np.concatenate([[0], stops[:-1]])
                n_pieces = -(-(stops - begins) // capacity)
                row = np.repeat(np.arange(len(stops)), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(stops[row] - begins[row] - start, capacity)
                at = begins[row] + start
                held = memoryview(ids.view(np.uint8))
                sums = np.fromiter((zlib.crc32(held[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(at))
                columns = [batch.column(0).slice(first, stop - first).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = PIECES + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, schema)


def pack(pieces: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to each piece. Pieces' lengths must be 1 to ``capacity``.

    ``pieces`` should be a written table, as it is read twice: for its histogram of lengths,
    and to place each piece. ``order`` must tell pieces of equal length apart.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `capacity` rows
    plan = plan_packing(counts, capacity)
    # Keys that sort by length, then rank: a piece belongs to the last row whose key isn't above its own.
    table = spark.sparkContext.broadcast((plan[:, 0] * (1 << 44) + plan[:, 1], plan))

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, rows = table.value
        size, rank = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = rows[np.searchsorted(keys, size * (1 << 44) + rank, side="right") - 1]
        i = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + i // row[:, 5], "offset": row[:, 4] + i % row[:, 5] * size})

    placed = ranked(pieces, [length], order, "_rank").withColumn("_place", place(F.col(length), F.col("_rank")))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of ``docs``.

    Repeated rows are packed each; null texts are empty documents of the end id alone; an
    empty table gives no rows.
    """
    pieces = cut(tokenized_pieces(docs, tokenizer, end_id, capacity), "pieces")
    return pack(pieces, capacity, ["doc_id", "piece", "ids_crc32"])
