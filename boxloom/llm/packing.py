"""Best-fit-decreasing packing of token sequences.

Lengths are whole numbers up to the sequence size, so the packing of any number
of documents is decided on their length histogram: the driver holds at most
``size`` lengths and, for each remaining capacity, the ranges of open bins that
have it. A segment tree over the capacities finds the tightest open bin; equal
pieces go to equal bins a whole range at a time, which gives the bins that
placing piece after piece would. Executors then turn a piece's rank among those
of its length into its place. Ranks come from salted windows, so a length
that a third of all documents share is no single task.

Defined results: null texts count as empty (one end token); rows that repeat a
doc_id are packed each; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.text import slices
from boxloom.llm.tokens import encoder
from boxloom.runtime import write_table

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, end_id: int, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches):
            ids, at = enc.encode_ended(batch.column(1), end_id)
            totals = np.diff(at)
            count = -(-totals // size)
            doc = np.repeat(np.arange(len(totals)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            short = totals - (count - 1) * size  # the first piece takes what full ones leave
            start = np.where(piece == 0, 0, short[doc] + (piece - 1) * size)
            length = np.where(piece == 0, short[doc], size)
            begin = at[:-1][doc] + start
            wire = ids.astype("<u4", copy=False)
            crc = [zlib.crc32(wire[b : b + n]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:  # the pieces lie one after the other in ids
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[begin, len(ids)], pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids with the end id; only documents above ``size`` are cut, the first piece being the shorter."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cutter(tokenizer, end_id, size, with_ids), PIECE + ", ids array<int>" * with_ids)


class CapacityTree:
    """Segment tree over capacities 0..size; a leaf says whether an open bin has just that much room."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.has = [False] * (2 * self.leaves)

    def set(self, capacity: int, value: bool) -> None:
        at = capacity + self.leaves
        self.has[at] = value
        while at > 1:
            at //= 2
            self.has[at] = self.has[2 * at] or self.has[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least capacity of ``need`` or more that an open bin has."""
        at = need + self.leaves
        if self.has[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.has[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.has[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing. Rows (length, first rank, pieces, pieces a bin, first bin, offset in each bin)."""
    tree, rooms, bins, rows = CapacityTree(size), {}, 0, []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            rooms.setdefault(room, deque()).append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = size, bins, -(-left // (size // length))
                bins += n
            else:
                first, n = rooms[room].popleft()
                if not rooms[room]:
                    tree.set(room, False)
            per = room // length
            full = min(n, left // per)
            if full:
                rows.append((length, rank, full * per, per, first, size - room))
                put(room - per * length, first, full)
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if n and left and left < per:
                rows.append((length, rank, left, left, first, size - room))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                rooms.setdefault(room, deque()).appendleft((first, n))
                tree.set(room, True)
    return rows


def pack(cut: DataFrame, size: int = 1024, salted: int = 4096) -> DataFrame:
    """``cut`` (a written table of pieces) with sequence_id and offset. ``salted``: pieces a rank group holds, about."""
    spark = cut.sparkSession
    total = cut.count()
    salts = max(1, -(-total // salted))
    dealt = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = write_table(dealt.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows = plan(histogram, size)
    names = ["_length", "_rank", "_pieces", "_per", "_bin", "_offset"]
    segments = spark.createDataFrame(pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(names)}))  # tuples would start further workers
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("_own", F.row_number().over(order) - 1).join(firsts, ["length", "_salt"]).withColumn("_at", F.col("_first") + F.col("_own"))
    hint = F.broadcast(segments) if len(rows) <= 200_000 else segments  # 48 bytes a row
    placed = ranked.join(hint, (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_rank")) & (F.col("_at") < F.col("_rank") + F.col("_pieces")))
    step = F.col("_at") - F.col("_rank")
    kept = [c for c in cut.columns]
    return placed.select(
        *kept,
        (F.col("_bin") + F.floor(step / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(step, F.col("_per")) * F.col("length")).cast("long").alias("offset"),
    )


def best_fit(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places in as few sequences as best-fit decreasing needs."""
    return pack(write_table(pieces(docs, tokenizer, end_id, size, with_ids, id_col, text_col), "pieces"), size)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from places with ids; a sequence has at most the packing's size of ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
