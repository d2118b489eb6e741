"""Best-fit-decreasing packing of token sequences, with a segment tree over remaining capacities.

What best fit does with a piece depends on its length alone, and lengths are whole numbers of at most
`capacity`; so the plan is made from the histogram of lengths, which has capacity + 1 counters however large
the corpus is. The tree's leaves count the open bins of each remaining capacity; the tightest bin for a length
is the leftmost non-empty leaf from that length on, found in logarithmic time. Pieces of one length are then
numbered and take their places from the plan's runs.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, map_rows, read, texts_of, tune, width
from .tokens import word_encoder

CAPACITY, VOCABULARY, SEPARATOR = 4096, "word_bpe_49k.json", 1
#: Pieces that a cut of the most common length has at most, about.
CUT_ROWS = 200_000


class CapacityTree:
    """Counts of open bins by remaining capacity; the tightest that still holds a length, in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        at = remaining + self.size
        while at:
            self.sums[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least length that an open bin has."""
        at = length + self.size
        if self.sums[at]:
            return length
        while at > 1:
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.sums[2 * at])
                return at - self.size
            at >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, pieces a bin, offset) of best fit decreasing.

    The piece of rank r >= first rank, up to the next run's, goes to bin `first bin + (r - first rank) // pieces a
    bin`. Bins with as much room are alike, so they are kept as ranges of bin numbers.
    """
    tree, open_bins, bins, runs = CapacityTree(capacity), {}, 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:  # new bins
                each = capacity // length
                full, rest = divmod(left, each)
                runs.append((length, rank, bins, each, 0))
                for n, held in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        after = capacity - held * length
                        open_bins.setdefault(after, []).append((bins, n))
                        tree.add(after, n)
                        bins += n
                break
            first, n = open_bins[room].pop()
            each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n and left - full * each < each else 0
            used = full + (1 if rest else 0)
            runs.append((length, rank, first, each, capacity - room))
            tree.add(room, -used)
            if used < n:
                open_bins[room].append((first + used, n - used))
            for start, count, held in ((first, full, each), (first + full, 1 if rest else 0, rest)):
                if count:
                    after = room - held * length
                    open_bins.setdefault(after, []).append((start, count))
                    tree.add(after, count)
            placed = full * each + rest
            left, rank = left - placed, rank + placed
    return runs


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each text's ids and the separator, cut at capacity."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, end = word_encoder(vocabulary), int(separator).to_bytes(4, "little")
        out = ([], [], [], [], [], [])
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            raw = encoder.encode(text) + end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                    column.append(value)
        kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    out = map_rows(docs.select("doc_id", "text"), encode, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")
    return out if with_ids else out.drop("ids")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    Null and empty texts are the separator alone; texts of any length are encoded whole and cut at the capacity. Ties of
    length go by a hash of the document, then doc_id and piece; repeated rows are packed one by one. Other columns of
    docs, whatever their names, are left out. An empty table gives none.
    """
    spark = docs.sparkSession
    tune(spark)
    made = cut(pieces(docs, vocabulary, capacity, separator, with_ids))
    # cuts of the pieces of one length, each numbered in one task: as many as keep a cut small however common its length is
    cuts = max(width(spark), 16, made.count() // CUT_ROWS)
    made = made.withColumn("_cut", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(cuts)).cast("int"))
    # how many pieces of each length each cut has: small rows, of which the driver sees capacity sums
    held = made.groupBy("length", "_cut").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in held.groupBy("length").agg(F.sum("n")).collect()}
    runs = plan(histogram, capacity)
    before = held.select("length", "_cut", (F.sum("n").over(W.partitionBy("length").orderBy("_cut")) - F.col("n")).alias("_before"))
    order = W.partitionBy("length", "_cut").orderBy("doc_id", "piece", "ids_crc32")
    ranked = made.join(before, ["length", "_cut"]).withColumn("_rank", F.row_number().over(order) - 1 + F.col("_before")).drop("_cut", "_before")
    keys = np.array([(n << 40) + r for n, r, *_ in runs] or [0], dtype=np.int64)
    by = np.argsort(keys)
    table = spark.sparkContext.broadcast((keys[by], np.array(runs or [(0, 0, 0, 1, 0)], dtype=np.int64)[by]))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, runs = table.value
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
        run = runs[np.searchsorted(keys, (length << 40) + rank, side="right") - 1]
        bin_, within = np.divmod(rank - run[:, 1], run[:, 3])
        kept = batch.drop_columns(["_rank"])
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(run[:, 2] + bin_), pa.array(run[:, 4] + within * length)], names=[*kept.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"{n} {t}" for n, t in ranked.drop("_rank").dtypes)
    return map_rows(ranked, place, f"{fields}, sequence_id bigint, offset bigint")


def op9(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
