"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash; pass two puts each bucket in a
seeded Fisher-Yates order. The buckets one after the other are a uniformly random order of all records, which
is dealt to the shards like cards: record p goes to shard p mod n at slot p div n, so shards differ by one
record at most (law `rows`). Where buckets begin in that order is summed on the executors, by groups of buckets.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read, schema_with, tune, width

SHARDS, BUCKET_BYTES, SEED, HEAVY, GROUP = 16, 16 << 20, 20240607, 4, 4096


def fisher_yates(n: int, seed: str) -> np.ndarray:
    """The permutation of range(n) that Fisher-Yates makes with this seed."""
    order, draw = list(range(n)), random.Random(seed).random
    for i in range(n - 1, 0, -1):
        j = int(draw() * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def starts_of(counts: DataFrame) -> DataFrame:
    """(_bucket, _sub, _n) with _start, the records before each in order; each window sees a group's buckets, or one row a group."""
    grouped = counts.withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    groups = grouped.groupBy("_group").agg(F.sum("_n").alias("_g"))
    before = groups.select("_group", (F.sum("_g").over(W.orderBy("_group")) - F.col("_g")).alias("_before"))
    inside = F.sum("_n").over(W.partitionBy("_group").orderBy("_bucket", "_sub")) - F.col("_n")
    return grouped.withColumn("_inside", inside).join(before, "_group").select("_bucket", "_sub", (F.col("_inside") + F.col("_before")).alias("_start"))


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of docs with `shard` (int) and `slot` (long, gapless from 0 in each shard).

    docs has doc_id and text, or in place of text its text_key (xxhash64) and text_bytes. A record's bucket hashes
    doc_id and text, so the order doesn't depend on how the input is partitioned, and null doc_ids spread by their
    texts. Repeated rows share a bucket and stay separate records; they are equal, so which of them comes first can't
    be told. A bucket that repeated rows make HEAVY times as long as the mean is scattered anew by the rows'
    positions in a written table. Null and empty texts are records like others, texts may be of any length, and an
    empty table gives no rows. Columns of docs named shard or slot, or with a leading underscore as used here, are
    replaced.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.drop("shard", "slot", "_key", "_bucket", "_sub", "_start", "_at", "_n")
    key, size = (F.xxhash64("text"), F.coalesce(F.octet_length("text"), F.lit(0))) if "text" in docs.columns else (F.col("text_key"), F.col("text_bytes"))
    total, rows = docs.select((size + 64).alias("b")).agg(F.sum("b"), F.count("*")).first()
    buckets = max(1, width(spark), math.ceil((total or 0) / bucket_bytes))
    keyed = docs.withColumn("_key", key).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_key"), F.lit(buckets)))
    most = HEAVY * (rows / buckets + 8 * math.sqrt(rows / buckets + 1))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    heavy = counts.where(F.col("_n") > most).select("_bucket", F.ceil(F.col("_n") / most).alias("_parts"))
    if heavy.isEmpty():
        keyed, counts = keyed.withColumn("_sub", F.lit(0)), counts.withColumn("_sub", F.lit(0))
    else:
        placed = cut(keyed.withColumn("_at", F.monotonically_increasing_id()))
        sub = F.coalesce(F.pmod(F.xxhash64("_at"), F.col("_parts")), F.lit(0)).cast("int")
        keyed = placed.join(heavy, "_bucket", "left").withColumn("_sub", sub).drop("_parts", "_at")
        counts = keyed.groupBy("_bucket", "_sub").agg(F.count("*").alias("_n"))

    def second(table: pa.Table) -> pa.Table:
        bucket, sub, start = (table.column(c)[0].as_py() for c in ("_bucket", "_sub", "_start"))
        ids = table.column("doc_id")
        base = np.lexsort((table.column("_key").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))  # the same in each run
        order = base[fisher_yates(len(base), f"{seed}:{bucket}:{sub}")]
        at = start + np.arange(len(order), dtype=np.int64)
        out = table.drop_columns(["_key", "_bucket", "_sub", "_start"]).take(pa.array(order))
        return out.append_column("shard", pa.array((at % shards).astype(np.int32))).append_column("slot", pa.array(at // shards))

    dealt = keyed.join(starts_of(counts), ["_bucket", "_sub"])
    return dealt.groupBy("_bucket", "_sub").applyInArrow(second, schema_with(docs, shard="int", slot="bigint"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """The shards as folders shard=K of Parquet files, each in slot order."""
    out = shuffle_shards(docs, shards, seed)
    out.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5(spark, sf_dir):
    """The shuffle of all records, each by its digests: what the result doesn't have isn't moved."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("bigint").alias("text_bytes"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("text_key"))
    out = shuffle_shards(docs)
    return out.select("doc_id", (F.col("text_bytes") + 1).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
