"""The two-pass shuffle against one that a single machine does, and with a row that makes up a third of the table."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from trialspark.llm import shuffle_shards as S


def brute(spark, docs, shards):
    total = sum(len((r.text or "").encode()) + 64 for r in docs.collect())
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / S.BUCKET_BYTES))
    held = defaultdict(list)
    for r in docs.select("doc_id", "text", F.xxhash64("text").alias("k"), F.pmod(F.xxhash64(F.lit(S.SEED), "doc_id", F.xxhash64("text")), F.lit(buckets)).alias("b")).collect():
        held[r.b].append(((r.doc_id is None, r.doc_id or 0, r.k), (r.doc_id, r.text)))
    every = []
    for b in sorted(held):
        rows = [x for _, x in sorted(held[b], key=lambda x: x[0])]
        every += [rows[i] for i in S.fisher_yates(len(rows), f"{S.SEED}:{b}:0")]
    return sorted(((*x, p % shards, p // shards) for p, x in enumerate(every)), key=str)


def test_against_one_machine(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, None), (None, ""), (None, "x"), (3, "é" * 100_000), (3, "y"), (3, "y")], docs.schema))
    for n in (1, 7, 16):
        got = sorted(((r.doc_id, r.text, r.shard, r.slot) for r in S.shuffle_shards(docs, n).collect()), key=str)
        assert got == brute(spark, docs, n)
    again = S.shuffle_shards(docs.repartition(5), 7).collect()
    assert sorted(((r.doc_id, r.text, r.shard, r.slot) for r in again), key=str) == brute(spark, docs, 7)


def test_hot_row(spark, monkeypatch):
    """A third of the rows are one row: its bucket is scattered anew, and the law holds."""
    monkeypatch.setattr(S, "BUCKET_BYTES", 1 << 10)
    docs = spark.range(3000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 != 0, F.lit("text")).alias("text")).repartition(3)
    seen, made = [], S.starts_of
    monkeypatch.setattr(S, "starts_of", lambda counts: seen.extend(r._n for r in counts.collect()) or made(counts))
    rows = S.shuffle_shards(docs, 16, bucket_bytes=1 << 11).collect()
    assert len(rows) == 3000 and max(seen) < 400 and sum(seen) == 3000
    n = Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.values()) <= 1 and all(sorted(r.slot for r in rows if r.shard == s) == list(range(n[s])) for s in n)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    hot = sorted(r.slot * 16 + r.shard for r in rows if r.doc_id is None)
    assert hot[-1] - hot[0] > 1000  # not one run


def test_starts_over_groups_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 3)
    counts = [(b, s, (b * 7 + s) % 5 + 1) for b in range(20) for s in range(1 + b % 2)]
    got = {(r._bucket, r._sub): r._start for r in S.starts_of(spark.createDataFrame(counts, "_bucket bigint, _sub int, _n bigint")).collect()}
    at = 0
    for b, s, n in counts:
        assert got[b, s] == at
        at += n
