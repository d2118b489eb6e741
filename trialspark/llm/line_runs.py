"""Line dedup by levelled sorted runs of line hashes.

A run is a table of (key, n): the 16-byte hash of a line key and the number of documents seen with it, bucketed
and sorted by key. Batches come one after another from the source. A batch's lines are counted within the tasks that
read them, without the most frequent keys that the runs have settled (found in enough documents: they need no more
counting), so these never reach a shuffle again; what is left is summed, merge-anti-joined with all that the runs have
settled, and added as a run of its own; `fanout` runs of a level are compacted into one of the next. Runs are bucketed
alike, so the anti-joins merge them without a shuffle; a compaction sums its runs with one. The levels can be kept: a
later delivery opens them again and goes on.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, map_rows, path_exists, read, remove_path, schema_with, scratch_path, texts_of, tune, width, with_columns

MIN_DOCS, MIN_CHARS, BATCHES, FANOUT, BROADCAST_KEYS = 10, 1, 4, 2, 400_000
#: The settled keys that tasks leave out before the shuffle: the most frequent ones, 16 bytes each; the anti-join takes out the others.
LEFT_OUT = 100_000


def line_keys(text: str) -> list[bytes]:
    """The key of each \\n-split line: stripped, A-Z lower-cased (bytes.lower touches ASCII only)."""
    return [x.strip(SPACE) for x in text.encode().lower().split(b"\n")]


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def count_keys(docs: DataFrame, min_chars: int = MIN_CHARS, settled: frozenset = frozenset()) -> DataFrame:
    """(key, n): in how many documents a line key is, settled keys left out; counted in the task first, so a hot line is few rows."""
    out = docs.sparkSession.sparkContext.broadcast(settled)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["key", "n"])

        for batch in rows:
            for text in texts_of(batch):
                seen.update({key_hash(k) for k in line_keys(text) if long_enough(k, min_chars)} - out.value)
                if len(seen) > 200_000:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(count, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def batch_of(docs: DataFrame, batches: int):
    """Which batch a row belongs to, whatever the files: a hash of its doc_id, or of its text where there is none."""
    return F.pmod(F.xxhash64(F.lit("batch"), "doc_id" if "doc_id" in docs.columns else "text"), F.lit(batches))


class LineRuns:
    """The levels of runs, under a root in the shared folder; close() drops them.

    With a root that holds levels already (keep() wrote them), these are opened and go on with their own settings.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, root: str | None = None):
        self.spark, self.min_docs, self.fanout, self.buckets = spark, min_docs, fanout, width(spark)
        self.levels: list[list[str]] = [[]]
        self.root, self.compacted = root or scratch_path(spark, "runs"), 0
        if root and path_exists(spark, f"{root}/levels/_SUCCESS"):
            told = json.loads(spark.read.text(f"{root}/levels").first()[0])
            self.levels, self.min_docs, self.fanout, self.buckets = told["levels"], told["min_docs"], told["fanout"], told["buckets"]
            known = {t.name for t in spark.catalog.listTables()}
            for name in self.runs():
                if name not in known:
                    spark.sql(f"CREATE TABLE {name} (key BINARY, n BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")

    def keep(self) -> str:
        """Write down which runs the levels hold; the root to open them by."""
        told = {"levels": self.levels, "min_docs": self.min_docs, "fanout": self.fanout, "buckets": self.buckets}
        self.spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/levels")
        return self.root

    def write(self, rows: DataFrame) -> str:
        name = f"runs_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, f"{self.root}/{name}")

    def runs(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def add(self, counts: DataFrame) -> None:
        """One batch's (key, n): without what is settled it becomes a run of level 0."""
        seen = F.lit(0)
        for i, run in enumerate(self.runs()):
            counts = counts.join(self.spark.table(run).withColumnRenamed("n", f"_n{i}"), "key", "left")
            seen = seen + F.coalesce(f"_n{i}", F.lit(0))
        self.levels[0].append(self.write(counts.where(seen < self.min_docs).select("key", "n")))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self.write(self.merged(old)))
            for run in old:
                self.drop(run)
            level, self.compacted = level + 1, self.compacted + 1

    def left_out(self, most: int = LEFT_OUT) -> frozenset:
        """The most frequent settled keys, at most so many."""
        if not self.runs():
            return frozenset()
        found = self.merged(self.runs()).where(F.col("n") >= self.min_docs).orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()
        return frozenset(found.column("key").to_pylist())

    def add_docs(self, docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> None:
        """A delivery of documents, batch by batch."""
        of = batch_of(docs, batches)
        for i in range(batches):
            self.add(count_keys(docs.where(of == i) if batches > 1 else docs, min_chars, self.left_out()))

    def merged(self, runs: list[str]) -> DataFrame:
        """The runs' sums by key. The renaming makes the union forget the runs' buckets: Spark 4.1 keeps them in the plan of a union of column batches but doesn't join them when it runs."""
        rows = [self.spark.table(run).select("key", F.col("n").alias("m")) for run in runs] or [self.spark.createDataFrame([], "key binary, m bigint")]
        every = rows[0]
        for more in rows[1:]:
            every = every.unionByName(more)
        return every.groupBy("key").agg(F.sum("m").alias("n"))

    def settled(self) -> DataFrame:
        """The keys found in at least min_docs documents."""
        return self.merged(self.runs()).where(F.col("n") >= self.min_docs).select("key")

    def close(self) -> None:
        for run in self.runs():
            self.drop(run)
        remove_path(self.spark, self.root)


def drop_lines(text: str, gone) -> tuple[str, int, int]:
    """The text without lines whose key's hash is in `gone`; lines before, lines dropped."""
    keys = line_keys(text)
    out = [bool(k) and key_hash(k) in gone for k in keys]
    n = sum(out)
    return ("\n".join(x for x, o in zip(text.split("\n"), out) if not o) if n else text), len(keys), n


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS, root: str | None = None) -> DataFrame:
    """docs with repeated lines cut out of text, and n_lines, n_dropped (long).

    A line goes from every document if its key has at least min_chars code points and is in at least min_docs
    documents; others stay, joined by \\n. Null and empty texts are one empty line, which stays, and come out as
    the empty text. Repeated rows count as documents of their own; texts of any length are read whole; an empty
    table gives no rows. A line counts once a document, and which of equal lines come first doesn't matter: all go or
    none, so there are no ties. Columns n_lines and n_dropped of docs are replaced. Up to broadcast_keys settled keys (16
    bytes each) go to the executors whole; beyond that they are joined to the distinct texts' keys instead, with the
    same result. With a root the runs stay there, and the documents are counted on top of what earlier deliveries to
    that root had.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.drop("n_lines", "n_dropped")
    runs = LineRuns(spark, min_docs, root=root)
    runs.add_docs(docs, min_chars, batches)
    settled = cut(runs.settled())
    if root:
        runs.keep()
    else:
        runs.close()
    out = schema_with(docs, text="string", n_lines="bigint", n_dropped="bigint")
    few = [bytes(r[0]) for r in settled.limit(broadcast_keys + 1).collect()]

    def cut_batch(batch: pa.RecordBatch, gones) -> pa.RecordBatch:
        done = [drop_lines(t, g) for t, g in zip(texts_of(batch), gones)]
        return with_columns(batch, text=pa.array([d[0] for d in done], pa.string()), n_lines=pa.array([d[1] for d in done], pa.int64()), n_dropped=pa.array([d[2] for d in done], pa.int64()))

    if len(few) <= broadcast_keys:
        hot = spark.sparkContext.broadcast(frozenset(few))
        return map_rows(docs, lambda batch: cut_batch(batch, [hot.value] * batch.num_rows), out)

    def keys_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys = [], []
        for i, text in zip(batch.column("_text").to_pylist(), texts_of(batch)):
            own = {key_hash(k) for k in line_keys(text) if long_enough(k, min_chars)}
            ids += [i] * len(own)
            keys += own
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.binary())], names=["_text", "key"])

    named = docs.withColumn("_text", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = map_rows(named.select("_text", "text"), keys_of, "_text string, key binary").distinct().join(settled, "key").groupBy("_text").agg(F.collect_list("key").alias("_gone"))
    joined = named.join(found, "_text", "left").drop("_text")

    def cut_joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        gones = [frozenset(x or ()) for x in batch.column("_gone").to_pylist()]
        return cut_batch(batch.drop_columns(["_gone"]), gones)

    return map_rows(joined, cut_joined, out)


def op1(spark, sf_dir):
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op1_sql() -> str:
    white = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
numbered AS (SELECT row_number() OVER () AS rid, doc_id, ls FROM split),
lines AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM numbered),
keyed AS (SELECT *, translate(trim(line, {white}), '{upper}', '{upper.lower()}') AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= {MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE h.k IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot h ON keyed.k = h.k GROUP BY rid"""
