"""Cuts as a stream: each folder cut=N that arrives is a micro-batch, and the ledger follows.

A cut is logical time, so nothing waits for watermarks: the source takes new files, foreachBatch writes each
batch's findings under its cuts (a batch run again replaces what it wrote), and the ledger is read from all cuts
so far. Late corrections are rows of a later cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as S

SCHEMA = "fingerprint string, cut bigint"


def write_cuts(df: DataFrame, path: str) -> None:
    """A table with cut_available as one folder a cut."""
    df.withColumn("cut", F.col("cut_available")).repartition("cut").write.partitionBy("cut").mode("overwrite").parquet(path)


def follow(spark: SparkSession, source: str, schema: str, state: str, rule: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Take all cuts that have arrived; rule gives (fingerprint) of a batch's records, which keep their cut."""

    def step(batch: DataFrame, batch_id: int) -> None:
        found = rule(batch).select("fingerprint", F.col("cut").cast("bigint").alias("cut"))
        found.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ledger_of(spark: SparkSession, state: str) -> DataFrame:
    return S.ledger(spark.read.schema(SCHEMA).parquet(state))


def announce(spark: SparkSession, path: str, cut: int) -> None:
    """Say that a cut's records are all there: one small file, written after them."""
    spark.createDataFrame([(cut,)], "cut int").coalesce(1).write.mode("append").json(path)


def watch(spark: SparkSession, announced: str, run_cut: Callable[[int], object], checkpoint: str) -> None:
    """Run the surveillance of each announced cut, in order within a batch.

    A batch holds whole cuts, for a cut is announced when all its files are written. A batch that failed half-way comes
    again, and run_cut (Surveillance.run_cut) goes on where it stopped; a cut announced twice runs no step twice.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        for row in batch.select("cut").distinct().orderBy("cut").collect():  # the announcements of a batch: a line a cut
            run_cut(row.cut)

    stream = spark.readStream.schema("cut int").json(announced)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
