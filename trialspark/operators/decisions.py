"""Decisions as append-only events: what was decided when, its state as of a cut, its history, and what explains it.

An event is (decision_id, cut, n, kind, target, code, status, reason, refs): a decision keeps one id through all cuts, events
are never changed, and a decision's state is that of its last event by (cut, n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import study as source

SCHEMA = "decision_id string, cut bigint, n int, kind string, target string, code string, status string, reason string, refs array<string>"


def events(df: DataFrame, kind: str, key: Column, status: Column, cut: Column, reason: Column, refs: Column | None = None, target: Column | None = None, code: Column | None = None, n: int = 0) -> DataFrame:
    """df's rows as events of a kind; the id is the kind and the key, which doesn't name the cut."""
    empty = F.lit(None).cast("string")
    refs = F.array().cast("array<string>") if refs is None else refs
    return df.select(
        F.concat(F.lit(kind + "|"), key).alias("decision_id"), cut.cast("bigint").alias("cut"), F.lit(n).alias("n"), F.lit(kind).alias("kind"), (empty if target is None else target).alias("target"),
        (empty if code is None else code).alias("code"), status.alias("status"), reason.alias("reason"), refs.alias("refs"),
    )


def transitions(log: DataFrame) -> DataFrame:
    """Events that change their decision's status, with the old one (null for the first); repeats of a cut change nothing."""
    before = F.lag("status").over(W.partitionBy("decision_id").orderBy("cut", "n"))
    return log.withColumn("old_status", before).where(F.col("old_status").isNull() | (F.col("old_status") != F.col("status")))


def state_as_of(log: DataFrame, cut: int | None = None) -> DataFrame:
    """(decision_id, first_cut, cut, kind, target, code, status, reason, refs, n_transitions): each decision as of the cut; cut is that of its last change, reason and refs are that change's."""
    changes = transitions(log if cut is None else log.where(F.col("cut") <= cut))
    last = F.max_by(F.struct("cut", "kind", "target", "code", "status", "reason", "refs"), F.struct("cut", "n")).alias("_l")
    return changes.groupBy("decision_id").agg(F.min("cut").alias("first_cut"), last, F.count("*").alias("n_transitions")).select("decision_id", "first_cut", "_l.*", "n_transitions")


def deviations(explained: DataFrame, log: DataFrame) -> DataFrame:
    """(decision_id, extra): explanations (decision_id, refs) that cite records which no event of their decision does."""
    traced = log.groupBy("decision_id").agg(F.array_distinct(F.flatten(F.collect_list("refs"))).alias("_t"))
    both = explained.join(traced, "decision_id", "left")
    return both.withColumn("extra", F.array_except("refs", F.coalesce("_t", F.array().cast("array<string>")))).where(F.size("extra") > 0).select("decision_id", "extra")


class DecisionStore:
    """Events in a folder a cut and step; writing a step again replaces it and nothing else."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, new: DataFrame, cut: int, step: int) -> None:
        new.withColumn("n", F.lit(step)).select([c.split()[0] for c in SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/_cut={cut}/_step={step}")

    def log(self) -> DataFrame:
        return source.load_state(self.spark, self.path, SCHEMA).select([c.split()[0] for c in SCHEMA.split(", ")])

    def as_of(self, cut: int | None = None, **filters: str) -> DataFrame:
        """The decisions as of a cut with these values (status, code, target, kind)."""
        out = state_as_of(self.log(), cut)
        for column, value in filters.items():
            out = out.where(F.col(column) == value)
        return out

    def history(self, decision_id: str) -> DataFrame:
        return transitions(self.log().where(F.col("decision_id") == decision_id)).select("cut", "n", "old_status", "status", "reason").orderBy("cut", "n")

    def explain(self, decision_id: str) -> DataFrame:
        """A decision's state with its history as one array: (.., history: array of (cut, old_status, status, reason))."""
        own = self.log().where(F.col("decision_id") == decision_id)
        told = transitions(own).groupBy("decision_id").agg(F.sort_array(F.collect_list(F.struct("cut", "n", "old_status", "status", "reason"))).alias("history"))
        return state_as_of(own).join(told, "decision_id")
