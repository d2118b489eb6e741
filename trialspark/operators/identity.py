"""Persons behind subjects: equal primary identity, enough equal secondary columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PRIMARY, SECONDARY = ("dminit", "brthdtc", "sex"), ("age", "arm", "rfstdtc", "scr_hba1c")


def persons(dm: DataFrame) -> DataFrame:
    """(usubjid, person_id, matched_on): a subject belongs to its group's base (lowest cut, then usubjid) if at least min(2, number of secondary columns) of those are equal, letters' case and null or empty being one."""
    primary, secondary = ([c for c in names if c in dm.columns] for names in (PRIMARY, SECONDARY))
    plain = lambda c: F.upper(F.coalesce(c.cast("string"), F.lit("")))
    full = F.lit(bool(primary))
    for c in primary:
        full = full & (plain(F.col(c)) != "")
    group = W.partitionBy(*[F.when(full, plain(F.col(c))) for c in primary], F.when(~full, F.col("usubjid"))).orderBy(F.coalesce("cut_available", F.lit(0)), "usubjid")
    base = F.first(F.struct("usubjid", *secondary)).over(group)
    equal = F.array_compact(F.array(*[F.when(plain(F.col(c)) == plain(F.col("_b")[c]), F.lit(c)) for c in secondary]))
    out = dm.withColumn("_b", base).withColumn("_eq", equal)
    same = (F.col("_b.usubjid") == F.col("usubjid")) | (F.size("_eq") >= min(2, len(secondary)))
    return out.select("usubjid", F.when(same, F.col("_b.usubjid")).otherwise(F.col("usubjid")).alias("person_id"), F.when(same & (F.col("_b.usubjid") != F.col("usubjid")), F.array_join("_eq", ",")).otherwise("").alias("matched_on"))


def duplicates(clusters: DataFrame) -> DataFrame:
    """Persons enrolled twice or more: (person_id, n, subjects)."""
    return clusters.groupBy("person_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("usubjid")), ",").alias("subjects")).where("n > 1")
