"""The study as known at a data cut: as-of filter, correction overlay, versions as-of, deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N


def as_of(df: DataFrame, cut: int | None) -> DataFrame:
    """Rows available at the cut; without one, all. A missing cut_available is available always."""
    return df if cut is None else df.where(F.col("cut_available").isNull() | (F.col("cut_available") <= cut))


def in_force(corrections: DataFrame, cut: int | None) -> DataFrame:
    return corrections if cut is None else corrections.where(F.col("cut") <= cut)


def overlay(df: DataFrame, corrections: DataFrame, field: str, column: str, cut: int | None) -> DataFrame:
    """df with `column` corrected: of the corrections in force the last by (cut, row_no) wins, even an empty one.

    The raw value stays in raw_<column>; n_corrections counts the history. Corrections are few for a key, so they
    are reduced before the join.
    """
    last = in_force(corrections, cut).where(F.col("field") == field).groupBy("usubjid", "seq").agg(
        F.max_by("new_value", F.struct("cut", "row_no")).alias("_new"), F.count("*").alias("n_corrections"), F.lit(True).alias("_hit")
    )
    last = last.withColumnsRenamed({"usubjid": "_u", "seq": "_q"})
    joined = df.join(last, (F.col("usubjid") == F.col("_u")) & F.col("seq").eqNullSafe(F.col("_q")), "left").drop("_u", "_q")
    return joined.withColumn(f"raw_{column}", F.col(column)).withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).withColumn("n_corrections", F.coalesce("n_corrections", F.lit(0))).drop("_new", "_hit")


def unmatched(df: DataFrame, corrections: DataFrame, cut: int) -> DataFrame:
    """Corrections in force whose record is not in the view."""
    view = as_of(df, cut).select(F.col("usubjid").alias("_u"), F.col("seq").alias("_q"))
    return in_force(corrections, cut).join(view, (F.col("usubjid") == F.col("_u")) & F.col("seq").eqNullSafe(F.col("_q")), "left_anti")


def pending(corrections: DataFrame, cut: int) -> DataFrame:
    return corrections.where(F.col("cut") > cut)


def version_as_of(asked: DataFrame, cuts: DataFrame) -> DataFrame:
    """asked (at) with the version in force: the highest listed cut's at or below it, below all the first's, null the last's."""
    listed = F.broadcast(cuts.agg(F.sort_array(F.collect_list(F.struct("cut", "version"))).alias("_all")))  # a row a cut: bounded by the number of cuts
    below = F.filter("_all", lambda x: x["cut"] <= F.col("at"))
    version = F.when(F.col("at").isNull(), F.try_element_at("_all", F.lit(-1))["version"]).when(F.size(below) > 0, F.try_element_at(below, F.lit(-1))["version"]).otherwise(F.try_element_at("_all", F.lit(1))["version"])
    return asked.join(listed).withColumn("version", version).drop("_all")


def manual_as_of(manuals: DataFrame, version: int) -> DataFrame:
    """The laboratory manual for a protocol version: the highest at or below it, else an unversioned one, else the highest."""
    rank = F.when(F.col("version") <= version, 0).when(F.col("version").isNull(), 1).otherwise(2)
    return manuals.withColumn("_rank", rank).orderBy("_rank", F.col("version").desc_nulls_last(), "name").limit(1).drop("_rank")


def delta(df: DataFrame, cut: int) -> DataFrame:
    """What arrives at the cut, by site: records, and whether the site is new."""
    now = F.col("cut_available") == cut
    out = df.groupBy("site").agg(F.count_if(now).alias("n_new"), (F.min("cut_available") == cut).alias("is_new_site"))
    return out.where("n_new > 0")


def delta_all(domains: dict[str, DataFrame], corrections: DataFrame, cut: int) -> DataFrame:
    """(domain, site, n_new, is_new_site, n_corrections): what the cut brings to each domain and site; a corrected record's site is in its subject's id."""
    out = None
    for name, df in domains.items():
        if "cut_available" in df.columns:
            df = df if "site" in df.columns else df.withColumn("site", F.col("siteid"))
            one = delta(df, cut).select(F.lit(name).alias("domain"), "site", "n_new", "is_new_site", F.lit(0).cast("bigint").alias("n_corrections"))
            out = one if out is None else out.unionByName(one)
    fixed = corrections.where(F.col("cut") == cut).groupBy("domain", N.site_of(F.col("usubjid")).alias("site")).agg(F.count("*").alias("n_corrections"))
    fixed = fixed.select("domain", "site", F.lit(0).cast("bigint").alias("n_new"), F.lit(False).alias("is_new_site"), "n_corrections")
    out = fixed if out is None else out.unionByName(fixed)
    return out.groupBy("domain", "site").agg(F.sum("n_new").alias("n_new"), F.max("is_new_site").alias("is_new_site"), F.sum("n_corrections").alias("n_corrections"))


def new_places(domains: dict[str, DataFrame], cut: int) -> DataFrame:
    """(domain, site) with records at the cut and none before."""
    out = None
    for name, df in domains.items():
        one = df.groupBy("site").agg(F.min("cut_available").alias("_first")).where(F.col("_first") == cut).select(F.lit(name).alias("domain"), "site")
        out = one if out is None else out.unionByName(one)
    return out


def overlay_all(domains: dict[str, DataFrame], corrections: DataFrame, columns: dict[str, dict[str, str]], cut: int | None) -> dict[str, DataFrame]:
    """Each domain with all its fields corrected, as overlay does for one: columns maps a domain to its fields' column names; raw values stay in raw_<column>.

    A record's corrections become one row, found by the record's key as delivered: a domain is joined once, however many
    fields it has, and no job runs to find out which fields were corrected.
    """
    out = dict(domains)
    for domain, df in domains.items():
        known = {field: column for field, column in columns.get(domain, {}).items() if column in df.columns}
        if known:
            out[domain] = _overlaid(df, in_force(corrections, cut).where(F.col("domain") == domain), known)
    return out


def _overlaid(df: DataFrame, corrections: DataFrame, known: dict[str, str]) -> DataFrame:
    is_ = lambda field: F.col("field") == field
    last = [F.max_by(F.when(is_(f), F.struct("new_value")), F.when(is_(f), F.struct("cut", "row_no"))).alias(f"_new_{c}") for f, c in known.items()]
    fixed = corrections.where(F.col("field").isin(*known)).groupBy(F.col("usubjid").alias("_u"), F.col("seq").alias("_q")).agg(*last)
    number = F.col("seq") if "seq" in df.columns else F.lit(None).cast("bigint")  # DM may have none
    joined = df.join(fixed, (F.col("usubjid") == F.col("_u")) & number.eqNullSafe(F.col("_q")), "left")
    value = lambda c: F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.new_value")).otherwise(F.col(c)).alias(c)
    changed = set(known.values())
    return joined.select(*[value(c) if c in changed else F.col(c) for c in df.columns], *[F.col(c).alias(f"raw_{c}") for c in known.values()])


def unknown_fields(corrections: DataFrame, columns: dict[str, dict[str, str]]) -> DataFrame:
    """Corrections to a field that its domain doesn't have: issues, applied to nothing."""
    known = [d + "." + f for d, names in columns.items() for f in names]
    return corrections.where(~F.concat_ws(".", "domain", "field").isin(*known))
