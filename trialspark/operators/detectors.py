"""Statistical surveillance of sites: unit shifts, values too regular, visits too evenly spaced.

Detectors read raw values, uncorrected, as plain decimal numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalise as N

#: Factors whose appearance betrays a changed unit.
KNOWN_FACTORS = {"GLUC": 18.016, "CREAT": 88.4, "BILI": 17.1, "HBA1C": 10.93}


def plain(lb: DataFrame) -> DataFrame:
    """(site, testcd, cut_available, v): values that are plain decimal numbers."""
    text = N.strip(F.col("orres"))
    return lb.select("site", "testcd", "cut_available", F.when(text.rlike(N.NUMBER), text.try_cast("double")).alias("v")).where("v is not null")


#: Cuts of a test's values into buckets; they bound the rows that a site's middle is sought in and change no result.
BUCKETS = 64


def _medians(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, site, n, med, n_others, med_others): medians of a site's values and of all other sites'.

    The median of the others isn't a sum, but its place is: how many of the others are in a bucket of values is the
    bucket's count less the site's. So each site's middle ranks, among its own values and among the others', are
    found by bucket from counts, and then inside that bucket among its distinct values, to which alone they are
    joined. Buckets are cut at shared quantiles of the group.
    """
    cuts = values.groupBy(*keys).agg(F.percentile_approx("v", F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), F.lit(1000)).alias("_cuts"))
    cells = values.groupBy(*keys, "site", "v").agg(F.count("*").alias("c")).join(cuts, keys).withColumn("bucket", F.size(F.filter("_cuts", lambda x: x <= F.col("v")))).drop("_cuts")
    steps = cells.groupBy(*keys, "bucket", "v").agg(F.sum("c").alias("up"))
    held = cells.groupBy(*keys, "site", "bucket").agg(F.sum("c").alias("own"))
    grid = held.select(*keys, "site").distinct().join(steps.groupBy(*keys, "bucket").agg(F.sum("up").alias("up")), keys).join(held, [*keys, "site", "bucket"], "left")  # sites * BUCKETS rows a group
    own = F.coalesce("own", F.lit(0))
    both = grid.select(*keys, "site", "bucket", F.explode(F.array(F.struct(F.lit(True).alias("mine"), own.alias("c")), F.struct(F.lit(False).alias("mine"), (F.col("up") - own).alias("c")))).alias("_e")).select(*keys, "site", "bucket", "_e.*")
    group = [*keys, "site", "mine"]
    both = both.withColumn("to", F.sum("c").over(W.partitionBy(*group).orderBy("bucket"))).withColumn("n", F.sum("c").over(W.partitionBy(*group)))
    middle = both.withColumn("k", F.explode(F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)))).where("k <= to and k > to - c").withColumn("rank", F.col("k") - F.col("to") + F.col("c"))
    near = middle.select(*group, "bucket", "k", "rank", "n").join(steps, [*keys, "bucket"]).join(cells.select(*keys, "site", "v", F.col("c").alias("_c")), [*keys, "site", "v"], "left")
    count = F.when(F.col("mine"), F.coalesce("_c", F.lit(0))).otherwise(F.col("up") - F.coalesce("_c", F.lit(0)))
    near = near.withColumn("_at", F.sum(count).over(W.partitionBy(*group, "k").orderBy("v"))).where("_at >= rank")
    found = near.groupBy(*group, "k").agg(F.min("v").alias("x"), F.first("n").alias("n")).groupBy(*keys, "site").pivot("mine", [True, False]).agg(((F.min_by("x", "k") + F.max_by("x", "k")) / 2).alias("med"), F.first("n").alias("n"))
    return found.select(*keys, "site", F.col("true_n").alias("n"), F.col("true_med").alias("med"), F.coalesce("false_n", F.lit(0)).alias("n_others"), F.col("false_med").alias("med_others"))


def median_shift(lb: DataFrame, cut: int, least: int = 5, fold: float = 3.0, tolerance: float = 0.15) -> DataFrame:
    """(site, testcd, ratio, prior, shift, matched, is_shift): a site's median against the others' at the cut, relative to before."""
    values = plain(lb)
    now = _medians(values.where(F.col("cut_available") == cut), ["testcd"]).where((F.col("n") >= least) & (F.col("n_others") >= least) & (F.col("med_others") != 0))
    before = _medians(values.where(F.col("cut_available") < cut), ["testcd"]).select("testcd", "site", F.when(F.col("med_others").isNull() | (F.col("med_others") == 0), 1.0).otherwise(F.col("med") / F.col("med_others")).alias("_p"))
    out = now.join(before, ["testcd", "site"], "left").withColumn("ratio", F.col("med") / F.col("med_others")).withColumn("prior", F.when(F.coalesce("_p", F.lit(1.0)) == 0, 1.0).otherwise(F.coalesce("_p", F.lit(1.0))))
    shift = F.col("ratio") / F.col("prior")
    out = out.withColumn("shift", F.when((shift < 1) & (shift > 0), 1 / shift).otherwise(shift))
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in KNOWN_FACTORS.items() for x in pair]), F.col("testcd"))
    matched = F.when(F.abs(F.col("shift") - known) / known <= tolerance, known)
    return out.select("site", "testcd", "n", "n_others", "ratio", "prior", "shift", matched.alias("matched"), (matched.isNotNull() | (F.col("shift") >= fold)).alias("is_shift"))


def low_variation(lb: DataFrame, cut: int, share: float = 0.2, vs: DataFrame | None = None) -> DataFrame:
    """(site, testcd, cv_site, cv_other, is_low): a site's coefficient of variation against the pooled others', from sums alone; laboratory results and vital signs."""
    values = plain(lb) if vs is None else plain(lb).unionByName(plain(vs))
    sums = values.where(F.col("cut_available") <= cut).groupBy("site", "testcd").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    total = sums.groupBy("testcd").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    both = sums.join(total, "testcd").withColumn("on", F.col("tn") - F.col("n")).withColumn("os", F.col("ts") - F.col("s")).withColumn("oq", F.col("tq") - F.col("q")).where("n >= 10 and on >= 20 and s <> 0 and os <> 0")
    cv = lambda n, s, q: F.sqrt(F.greatest((F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1), F.lit(0.0))) / F.abs(F.col(s) / F.col(n))
    out = both.withColumn("cv_site", cv("n", "s", "q")).withColumn("cv_other", cv("on", "os", "oq"))
    return out.select("site", "testcd", "n", "cv_site", "cv_other", ((F.col("cv_other") > 0.05) & (F.col("cv_site") < share * F.col("cv_other"))).alias("is_low"))


def site_variation(lb: DataFrame, test: str) -> DataFrame:
    """(site, n_subjects, n, cv_site, cv_other, ratio): a test's variation at every site against all others, from sums; what a monitor asks of a site that looks too regular."""
    held = plain(lb).where(F.col("testcd") == test).groupBy("site").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    total = held.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    both = held.join(F.broadcast(total)).withColumn("on", F.col("tn") - F.col("n")).withColumn("os", F.col("ts") - F.col("s")).withColumn("oq", F.col("tq") - F.col("q")).where("n > 1 and on > 1 and s <> 0 and os <> 0")  # total: one row
    cv = lambda n, s, q: F.sqrt(F.greatest((F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1), F.lit(0.0))) / F.abs(F.col(s) / F.col(n))
    subjects = lb.groupBy("site").agg(F.count_distinct("usubjid").alias("n_subjects"))
    out = both.join(subjects, "site").withColumn("cv_site", cv("n", "s", "q")).withColumn("cv_other", cv("on", "os", "oq"))
    return out.select("site", "n_subjects", "n", "cv_site", "cv_other", F.when(F.col("cv_other") > 0, F.col("cv_site") / F.col("cv_other")).alias("ratio"))


def visit_spacing(lb: DataFrame, least: int = 10, limit: float = 0.5) -> DataFrame:
    """(site, n_gaps, sd_gap, is_rigid): the spread of days between a subject's consecutive records, by site."""
    dated = lb.select("site", "usubjid", "seq", N.date_of(F.col("dtc")).alias("d")).where("d is not null")
    gap = F.datediff("d", F.lag("d").over(W.partitionBy("usubjid").orderBy("d", "seq")))
    return dated.withColumn("gap", gap).where("gap is not null").groupBy("site").agg(F.count("*").alias("n_gaps"), F.stddev_samp("gap").alias("sd_gap")).where(F.col("n_gaps") >= least).withColumn("is_rigid", F.col("sd_gap") < limit)


def quarantine(lb: DataFrame, cut: int, signals: int = 3, subjects: int = 5, records: int = 50, vs: DataFrame | None = None) -> DataFrame:
    """Sites with at least that many regularity signals, subjects and records."""
    low = low_variation(lb, cut, vs=vs).where("is_low").groupBy("site").agg(F.count("*").alias("_low"))
    rigid = visit_spacing(lb.where(F.col("cut_available") <= cut)).where("is_rigid").select("site", F.lit(1).alias("_rigid"))
    size = lb.where(F.col("cut_available") <= cut).groupBy("site").agg(F.count_distinct("usubjid").alias("n_subjects"))
    held = (plain(lb) if vs is None else plain(lb).unionByName(plain(vs))).where(F.col("cut_available") <= cut).groupBy("site").agg(F.count("*").alias("n_records"))
    out = size.join(held, "site").join(low, "site", "left").join(rigid, "site", "left").withColumn("n_signals", F.coalesce("_low", F.lit(0)) + F.coalesce("_rigid", F.lit(0))).drop("_low", "_rigid")
    return out.withColumn("quarantined", (F.col("n_signals") >= signals) & (F.col("n_subjects") >= subjects) & (F.col("n_records") >= records))


def site_dosing(ex: DataFrame, wrong: DataFrame, least: int = 2, refs: int = 10) -> DataFrame:
    """Sites with at least that many subjects dosed wrongly, with their first references."""
    site = wrong.groupBy("site").agg(F.count_distinct("usubjid").alias("n_subjects"))
    first = wrong.select("site", "usubjid", "seq").withColumn("_k", F.row_number().over(W.partitionBy("site").orderBy("usubjid", "seq"))).where(F.col("_k") <= refs)
    listed = first.groupBy("site").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("usubjid", "seq"))), lambda x: F.concat_ws(":", x["usubjid"], x["seq"].cast("string"))), ",").alias("refs"))
    return site.where(F.col("n_subjects") >= least).join(listed, "site")
