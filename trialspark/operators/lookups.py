"""Record lookups: by subject, by visit, by a window around an anchor, by any field; counts with filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalise as N
from . import rules as R


def long_records(domains: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """One row a record: (domain, usubjid, seq, date, fields); domains map to a table and its date column."""
    out = None
    for name, (df, dated) in domains.items():
        date = N.date_of(F.col(dated)) if dated else F.lit(None).cast("date")
        own = [c for c in df.columns if c not in ("usubjid", "seq")]
        row = df.select(F.lit(name).alias("domain"), "usubjid", F.col("seq").cast("bigint").alias("seq"), date.alias("date"), F.create_map(*[x for c in own for x in (F.lit(c), F.col(c).cast("string"))]).alias("fields"))
        out = row if out is None else out.unionByName(row)
    return out


def first_by_key(df: DataFrame) -> DataFrame:
    """Of records with one key the first loaded, as an index by reference keeps it."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy("usubjid", "seq").orderBy("row_no"))).where("_k = 1").drop("_k")


def window_lookup(records: DataFrame, start, end) -> DataFrame:
    return records.where(F.col("date").between(start, end))


def window_counts(records: DataFrame, start, end) -> DataFrame:
    """(domain, usubjid, n_in, n_undated): how many of a subject's records are in the window, and how many can't be placed for want of a date."""
    return records.groupBy("domain", "usubjid").agg(F.count_if(F.col("date").between(start, end)).alias("n_in"), F.count_if(F.col("date").isNull()).alias("n_undated"))


def anchored(records: DataFrame, anchors: DataFrame, days: int) -> DataFrame:
    """Records within days of their subject's anchor (usubjid, anchor)."""
    return records.join(anchors, "usubjid").where(F.abs(F.datediff("date", "anchor")) <= days)


def visit_anchor(lb: DataFrame, dm: DataFrame, visit: str, scheduled: int) -> DataFrame:
    """A subject's earliest dated record at the visit, else its reference start plus the scheduled day."""
    at = lb.where(N.visit_code(F.col("visit")) == visit).select("usubjid", N.date_of(F.col("dtc")).alias("_d")).groupBy("usubjid").agg(F.min("_d").alias("_d"))
    return dm.join(at, "usubjid", "left").select("usubjid", F.coalesce("_d", F.date_add(N.date_of(F.col("rfstdtc")), scheduled)).alias("anchor"))


def visit_anchors(visits: DataFrame, dm: DataFrame, visit: str, scheduled: int | None) -> DataFrame:
    """A subject's earliest dated record of any domain at the visit, else its reference start plus the scheduled day, if there is one."""
    at = visits.where(F.col("visit") == visit).groupBy("usubjid").agg(F.min("date").alias("_d"))
    planned = F.lit(None).cast("date") if scheduled is None else F.date_add(N.date_of(F.col("rfstdtc")), scheduled)
    return dm.join(at, "usubjid", "left").select("usubjid", F.coalesce("_d", planned).alias("anchor"))


def any_field(records: DataFrame, value: str) -> DataFrame:
    wanted = value.strip().upper()
    return records.where(F.exists(F.map_values("fields"), lambda x: F.upper(N.strip(x)) == wanted))


def count_subjects(ctx: dict, site=None, arm=None, sex=None, country=None, age=None, status=None, reason=None, serious=None, term=None, severity=None, cm_class=None, prohibited=None, finding=None, subcode=None, visit=None, test=None) -> DataFrame:
    """(usubjid, person_id) of the subjects that meet all filters; cheap demographic ones first, the others as semi-joins."""
    out, has = ctx["dm"], lambda c, x: F.upper(c).contains(x.upper())
    if site:
        out = out.where(F.upper("siteid") == site.upper())
    if arm:
        out = out.where(has("arm", arm))
    if sex:
        out = out.where(F.upper(F.substring("sex", 1, 1)) == sex[:1].upper())
    if country:
        out = out.where(F.upper(N.strip(F.col("country"))) == country.strip().upper())
    if age:
        out = out.where(N.number(F.col("age")).between(*age))
    semi = lambda df, *filters: _meeting(out, df, filters)
    if status or reason:
        out = semi(ctx["ds"], status and has("decod", status), reason and has("term", reason))
    if serious is not None or term or severity:
        out = semi(ctx["ae"], N.yes_flag(F.col("ser")) == serious if serious is not None else None, term and has("term", term), severity and F.upper(N.strip(F.col("sev"))) == severity.strip().upper())
    if cm_class or prohibited:
        cls, trt, want = N.class_token(F.col("cls")), N.class_token(F.col("trt")), N.class_token(F.lit(cm_class or ""))
        own = (want == cls) | F.array_contains(F.split(cls, "_"), want) | trt.contains(want)
        out = semi(ctx["cm"], own if cm_class else None, N.match_prohibited(F.col("cls"), F.col("trt"), list(ctx.get("rules", R.Rules()).prohibited)).isNotNull() if prohibited else None)
    if finding:
        out = semi(ctx["findings"], F.col("code") == finding, subcode and F.col("subcode") == subcode)
    if visit:
        tested = [ctx[d].where(N.visit_code(F.col("visit")) == visit).select("usubjid", "testcd") for d in ("lb", "vs", "eg") if d in ctx]
        at = tested if test else [ctx["visits"].where(F.col("visit") == visit).select("usubjid")]
        for df in at[1:]:
            at[0] = at[0].unionByName(df)
        out = semi(at[0], test and F.upper("testcd") == test.upper())
    elif test:
        out = semi(ctx["lb"], F.upper("testcd") == test.upper())
    return out.join(ctx["persons"], "usubjid").select("usubjid", "person_id")


def _meeting(subjects: DataFrame, records: DataFrame, filters) -> DataFrame:
    """The subjects with a record that meets all filters at once."""
    for f in filters:
        records = records if f is None else records.where(f)
    return subjects.join(records, "usubjid", "left_semi")


def collapse(subjects: DataFrame) -> DataFrame:
    """(n_persons, n_subjects): each person counts once."""
    return subjects.agg(F.count_distinct("person_id").alias("n_persons"), F.count("*").alias("n_subjects"))


def near_miss(ds: DataFrame, status: str, reason: str) -> DataFrame:
    """When no subject has the status for the reason: who has it for other reasons, by reason."""
    hit = F.upper("term").contains(reason.upper())
    own = ds.where(F.upper("decod").contains(status.upper()))
    return own.where(~hit).groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("usubjid").alias("n_subjects"))
