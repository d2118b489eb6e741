"""From one cut to the next: what new records, corrections and a new protocol version touch is derived again, no more.

Findings are kept by rule and subject. A table of dependencies says which rules read which domains; subjects with a new or
corrected record are touched. A rule with a touched domain is derived for the touched subjects alone, on their whole
records, and its findings of other subjects stay. A rule is derived for everyone when a parameter that it reads changed,
or when what it knows of all subjects (the visits at which anyone was dosed) did.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import PRIMARY
from .ledger import DEPENDS
from .rules import Rules

#: The domains that each rule reads.
READS = {
    "HYS_LAW_CANDIDATE": ("LB", "MH"), "SERIOUS_AE": ("AE",), "AE_BEFORE_FIRST_DOSE": ("AE", "DM", "EX"), "DOSING_ERROR": ("EX", "DM"), "MISSING_DOSE": ("DM", "EX", "DS"),
    "VISIT_WINDOW_DEVIATION": ("LB", "VS", "EG", "EX", "DM"), "PROHIBITED_MEDICATION": ("CM",), "ELIGIBILITY_VIOLATION": ("DM", "LB", "MH", "AE"), "DUPLICATE_SUBJECT": ("DM",),
}


@dataclass(frozen=True)
class Dirty:
    """The rules to derive again for touched subjects, and those for everyone."""

    touched: tuple[str, ...]
    everyone: tuple[str, ...]


def touched(domains: dict[str, DataFrame], corrections: DataFrame, cut: int) -> DataFrame:
    """(domain, usubjid, n_new, n_corrected): subjects with records or corrections of the cut; tables without cut_available never change by arrival."""
    told = corrections if "domain" in corrections.columns else corrections.withColumn("domain", F.lit("LB"))
    out = told.where(F.col("cut") == cut).select("domain", "usubjid", F.lit(0).alias("_n"), F.lit(1).alias("_c"))
    for name, df in domains.items():
        if "cut_available" in df.columns:
            out = out.unionByName(df.where(F.col("cut_available") == cut).select(F.lit(name).alias("domain"), "usubjid", F.lit(1).alias("_n"), F.lit(0).alias("_c")))
    return out.groupBy("domain", "usubjid").agg(F.sum("_n").alias("n_new"), F.sum("_c").alias("n_corrected"))


def changed_fields(old: Rules, new: Rules) -> set[str]:
    return {f.name for f in fields(Rules) if getattr(old, f.name) != getattr(new, f.name)}


def dirty(domains: set[str], changed: set[str], dosed_changed: bool = False) -> Dirty:
    """What touched domains, changed parameters and changed dosing visits make to derive again."""
    everyone = {code for f in changed for code in DEPENDS.get(f, tuple(READS))} | ({"MISSING_DOSE"} if dosed_changed else set())
    some = {code for code, read in READS.items() if domains & set(read)} - everyone
    return Dirty(tuple(sorted(some)), tuple(sorted(everyone)))


def identity() -> Column:
    """The primary identity by which subjects are taken for one person; null unless it is whole."""
    parts = [F.upper(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in PRIMARY]
    whole = F.lit(True)
    for p in parts:
        whole = whole & (p != "")
    return F.when(whole, F.concat_ws("\x1f", *parts))


def kin(subjects: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """(usubjid): subjects and all who share an identity with one of them, in the table before or now."""
    ids = before.select("usubjid", identity().alias("_id")).unionByName(now.select("usubjid", identity().alias("_id"))).where("_id is not null").distinct()
    own = ids.join(subjects, "usubjid", "left_semi").select("_id").distinct()
    return subjects.unionByName(ids.join(own, "_id", "left_semi").select("usubjid")).distinct()


def merged(prior: DataFrame, again: Dirty, subjects: DataFrame, some: DataFrame, whole: DataFrame) -> DataFrame:
    """The cut's findings: of `prior` what isn't derived again, then what was derived for the subjects and for everyone."""
    stays = prior.where(~F.col("code").isin(*again.touched, *again.everyone)) if again.touched or again.everyone else prior
    others = prior.where(F.col("code").isin(*again.touched)).join(subjects, "usubjid", "left_anti") if again.touched else prior.limit(0)
    out = [df.select("code", "usubjid", "subcode", "domain", "seq") for df in (stays, others, some, whole)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
