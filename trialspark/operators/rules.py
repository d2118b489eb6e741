"""Clinical rules: each is a DataFrame of findings with the subject, what was found and the records behind it."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalise as N
from .identity import duplicates
from .labs import conversions, convert


@dataclass(frozen=True)
class Rules:
    """Parameters that a protocol states; a rule whose parameter is None is unavailable and finds nothing."""

    age_min: int | None = 18
    age_max: int | None = 75
    hba1c_min: float | None = 7.0
    hba1c_max: float | None = 10.5
    hepatic_multiple: float | None = 2.5
    creatinine_max: float | None = 1.5
    creatinine_unit: str | None = "mg/dL"
    pregnancy_excluded: bool | None = True
    visit_window_days: int | None = 3
    transaminase_multiple: float | None = 3.0
    bilirubin_multiple: float | None = 2.0
    hys_days: int | None = 14
    sae_hosp_rule: bool | None = True
    dose_unit: str | None = "mg"
    expected_dose: dict[str, float] = field(default_factory=lambda: {"DRUG": 10.0, "PLACEBO": 0.0})
    visit_schedule: dict[str, int] = field(default_factory=lambda: {"SCREENING": -14, "BASELINE": 0, "WEEK2": 14, "WEEK4": 28, "WEEK8": 56, "WEEK12": 84})
    prohibited: tuple[str, ...] = ("Systemic Glucocorticoid", "Sulfonylurea")

    def unavailable(self) -> dict[str, str]:
        """code -> why a rule can't run."""
        stated = lambda name: getattr(self, name) not in (None, {}, ())
        return {code: "no " + ", ".join(" or ".join(g) for g in gone) for code, groups in NEEDS.items() if (gone := [g for g in groups if not any(map(stated, g))])}


#: The parameters that a rule needs: one of each group.
NEEDS = {
    "HYS_LAW_CANDIDATE": (("transaminase_multiple",), ("bilirubin_multiple",), ("hys_days",)), "VISIT_WINDOW_DEVIATION": (("visit_window_days",), ("visit_schedule",)), "DOSING_ERROR": (("expected_dose",),),
    "MISSING_DOSE": (("expected_dose",),), "PROHIBITED_MEDICATION": (("prohibited",),), "ELIGIBILITY_VIOLATION": (("age_min", "hba1c_min", "hepatic_multiple"),),
}


def availability(parameters: DataFrame) -> DataFrame:
    """(version, code, reason) of the rules that can't run under each version's parameters, a column each, null if not stated."""
    told = lambda g: F.when(F.coalesce(*[F.col(n).cast("string") for n in g]).isNull(), " or ".join(g))
    rows = [F.struct(F.lit(code).alias("code"), F.array_compact(F.array(*map(told, groups))).alias("gone")) for code, groups in NEEDS.items()]
    each = parameters.select("version", F.explode(F.array(*rows)).alias("_r"))
    return each.where(F.size("_r.gone") > 0).select("version", F.col("_r.code").alias("code"), F.concat(F.lit("no "), F.array_join("_r.gone", ", ")).alias("reason"))


TRANSAMINASES = ("ALT", "AST")


def first_dose(dm: DataFrame, ex: DataFrame) -> DataFrame:
    """(usubjid, first_dose): the reference start date, else the earliest exposure."""
    earliest = ex.groupBy("usubjid").agg(F.min(N.date_of(F.col("stdtc"))).alias("_ex"))
    return dm.join(earliest, "usubjid", "left").select("usubjid", F.coalesce(N.date_of(F.col("rfstdtc")), F.col("_ex")).alias("first_dose"))


def hys_pairs(labs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(usubjid, t_seq, b_seq, days, t_mult, b_mult): raised transaminase and bilirubin within the days allowed.

    Only comparable, dated results beyond their multiples are joined; they meet by subject and by windows of days,
    so a subject with many results doesn't square them.
    """
    days = rules.hys_days
    dated = labs.where("status = 'ok' and date is not null")
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / (days + 1)).cast("bigint")
    t = dated.where(F.col("testcd").isin(*TRANSAMINASES) & (F.col("std_value") > rules.transaminase_multiple * F.col("high"))).select("usubjid", F.col("seq").alias("t_seq"), F.col("date").alias("t_date"), F.col("multiple").alias("t_mult"), F.explode(F.sequence(bucket(F.col("date")) - 1, bucket(F.col("date")) + 1)).alias("_w"))
    b = dated.where((F.col("testcd") == "BILI") & (F.col("std_value") > rules.bilirubin_multiple * F.col("high"))).select("usubjid", F.col("seq").alias("b_seq"), F.col("date").alias("b_date"), F.col("multiple").alias("b_mult"), bucket(F.col("date")).alias("_w"))
    gap = F.abs(F.datediff("t_date", "b_date"))
    return t.join(b, ["usubjid", "_w"]).where(gap <= days).withColumn("days", gap).drop("_w", "t_date", "b_date")


def best_pairs(pairs: DataFrame) -> DataFrame:
    """The strongest pair of each subject: highest multiples, fewest days, first records."""
    best = W.partitionBy("usubjid").orderBy(F.desc("t_mult"), F.desc("b_mult"), "days", "t_seq", "b_seq")
    return pairs.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def raised_baseline(labs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(usubjid): subjects whose transaminases were beyond the multiple at screening or baseline already."""
    return labs.where(F.col("testcd").isin(*TRANSAMINASES) & N.visit_code(F.col("visit")).isin("SCREENING", "BASELINE") & (F.col("std_value") > rules.transaminase_multiple * F.col("high"))).select("usubjid").distinct()


def hys_law(labs: DataFrame, mh: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Candidates with their best pair, and whether a raised baseline or a history of cholestasis makes them uncertain."""
    pairs = hys_pairs(labs, rules)
    n = pairs.groupBy("usubjid").agg(F.count("*").alias("n_pairs"))
    base = raised_baseline(labs, rules).withColumn("_base", F.lit(True))
    history = mh.where(F.lower("term").contains("cholesta")).select("usubjid").distinct().withColumn("_hist", F.lit(True))
    out = best_pairs(pairs).join(n, "usubjid").join(base, "usubjid", "left").join(history, "usubjid", "left")
    flagged = F.coalesce("_base", F.lit(False)) | F.coalesce("_hist", F.lit(False))
    return out.select("usubjid", "t_seq", "b_seq", "days", "t_mult", "b_mult", "n_pairs", F.coalesce("_base", F.lit(False)).alias("baseline_elevated"), F.coalesce("_hist", F.lit(False)).alias("cholestasis_history"), F.when(flagged, 0.70).otherwise(0.95).alias("confidence"))


def serious_ae(ae: DataFrame, rules: Rules = Rules()) -> DataFrame:
    coded, hospital = N.yes_flag(F.col("ser")), N.yes_flag(F.col("hosp")) & F.lit(bool(rules.sae_hosp_rule))
    return ae.where(coded | hospital).select("usubjid", "seq", F.when(coded, "SAE_CODED").otherwise("SAE_MISCODED").alias("subcode"), F.lit(0.95).alias("confidence"))


def ae_before_first_dose(ae: DataFrame, doses: DataFrame) -> DataFrame:
    start = N.date_of(F.col("stdtc"))
    return ae.withColumn("_start", start).join(doses, "usubjid").where("_start < first_dose").select("usubjid", "seq", F.datediff("first_dose", "_start").alias("days_before"))


def wrong_doses(ex: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Exposure records whose numeric dose isn't their arm's."""
    expected = F.create_map(*[F.lit(x) for pair in rules.expected_dose.items() for x in pair])
    dose = N.number(F.col("dose"))
    out = ex.withColumn("actual", dose).withColumn("expected", F.try_element_at(expected, N.arm_key(F.col("arm"), list(rules.expected_dose))))
    return out.where(F.abs(F.col("actual") - F.col("expected")) > 1e-9)


def dosing_error(ex: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One finding a subject: wrong records, and records in another unit, which only flag."""
    unit = N.canonical_unit(F.col("unit")) != N.canonical_unit(F.lit(rules.dose_unit))
    flags = ex.groupBy("usubjid").agg(F.count_if(unit).alias("n_unit_flags"), F.count_if(N.number(F.col("dose")).isNull()).alias("n_unparseable"))
    wrong = wrong_doses(ex, rules).groupBy("usubjid").agg(F.count("*").alias("n_wrong"), F.min("seq").alias("first_seq"))
    return wrong.join(flags, "usubjid").withColumn("confidence", F.when(F.col("n_unit_flags") > 0, 0.85).otherwise(0.95))


def no_exposure(dm: DataFrame, ex: DataFrame) -> DataFrame:
    return dm.join(ex.select("usubjid").distinct(), "usubjid", "left_anti").select("usubjid")


def dosed_visits(ex: DataFrame) -> DataFrame:
    """(visit): the visits at which anyone was dosed, the one fact about all subjects that a subject's findings rest on."""
    return ex.select(N.visit_code(F.col("visit")).alias("visit")).distinct()


def dose_gaps(ex: DataFrame, ds: DataFrame, rules: Rules = Rules(), dosed: DataFrame | None = None) -> DataFrame:
    """(usubjid, visit, ord): visits expected of each subject at which nothing was given.

    Expected are the scheduled visits at which anyone was dosed (`dosed`, if ex holds some subjects only), from the
    subject's first to its last, or to the end if it completed.
    """
    spark = ex.sparkSession
    order = spark.createDataFrame([(v, i) for i, v in enumerate(sorted(rules.visit_schedule, key=rules.visit_schedule.get))], "visit string, ord int")
    given = ex.select("usubjid", N.visit_code(F.col("visit")).alias("visit")).distinct().join(F.broadcast(order), "visit")  # the schedule: a few dozen visits
    used = given.select("visit", "ord").distinct() if dosed is None else dosed.join(F.broadcast(order), "visit")
    done = last_disposition(ds).where("upper(decod) like 'COMPLET%'").select("usubjid", F.lit(True).alias("_done"))
    last = F.broadcast(used.agg(F.max("ord").alias("_end")))
    span = given.groupBy("usubjid").agg(F.min("ord").alias("_from"), F.max("ord").alias("_to")).join(done, "usubjid", "left").join(last).withColumn("_to", F.when(F.col("_done"), F.col("_end")).otherwise(F.col("_to")))
    expected = span.select("usubjid", F.explode(F.sequence("_from", "_to")).alias("ord")).join(F.broadcast(used), "ord")
    return expected.join(given.select("usubjid", "ord"), ["usubjid", "ord"], "left_anti").select("usubjid", "visit", "ord")


def gap_neighbours(gaps: DataFrame, ex: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Each gap with the nearest recorded visits before and after it."""
    order = F.create_map(*[F.lit(x) for i, v in enumerate(sorted(rules.visit_schedule, key=rules.visit_schedule.get)) for x in (v, i)])
    given = ex.select("usubjid", F.try_element_at(order, N.visit_code(F.col("visit"))).alias("_o")).where("_o is not null").groupBy("usubjid").agg(F.sort_array(F.collect_set("_o")).alias("_given"))  # at most a schedule's visits
    out = gaps.join(given, "usubjid", "left")
    return out.select("usubjid", "visit", "ord", F.array_max(F.filter("_given", lambda x: x < F.col("ord"))).alias("before"), F.array_min(F.filter("_given", lambda x: x > F.col("ord"))).alias("after"))


def missing_dose(dm: DataFrame, ex: DataFrame, ds: DataFrame, rules: Rules = Rules(), dosed: DataFrame | None = None) -> DataFrame:
    gaps = dose_gaps(ex, ds, rules, dosed).groupBy("usubjid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "visit"))), lambda x: x["visit"]), ",").alias("visits"))
    none = no_exposure(dm, ex).select("usubjid", F.lit("NO_EXPOSURE").alias("subcode"), F.lit("").alias("visits"), F.lit(0.85).alias("confidence"))
    return gaps.select("usubjid", F.lit("MISSING_DOSE").alias("subcode"), "visits", F.lit(0.8).alias("confidence")).unionByName(none)


def earliest_visits(records: DataFrame) -> DataFrame:
    """(usubjid, visit, actual, n, first_domain, first_seq, carriers): each visit's earliest date over all domains (domain, usubjid, visit, date, seq), how many records have it, and the first three of them."""
    dated = records.where("date is not null and visit <> ''")
    first = dated.groupBy("usubjid", "visit").agg(F.min("date").alias("actual"))
    at = dated.join(first, ["usubjid", "visit"]).where("date = actual").groupBy("usubjid", "visit", "actual").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list(F.struct("domain", "seq"))), 1, 3).alias("_c"))
    return at.select("usubjid", "visit", "actual", "n", F.col("_c")[0]["domain"].alias("first_domain"), F.col("_c")[0]["seq"].alias("first_seq"), F.array_join(F.transform("_c", lambda x: F.concat_ws(":", x["domain"], x["seq"].cast("string"))), ",").alias("carriers"))


#: What a day and a record's number are shifted by so that neither is negative, and what a day is worth in one number of both.
_DAY0, _SEQ0, _DAY = 1_000_000, 2**63 + 1, Decimal(10**20)


def first_visits(records: DataFrame) -> DataFrame:
    """(usubjid, visit, actual, first_domain, first_seq): earliest_visits without counts and carriers.

    A domain's date and seq (null first) are one decimal number, whose minimum a hash aggregation keeps in place: records are
    reduced where they are read, and only a row a subject, visit and domain is moved.
    """
    n = F.coalesce(F.col("seq").cast("decimal(20,0)") + F.lit(Decimal(_SEQ0)), F.lit(Decimal(0)))
    packed = (F.datediff("date", F.lit("1970-01-01").cast("date")) + _DAY0).cast("decimal(8,0)") * F.lit(_DAY) + n
    one = records.where("date is not null and visit <> ''").select("usubjid", "visit", "domain", packed.cast("decimal(38,0)").alias("_p")).groupBy("usubjid", "visit", "domain").agg(F.min("_p").alias("_p"))
    at = F.floor(F.col("_p") / F.lit(_DAY)).cast("int")
    first = one.groupBy("usubjid", "visit").agg(F.min(F.struct(at.alias("at"), "domain", (F.col("_p") % F.lit(_DAY)).cast("decimal(20,0)").alias("n"))).alias("_f"))
    seq = F.when(F.col("_f.n") > 0, (F.col("_f.n") - F.lit(Decimal(_SEQ0))).cast("bigint"))
    return first.select("usubjid", "visit", F.date_add(F.lit("1970-01-01").cast("date"), F.col("_f.at") - _DAY0).alias("actual"), F.col("_f.domain").alias("first_domain"), seq.alias("first_seq"))


def visit_windows(records: DataFrame, doses: DataFrame, rules: Rules = Rules()) -> DataFrame:
    day = F.try_element_at(F.create_map(*[F.lit(x) for pair in rules.visit_schedule.items() for x in pair]), F.col("visit"))
    out = first_visits(records).withColumn("scheduled", day).where("scheduled is not null").join(doses, "usubjid")
    out = out.withColumn("offset", F.datediff("actual", "first_dose") - F.col("scheduled"))
    return out.where(F.abs("offset") > rules.visit_window_days).select("usubjid", "visit", "scheduled", "offset", "first_domain", "first_seq")


def prohibited_medication(cm: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return cm.withColumn("matched", N.match_prohibited(F.col("cls"), F.col("trt"), list(rules.prohibited))).where("matched is not null").select("usubjid", "seq", "matched")


def outside(value, low, high):
    """Whether a value is below or above; a bound that isn't stated bounds nothing."""
    return (value < low if low is not None else F.lit(False)) | (value > high if high is not None else F.lit(False))


def eligibility(dm: DataFrame, labs: DataFrame, mh: DataFrame, ae: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """(usubjid, subcode, domain, seq): a subject's violations, each with its record; what can't be parsed or converted violates nothing.

    Every screening result counts, creatinine in whatever unit converts to the protocol's; without one in DM the first
    screening HbA1c does.
    """
    form = lambda df, code, domain, seq="seq": df.select("usubjid", F.lit(code).alias("subcode"), F.lit(domain).alias("domain"), (F.col(seq) if seq else F.lit(None)).cast("bigint").alias("seq"))
    screening = labs.where(N.visit_code(F.col("visit")) == "SCREENING")
    text = F.col("scr_hba1c") if "scr_hba1c" in dm.columns else F.lit(None).cast("string")
    blank = F.coalesce(N.strip(text), F.lit("")) == ""
    first = screening.where("testcd = 'HBA1C'").groupBy("usubjid").agg(F.min_by(F.struct("value", "seq"), "seq").alias("_f"))
    parts = [
        form(dm.where(outside(N.number(F.col("age")), rules.age_min, rules.age_max)), "AGE_OUT_OF_RANGE", "DM", None), form(dm.where(outside(N.number(text), rules.hba1c_min, rules.hba1c_max)), "HBA1C_OUT_OF_RANGE", "DM", None),
        form(dm.where(blank).join(first, "usubjid").where(outside(F.col("_f.value"), rules.hba1c_min, rules.hba1c_max)).withColumn("seq", F.col("_f.seq")), "HBA1C_OUT_OF_RANGE", "LB"),
    ]
    if rules.hepatic_multiple is not None:
        parts.append(form(screening.where(F.col("testcd").isin(*TRANSAMINASES) & (F.col("multiple") > rules.hepatic_multiple)), "HEPATIC_SCREENING", "LB"))
    if rules.creatinine_max is not None:
        creat = screening.where(F.col("testcd").isin("CREAT", "CREATININE") & (F.col("kind") == "numeric")).drop("factor").withColumn("_unit", F.lit(rules.creatinine_unit or ""))
        same = (N.canonical_unit(F.coalesce("unit", F.lit(""))) == "") | (F.col("_unit") == "")
        value = F.when(same, F.col("value")).otherwise(F.col("value") * F.col("factor"))
        parts.append(form(convert(creat, "testcd", "unit", "_unit", conversions(labs.sparkSession)).where(value > rules.creatinine_max), "CREATININE_SCREENING", "LB"))
    if rules.pregnancy_excluded:
        parts += [form(df.where(F.lower("term").contains("pregnan")), "PREGNANCY", d) for d, df in (("MH", mh), ("AE", ae)) if df is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def eligibility_confidence(subcode):
    """A pregnancy is read from a term and so less sure than a number out of its range."""
    return F.when(subcode == "PREGNANCY", 0.7).otherwise(0.9)


def last_disposition(ds: DataFrame) -> DataFrame:
    return ds.groupBy("usubjid").agg(F.max_by(F.struct("decod", "term", "seq"), "row_no").alias("_l")).select("usubjid", "_l.*")


#: Severity of a finding, by code and subcode.
def severity(code, subcode):
    return F.when((code == "HYS_LAW_CANDIDATE") | (subcode == "SAE_MISCODED"), "CRITICAL").when(code.isin("SERIOUS_AE", "DOSING_ERROR", "ELIGIBILITY_VIOLATION"), "HIGH").otherwise("MEDIUM")


def _form(df: DataFrame, code: str, domain: str, seq=None, sub=None) -> DataFrame:
    return df.select(F.lit(code).alias("code"), "usubjid", (F.lit("") if sub is None else sub).alias("subcode"), F.lit(domain).alias("domain"), (F.lit(None) if seq is None else seq).cast("bigint").alias("seq"))


FINDING = "code string, usubjid string, subcode string, domain string, seq bigint"

#: The rules by code: functions of the study's context and the protocol's parameters to (code, usubjid, subcode, domain, seq).
RULES = {
    "HYS_LAW_CANDIDATE": lambda ctx, rules: _form(hys_law(ctx["labs"], ctx["mh"], rules), "HYS_LAW_CANDIDATE", "LB", F.col("t_seq")),
    "SERIOUS_AE": lambda ctx, rules: _form(serious_ae(ctx["ae"], rules), "SERIOUS_AE", "AE", F.col("seq"), F.col("subcode")),
    "AE_BEFORE_FIRST_DOSE": lambda ctx, rules: _form(ae_before_first_dose(ctx["ae"], ctx["doses"]), "AE_BEFORE_FIRST_DOSE", "AE", F.col("seq")),
    "DOSING_ERROR": lambda ctx, rules: _form(dosing_error(ctx["ex"], rules), "DOSING_ERROR", "EX", F.col("first_seq")),
    "MISSING_DOSE": lambda ctx, rules: _form(missing_dose(ctx["dm"], ctx["ex"], ctx["ds"], rules, ctx.get("dosed")), "MISSING_DOSE", "EX", sub=F.col("subcode")),
    "VISIT_WINDOW_DEVIATION": lambda ctx, rules: visit_windows(ctx["visits"], ctx["doses"], rules).select(F.lit("VISIT_WINDOW_DEVIATION").alias("code"), "usubjid", F.col("visit").alias("subcode"), F.col("first_domain").alias("domain"), F.col("first_seq").alias("seq")),
    "PROHIBITED_MEDICATION": lambda ctx, rules: _form(prohibited_medication(ctx["cm"], rules), "PROHIBITED_MEDICATION", "CM", F.col("seq")),
    "ELIGIBILITY_VIOLATION": lambda ctx, rules: eligibility(ctx["dm"], ctx["labs"], ctx["mh"], ctx["ae"], rules).select(F.lit("ELIGIBILITY_VIOLATION").alias("code"), "usubjid", "subcode", "domain", "seq"),
    "DUPLICATE_SUBJECT": lambda ctx, rules: _form(duplicates(ctx["persons"]).withColumnRenamed("person_id", "usubjid"), "DUPLICATE_SUBJECT", "DM"),
}


def run_rule(ctx: dict, code: str, rules: Rules = Rules()) -> DataFrame:
    """One rule's findings; an unavailable rule finds nothing, an unknown code is a KeyError."""
    rule = RULES[code]
    if code in rules.unavailable():
        return ctx["dm"].sparkSession.createDataFrame([], FINDING)
    return rule(ctx, rules)


def all_findings(ctx: dict, rules: Rules = Rules(), codes=None) -> DataFrame:
    """Every available rule's findings (or those of some codes) in one form: (code, usubjid, subcode, domain, seq)."""
    off, out = rules.unavailable(), None
    for code, rule in RULES.items():
        if code not in off and (codes is None or code in codes):
            out = rule(ctx, rules) if out is None else out.unionByName(rule(ctx, rules))
    return out if out is not None else ctx["dm"].sparkSession.createDataFrame([], FINDING)
