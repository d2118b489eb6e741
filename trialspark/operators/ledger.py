"""What surveillance keeps across cuts: the finding ledger, retractions, quarantine, standing limits, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalise as N


def running(df: DataFrame) -> DataFrame:
    """(cut, n_new, n_total): counts a cut and so far; the window is over one row a cut."""
    return df.groupBy(F.col("cut_available").alias("cut")).agg(F.count("*").alias("n_new")).withColumn("n_total", F.sum("n_new").over(W.orderBy("cut")))


def two_cycles(seen: DataFrame) -> DataFrame:
    """(usubjid, cycle): seen in the cycle and in the one before; a re-run of a cycle counts once."""
    once = seen.select("usubjid", "cycle").distinct()
    return once.withColumn("_p", F.lag("cycle").over(W.partitionBy("usubjid").orderBy("cycle"))).where("_p = cycle - 1").drop("_p")


def ledger(findings: DataFrame) -> DataFrame:
    """(fingerprint, first_seen, last_seen, n_cuts, status) of (fingerprint, cut): what the last cut no longer has is RESOLVED."""
    last = findings.agg(F.max("cut").alias("_last"))
    out = findings.groupBy("fingerprint").agg(F.min("cut").alias("first_seen"), F.max("cut").alias("last_seen"), F.count_distinct("cut").alias("n_cuts"))
    return out.join(F.broadcast(last)).withColumn("status", F.when(F.col("last_seen") == F.col("_last"), "OPEN").otherwise("RESOLVED")).drop("_last")


def period(cuts: DataFrame) -> DataFrame:
    """A period's cuts (cut, version, findings, serious, queries) with running sums and changes of version.

    A cut that was run again counts once, by its last run (run, if there is such a column): sums stay the same under
    repeats. The windows are over one row a cut.
    """
    run = F.col("run") if "run" in cuts.columns else F.lit(0)
    once = cuts.groupBy("cut").agg(*[F.max_by(c, F.struct(run, F.col(c))).alias(c) for c in ("version", "findings", "serious", "queries")])
    order = W.orderBy("cut")
    for c in ("findings", "serious", "queries"):
        once = once.withColumn(f"{c}_so_far", F.sum(c).over(order))
    before = F.lag("version").over(order)
    return once.withColumn("from_version", F.when(before != F.col("version"), before)).withColumn("to_version", F.when(before != F.col("version"), F.col("version")))


def quarantined(findings: DataFrame, sites: DataFrame, tests: DataFrame) -> DataFrame:
    """findings with status QUARANTINED where the site, or the site's test, is not trusted; names compare in upper case."""
    s = sites.select(F.upper("site").alias("_s")).distinct().withColumn("_q", F.lit(True))
    t = tests.select(F.upper("site").alias("_ts"), "testcd").distinct().withColumn("_t", F.lit(True))
    out = findings.join(s, F.upper("site") == F.col("_s"), "left").join(t.withColumnRenamed("testcd", "_tc"), (F.upper("site") == F.col("_ts")) & (F.col("testcd") == F.col("_tc")), "left")
    return out.withColumn("status", F.when(F.coalesce("_q", "_t"), "QUARANTINED").otherwise("ACTIVE")).drop("_s", "_q", "_ts", "_tc", "_t")


def unescalated(serious: DataFrame, escalations: DataFrame) -> DataFrame:
    """Serious findings (fingerprint, cut) without an escalation at their cut or before."""
    e = escalations.select(F.col("fingerprint").alias("_f"), F.col("cut").alias("_c"))
    return serious.join(e, (F.col("fingerprint") == F.col("_f")) & (F.col("_c") <= F.col("cut")), "left_anti")


def retracted(before: DataFrame, now: DataFrame, corrections: DataFrame) -> DataFrame:
    """Findings (fingerprint, usubjid, seq) that touch a corrected record and are gone now."""
    touched = corrections.select("usubjid", "seq").distinct()
    return before.join(touched, ["usubjid", "seq"], "left_semi").join(now.select("fingerprint"), "fingerprint", "left_anti")


def document_changes(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, sha256, change) of (name, text) against the registry's (name, sha256): NEW, MODIFIED, UNCHANGED. Nothing in a text is executed."""
    r = registry.select("name", F.col("sha256").alias("_old"))
    out = documents.select("name", F.sha2("text", 256).alias("sha256")).join(r, "name", "left")
    return out.withColumn("change", F.when(F.col("_old").isNull(), "NEW").when(F.col("_old") != F.col("sha256"), "MODIFIED").otherwise("UNCHANGED")).drop("_old")


def document_instructions(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """document_changes with what the text asks of automated readers: n_instructions and their sentences, which are reported and never done."""
    told = documents.select("name", F.explode(N.sentences(F.col("text"))).alias("sentence")).where(N.instruction_reasons(F.col("sentence")).isNotNull())
    told = told.groupBy("name").agg(F.count("*").alias("n_instructions"), F.sort_array(F.collect_set("sentence")).alias("instructions"))
    out = document_changes(documents, registry).join(told, "name", "left")
    return out.withColumn("n_instructions", F.coalesce("n_instructions", F.lit(0))).withColumn("instructions", F.coalesce("instructions", F.array().cast("array<string>")))


#: The protocol parameters that each rule reads.
DEPENDS = {
    "visit_window_days": ("VISIT_WINDOW_DEVIATION",), "visit_schedule": ("VISIT_WINDOW_DEVIATION", "MISSING_DOSE"), "prohibited": ("PROHIBITED_MEDICATION",), "expected_dose": ("DOSING_ERROR",), "dose_unit": ("DOSING_ERROR",),
    "age_min": ("ELIGIBILITY_VIOLATION",), "age_max": ("ELIGIBILITY_VIOLATION",), "hba1c_min": ("ELIGIBILITY_VIOLATION",), "hba1c_max": ("ELIGIBILITY_VIOLATION",), "hepatic_multiple": ("ELIGIBILITY_VIOLATION",),
    "creatinine_max": ("ELIGIBILITY_VIOLATION",), "pregnancy_excluded": ("ELIGIBILITY_VIOLATION",), "transaminase_multiple": ("HYS_LAW_CANDIDATE",), "bilirubin_multiple": ("HYS_LAW_CANDIDATE",), "hys_days": ("HYS_LAW_CANDIDATE",), "sae_hosp_rule": ("SERIOUS_AE",),
}
DEFAULT_AFFECTED = ("ELIGIBILITY_VIOLATION", "PROHIBITED_MEDICATION", "VISIT_WINDOW_DEVIATION")


def affected_rules(changed: DataFrame) -> DataFrame:
    """(code): the rules that changed fields (field) touch; the default set if nothing is known to have changed."""
    spark = changed.sparkSession
    table = spark.createDataFrame([(f, c) for f, codes in DEPENDS.items() for c in codes], "field string, code string")
    hit = changed.join(F.broadcast(table), "field").select("code").distinct()
    default = spark.createDataFrame([(c,) for c in DEFAULT_AFFECTED], "code string")
    return hit.unionByName(default.join(hit.agg(F.count("*").alias("_n")).where("_n = 0")).select("code"))


def affected_by(changed: DataFrame, versions: DataFrame) -> DataFrame:
    """(version, code): affected_rules of many versions at once, from (version, field); a version without a known change has the default set."""
    codes = sorted({c for told in DEPENDS.values() for c in told})
    bits = F.create_map(*[x for f, told in DEPENDS.items() for x in (F.lit(f), F.lit(sum(1 << codes.index(c) for c in told)).cast("bigint"))])
    hit = changed.select("version", F.coalesce(F.try_element_at(bits, F.col("field")), F.lit(0).cast("bigint")).alias("_m"))
    every = hit.unionByName(versions.select("version", F.lit(0).cast("bigint").alias("_m"))).groupBy("version").agg(F.bit_or("_m").alias("_m"))  # a number a version, however many of its fields changed
    told = F.array_compact(F.array(*[F.when(F.col("_m").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, c) for i, c in enumerate(codes)]))
    return every.select("version", F.explode(F.when(F.col("_m") == 0, F.array(*map(F.lit, DEFAULT_AFFECTED))).otherwise(told)).alias("code"))


def human_state(escalations: DataFrame, answers: DataFrame, cut: int, delay: int | None = 1, limit: int = 4) -> DataFrame:
    """(fingerprint, raised, state): an answer counts from `delay` cuts after raising (None: never); unanswered after `limit` cuts, standing limits hold."""
    out = escalations.groupBy("fingerprint").agg(F.min("cut").alias("raised")).where(F.col("raised") <= cut).join(answers.select("fingerprint", "decision").dropDuplicates(["fingerprint"]), "fingerprint", "left")
    told = F.lit(False) if delay is None else F.col("decision").isNotNull() & (F.lit(cut) >= F.col("raised") + delay)
    state = F.when(told & (F.col("decision") == "CLARIFY"), "UNRESOLVED").when(told, F.col("decision")).when(F.lit(cut) - F.col("raised") >= limit, "STANDING_LIMITS").otherwise("PENDING")
    return out.select("fingerprint", "raised", state.alias("state"))


def human_history(escalations: DataFrame, replies: DataFrame, answered: DataFrame, last: int, limit: int = 4) -> DataFrame:
    """(fingerprint, raised, cut, state, cuts_pending, clarified): every escalation at every cut from its first to the last.

    escalations (fingerprint, cut), replies (fingerprint, cut, decision) as they come in, answered (fingerprint): those whose
    clarification the data answer. A reply holds from its cut until another one. APPROVED and REJECTED close an
    escalation; CLARIFY that is answered closes it as APPROVED, one that isn't leaves it UNRESOLVED. A cut after the
    first without any reply counts as pending; with `limit` of them standing limits hold, which closes it too: silence
    is never approval. What is closed stays as it is. Each escalation has a row a cut, so windows stay small.
    """
    raised = escalations.groupBy("fingerprint").agg(F.min("cut").alias("raised")).where(F.col("raised") <= last)
    told = replies.where(F.col("cut") <= last).join(raised, "fingerprint").withColumn("cut_", F.greatest("cut", "raised"))
    told = told.groupBy("fingerprint", F.col("cut_").alias("cut")).agg(F.max_by("decision", F.struct("cut", "decision")).alias("_new"))
    days = raised.withColumn("cut", F.explode(F.sequence("raised", F.lit(last).cast(dict(raised.dtypes)["raised"])))).join(told, ["fingerprint", "cut"], "left")
    days = days.join(answered.select("fingerprint").distinct().withColumn("_answered", F.lit(True)), "fingerprint", "left")
    so_far = W.partitionBy("fingerprint").orderBy("cut").rowsBetween(W.unboundedPreceding, 0)
    days = days.withColumn("_d", F.last("_new", ignorenulls=True).over(so_far))
    days = days.withColumn("_silent", F.sum(F.when(F.col("_d").isNull() & (F.col("cut") > F.col("raised")), 1).otherwise(0)).over(so_far))
    closing = F.when(F.col("_d").isin("APPROVED", "REJECTED"), F.col("_d")).when((F.col("_d") == "CLARIFY") & F.col("_answered"), "APPROVED").when(F.col("_silent") >= limit, "STANDING_LIMITS")
    days = days.withColumn("_c", closing).withColumn("_was", F.when(F.col("_c").isNotNull(), F.struct(F.col("_c").alias("state"), F.col("_silent").alias("n"), F.coalesce(F.col("_d") == "CLARIFY", F.lit(False)).alias("clarified"))))
    days = days.withColumn("_closed", F.first("_was", ignorenulls=True).over(so_far))
    state = F.coalesce(F.col("_closed.state"), F.when(F.col("_d") == "CLARIFY", "UNRESOLVED").otherwise("PENDING"))
    return days.select("fingerprint", "raised", "cut", state.alias("state"), F.coalesce(F.col("_closed.n"), F.col("_silent")).alias("cuts_pending"), F.coalesce(F.col("_closed.clarified"), F.lit(False)).alias("clarified"))


def budget_tier(spent_ms: float, total_ms: float = 120_000.0, reduced: float = 0.6, essential: float = 0.8) -> str:
    """FULL, REDUCED or ESSENTIAL by the share spent; safety rules run in every tier."""
    share = spent_ms / total_ms if total_ms > 0 else 1.0
    return "FULL" if share < reduced else "REDUCED" if share < essential else "ESSENTIAL"


def budget(cuts: DataFrame, total_ms: float = 120_000.0, reduced: float = 0.6, essential: float = 0.8) -> DataFrame:
    """(cut, ms, spent, tier): each cut's tier by what was spent before it; the window is over one row a cut."""
    spent = F.coalesce(F.sum("ms").over(W.orderBy("cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tier = F.when(F.col("spent") < reduced * total_ms, "FULL").when(F.col("spent") < essential * total_ms, "REDUCED").otherwise("ESSENTIAL")
    return cuts.withColumn("spent", spent).withColumn("tier", tier)


def explanation_deviates(explained: DataFrame, traced: DataFrame) -> DataFrame:
    """Decisions (decision_id, refs) whose explanation cites what the trace doesn't: (decision_id, extra)."""
    both = explained.join(traced.select("decision_id", F.col("refs").alias("_t")), "decision_id", "left")
    extra = F.array_except("refs", F.coalesce("_t", F.array().cast("array<string>")))
    return both.withColumn("extra", extra).where(F.size("extra") > 0).select("decision_id", "extra")
