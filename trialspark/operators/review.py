"""The review cycle's nodes: detect, medical review, data queries, compliance, the human gate, execution.

Each node is a DataFrame of the one before; what earlier cycles did is a table of fingerprints (memory), against
which new work is anti-joined, so the same cut run twice opens nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from . import rules as R

DATA_QUALITY = ("VISIT_WINDOW_DEVIATION", "MISSING_DOSE", "AE_BEFORE_FIRST_DOSE")
COMPLIANCE = ("DOSING_ERROR", "PROHIBITED_MEDICATION", "ELIGIBILITY_VIOLATION", "DUPLICATE_SUBJECT")
ESCALATED = ("SERIOUS_AE", "HYS_LAW_CANDIDATE")


def with_reply(df: DataFrame, replies: DataFrame, default: str) -> DataFrame:
    """df (key) with the reply to it, else the default, and whether it was an exact hit."""
    r = replies.select("key", F.col("status").alias("_s")).dropDuplicates(["key"])
    return df.join(r, "key", "left").withColumn("exact_hit", F.col("_s").isNotNull()).withColumn("reply", F.coalesce("_s", F.lit(default))).drop("_s")


def with_decision(df: DataFrame, decisions: DataFrame, aliases: dict[str, str], default: str | None = None) -> DataFrame:
    """df (code, usubjid, site) with the first decision by (code, subject), (alias, subject), (code, site), (alias, site)."""
    alias = F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), F.col("code")) if aliases else F.lit(None).cast("string")
    keys = [F.concat(c, F.lit("|"), F.col(t)) for t in ("usubjid", "site") for c in (F.col("code"), alias)]
    ordered = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("p"), F.get(F.array(*keys), i).alias("key"))), lambda x: x["key"].isNotNull())
    asked = df.select("code", "usubjid", "site").distinct().withColumn("_k", F.explode(ordered)).select("code", "usubjid", "site", "_k.p", "_k.key")
    found = asked.join(decisions.select("key", F.col("decision").alias("_d")).dropDuplicates(["key"]), "key").groupBy("code", "usubjid", "site").agg(F.min_by("_d", "p").alias("decision"))
    out = df.join(found, ["code", "usubjid", "site"], "left")
    return out if default is None else out.withColumn("decision", F.coalesce("decision", F.lit(default)))


def fingerprint() -> Column:
    return F.concat_ws("|", "code", "usubjid", "domain", F.coalesce(F.col("seq").cast("string"), F.lit("")), "subcode")


def detect(findings: DataFrame) -> DataFrame:
    """Findings of all rules with severity, site and fingerprint, each once: by the columns that make the fingerprint, before it is written out."""
    site = F.get(F.split("usubjid", "-"), F.lit(1))
    once = findings.dropDuplicates(["code", "usubjid", "subcode", "domain", "seq"])
    return once.withColumn("severity", R.severity(F.col("code"), F.col("subcode"))).withColumn("site", site).withColumn("fingerprint", fingerprint())


def medical_review(detected: DataFrame, memory: DataFrame, baseline: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """detected with its route: known fingerprints are CARRIED; Hy's law on a baseline that was raised already (usubjid), or rejected before (fingerprint), is MONITORED."""
    mark = lambda df, bit: df.select("fingerprint", F.lit(bit).alias("_m"))
    raised = detected.where("code = 'HYS_LAW_CANDIDATE'").join(baseline.select("usubjid").distinct(), "usubjid", "left_semi")
    marks = mark(memory, 1).unionByName(mark(raised, 2))
    if rejected is not None:
        marks = marks.unionByName(mark(rejected, 2))
    out = detected.join(marks.groupBy("fingerprint").agg(F.bit_or("_m").alias("_m")), "fingerprint", "left")  # the only step that moves all findings
    marked = lambda bit: F.coalesce(F.col("_m").bitwiseAND(F.lit(bit)) != 0, F.lit(False))
    route = (
        F.when(marked(1), "CARRIED").when(F.col("code").isin(*DATA_QUALITY), "DATA_QUERY").when((F.col("code") == "HYS_LAW_CANDIDATE") & marked(2), "MONITOR")
        .when(F.col("code").isin(*ESCALATED), "ESCALATE").when(F.col("code").isin(*COMPLIANCE), "DEVIATION").otherwise("MONITOR")
    )
    return out.withColumn("route", route).drop("_m")


RECURRING = ("DOSING_ERROR", "PROHIBITED_MEDICATION")


def flagged(detected: DataFrame, cycle: int) -> DataFrame:
    """(usubjid, cycle): subjects with a compliance finding in the cycle; safety and data-quality findings flag nobody."""
    return detected.where(F.col("code").isin(*COMPLIANCE)).select("usubjid").distinct().withColumn("cycle", F.lit(cycle).cast("bigint"))


def recurring(detected: DataFrame, flags: DataFrame, cycle: int) -> DataFrame:
    """(usubjid, site, n): subjects flagged in the cycle before whose doses or medicines are wrong again; each is escalated once."""
    before = flags.where(F.col("cycle") == cycle - 1).select("usubjid").distinct()
    return detected.where(F.col("code").isin(*RECURRING)).join(before, "usubjid", "left_semi").groupBy("usubjid", "site").agg(F.count("*").alias("n"))


def data_queries(reviewed: DataFrame, replies: DataFrame, default: str = "PENDING") -> DataFrame:
    """One query a data-quality finding, with its text and the site's reply."""
    text = F.format_string("Please verify %s for subject %s (%s).", F.lower(F.replace("code", F.lit("_"), F.lit(" "))), "usubjid", F.when(F.col("subcode") == "", "record").otherwise(F.col("subcode")))
    asked = reviewed.where("route = 'DATA_QUERY'").withColumn("key", F.concat_ws("|", "domain", "usubjid", F.coalesce(F.col("seq").cast("string"), F.lit("")))).withColumn("text", text)
    return with_reply(asked, replies, default)


def compliance(reviewed: DataFrame, least: int = 2) -> DataFrame:
    """Deviations by site and code, with sites of at least `least` subjects with dosing errors escalated."""
    out = reviewed.where("route in ('DEVIATION', 'CARRIED')").where(F.col("code").isin(*COMPLIANCE)).groupBy("site", "code").agg(F.count("*").alias("n"), F.count_distinct("usubjid").alias("n_subjects"))
    return out.withColumn("site_escalation", (F.col("code") == "DOSING_ERROR") & (F.col("n_subjects") >= least))


def human_gate(reviewed: DataFrame, decisions: DataFrame, aliases: dict[str, str], default: str = "PENDING", answers: DataFrame | None = None) -> DataFrame:
    """Escalations with their status; an unanswered one is the default, never silently approved.

    CLARIFY is approved only where `answers` (usubjid, answer, refs; see clarify) cites records for it; else it is UNRESOLVED and nothing is done.
    """
    out = with_decision(reviewed.where("route = 'ESCALATE'"), decisions, aliases, default)
    if answers is None:
        out = out.withColumn("answer", F.lit(None).cast("string"))
    else:
        out = out.join(answers.where(F.size("refs") > 0).select("usubjid", "answer"), "usubjid", "left")
    asked, told = F.col("decision") == "CLARIFY", F.col("answer").isNotNull()
    status = F.when(F.col("decision") == "REJECTED", "MONITORING").when(asked & told, "APPROVED_AFTER_CLARIFICATION").when(asked, "UNRESOLVED").otherwise(F.col("decision"))
    action = F.when(~status.isin("APPROVED", "APPROVED_AFTER_CLARIFICATION"), "NONE").when(F.col("code") == "HYS_LAW_CANDIDATE", "HOLD_DOSING").otherwise("EXPEDITED_REPORT")
    return out.withColumn("status", status).withColumn("action", action).withColumn("answer", F.when(asked, F.col("answer")))


#: Classes and names of medicines that may harm the liver.
LIVER_CLASSES = ("STATIN", "SYSTEMIC_GLUCOCORTICOID", "ANTIFUNGAL", "ANTITUBERCULAR")
LIVER_NAMES = ("ATORVASTATIN", "SIMVASTATIN", "ROSUVASTATIN", "PRAVASTATIN", "PARACETAMOL", "ACETAMINOPHEN", "METHOTREXATE", "AMIODARONE", "KETOCONAZOLE", "FLUCONAZOLE", "ISONIAZID")
MEDICINES_TOLD = 20


def clarify(asked: DataFrame, lb: DataFrame, cm: DataFrame, told: int = MEDICINES_TOLD) -> DataFrame:
    """(usubjid, question, answer, refs): what the records say to the monitor's questions, for all subjects at once.

    A question about ALT, transaminases or screening is answered by the subject's first such result (by seq), one about
    medicines by those that may harm the liver, else by what it takes; refs are domain:seq. The answer names the first
    `told` medicines by seq and says how many there are; refs are of all that matter. A question about neither, or of
    a subject without such records, has no refs: it stays open.
    """
    low = F.lower("question")
    alt = lb.where((F.col("testcd") == "ALT") & N.visit_code(F.col("visit")).isin("SCREENING", "BASELINE")).groupBy("usubjid").agg(F.min_by(F.struct("orres", "unit", "visit", "dtc", "seq"), "seq").alias("_alt"))
    name, cls = N.strip(F.coalesce("trt", F.lit(""))), N.strip(F.coalesce("cls", F.lit("")))
    liver = N.class_token(cls).isin(*LIVER_CLASSES)
    for n in LIVER_NAMES:
        liver = liver | F.upper(name).contains(n)
    taken = cm.join(asked.select("usubjid").distinct(), "usubjid", "left_semi").select("usubjid", "seq", F.when(cls != "", F.concat(name, F.lit(" ("), F.upper(cls), F.lit(")"))).otherwise(name).alias("_m"), F.coalesce(liver, F.lit(False)).alias("_liver"))
    few = lambda when, n: F.slice(F.sort_array(F.filter(F.collect_list(F.when(when, F.struct("seq", "_m"))), lambda x: x.isNotNull())), 1, n)
    meds = taken.groupBy("usubjid").agg(F.count("*").alias("_n"), F.count_if("_liver").alias("_nl"), few(F.col("_liver"), told).alias("_l"), few(F.lit(True), told).alias("_a"), F.sort_array(F.collect_list(F.when(F.col("_liver"), F.col("seq")))).alias("_refs"), F.min("seq").alias("_first"))
    out = asked.join(alt, "usubjid", "left").join(meds, "usubjid", "left")
    of_alt = low.contains("alt") | low.contains("transaminase") | low.contains("screening")
    of_cm = low.contains("medication") | low.contains("medicine") | low.contains("hepatotoxic") | low.contains("drug")
    names = lambda c: F.array_join(F.transform(c, lambda x: x["_m"]), ", ")
    alt_text = F.when(F.col("_alt").isNull(), "No screening ALT on record").otherwise(F.concat(F.lit("Screening ALT was "), F.col("_alt.orres"), F.lit(" "), F.col("_alt.unit"), F.lit(" at "), F.col("_alt.visit"), F.lit(" on "), F.coalesce("_alt.dtc", F.lit("an unknown date"))))
    cm_text = (
        F.when(F.col("_n").isNull(), "No medicines on record").when(F.col("_nl") > 0, F.concat(F.col("_nl").cast("string"), F.lit(" medicine(s) that may harm the liver: "), names("_l")))
        .otherwise(F.concat(F.lit("None of "), F.col("_n").cast("string"), F.lit(" medicine(s) is known to harm the liver: "), names("_a")))
    )
    alt_refs = F.when(of_alt & F.col("_alt").isNotNull(), F.array(F.concat(F.lit("LB:"), F.col("_alt.seq").cast("string")))).otherwise(F.array().cast("array<string>"))
    liver_refs = F.transform(F.coalesce("_refs", F.array().cast("array<bigint>")), lambda x: F.concat(F.lit("CM:"), x.cast("string")))
    cm_refs = F.when(of_cm, F.when((F.size(liver_refs) == 0) & (F.size(alt_refs) == 0) & F.col("_first").isNotNull(), F.array(F.concat(F.lit("CM:"), F.col("_first").cast("string")))).otherwise(liver_refs)).otherwise(F.array().cast("array<string>"))
    text = F.concat_ws(". ", F.when(of_alt, alt_text), F.when(of_cm, cm_text))
    return out.select("usubjid", "question", F.when(of_alt | of_cm, F.concat(text, F.lit("."))).alias("answer"), F.concat(alt_refs, cm_refs).alias("refs"))


def execute(reviewed: DataFrame, gate: DataFrame) -> DataFrame:
    """The cycle's statistics: (what, n)."""
    n = lambda df, c: df.groupBy(c.alias("what")).agg(F.count("*").alias("n"))
    return n(reviewed, F.concat(F.lit("route:"), "route")).unionByName(n(gate, F.concat(F.lit("status:"), "status"))).unionByName(n(reviewed, F.concat(F.lit("severity:"), "severity")))


def remember(memory: DataFrame, reviewed: DataFrame, cut: int) -> DataFrame:
    """memory with this cycle's new fingerprints."""
    new = reviewed.where("route <> 'CARRIED'").select("fingerprint", F.lit(cut).alias("cut")).join(memory, "fingerprint", "left_anti")
    return memory.unionByName(new)
