"""Queries of the review cycle and of surveillance across cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import cuts as C
from ..operators import decisions as DS
from ..operators import detectors as D
from ..operators import graph as G
from ..operators import identity as I
from ..operators import labs as L
from ..operators import ledger as S
from ..operators import lookups as K
from ..operators import review as P
from ..operators import rules as R
from ..sources import study as source
from . import protocol
from .conformance import CORRECTED
from .queries import ALL_FINDINGS, CHANGED, CUT, ELIGIBLE, HITS, LABS, NOTES, PERSONS, PLAIN, PROHIBITED, RULES, SAE, SENTENCES, STD, VISITS, context, day, labs, notes, token, visit
from .registry import keep, query

SEEN = "seen AS (SELECT s.subcode || '|' || s.usubjid || '|' || s.seq AS fingerprint, s.usubjid, s.seq, a.cut_available + r.range AS cut FROM sae s JOIN ae a ON a.usubjid = s.usubjid AND a.seq = s.seq JOIN range(0, 4) r ON a.cut_available + r.range <= 10)"


def seen(s):
    """Serious findings as four cuts from their first see them."""
    f = R.serious_ae(s["ae"]).join(s["ae"].select("usubjid", "seq", "cut_available"), ["usubjid", "seq"])
    out = f.withColumn("cut", F.explode(F.sequence(F.col("cut_available"), F.least(F.col("cut_available") + 3, F.lit(10)))))
    return out.select(F.concat_ws("|", "subcode", "usubjid", "seq").alias("fingerprint"), "usubjid", "seq", F.col("cut").cast("bigint").alias("cut"))


@query("s2_ledger", "SELECT fingerprint, min(cut) AS first_seen, max(cut) AS last_seen, count(DISTINCT cut)::BIGINT AS n_cuts, CASE WHEN max(cut) = (SELECT max(cut) FROM seen) THEN 'OPEN' ELSE 'RESOLVED' END AS status FROM seen GROUP BY 1", SAE, SEEN)
def s2(s):
    return S.ledger(seen(s))


@query("s3_quarantine", "SELECT status, testcd, count(*)::BIGINT AS n FROM (SELECT l.testcd, CASE WHEN site IN ('S11', 'S12') OR (site = 'S04' AND testcd = 'GLUC') THEN 'QUARANTINED' ELSE 'ACTIVE' END AS status FROM lb l) GROUP BY 1, 2")
def s3(s):
    spark = s["lb"].sparkSession
    sites, tests = spark.createDataFrame([("s11",), ("S12",)], "site string"), spark.createDataFrame([("S04", "GLUC")], "site string, testcd string")
    return S.quarantined(s["lb"], sites, tests).groupBy("status", "testcd").agg(F.count("*").alias("n"))


@query("s4_serious", "SELECT fingerprint, cut FROM seen x WHERE NOT EXISTS (SELECT 1 FROM seen e WHERE e.fingerprint = x.fingerprint AND e.cut <= x.cut AND e.cut % 2 = 0)", SAE, SEEN)
def s4(s):
    every = seen(s).select("fingerprint", "cut")
    return S.unescalated(every, every.where("cut % 2 = 0"))


@query("jn12_retract", f"""SELECT 'ALT|' || usubjid || '|' || seq AS fingerprint, usubjid, seq FROM std x WHERE testcd = 'ALT' AND s > high AND EXISTS (SELECT 1 FROM corrections c WHERE c.usubjid = x.usubjid AND c.seq = x.seq AND c.cut <= {CUT})
  AND NOT (factor * CAST((SELECT arg_max(new_value, row(cut, row_no)) FROM corrections c WHERE c.usubjid = x.usubjid AND c.seq = x.seq AND c.cut <= {CUT}) AS DOUBLE) > high)""", LABS, STD)
def jn12(s):
    form = lambda df: L.abnormal(df, "ALT").select(F.concat_ws("|", F.lit("ALT"), "usubjid", "seq").alias("fingerprint"), "usubjid", "seq")
    now = L.with_ranges(C.overlay(s["lb"], s["corrections"], "LBORRES", "orres", CUT), s["ranges"])
    return S.retracted(form(labs(s)), form(now), C.in_force(s["corrections"], CUT))


@query("s5_doc_hash", f"SELECT 'd' || doc_id AS name, sha256(text) AS sha256, CASE WHEN doc_id % 5 = 0 THEN 'NEW' WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change FROM notes", f"notes AS ({NOTES})")
def s5(s):
    old = s["lb"].sparkSession.table("documents").where("doc_id % 5 <> 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.sha2("text", 256).alias("sha256"))
    return S.document_changes(notes(s).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "text"), old)


TOUCHED = "touched(field, code) AS (VALUES " + ", ".join(f"('{f}', '{c}')" for f, codes in S.DEPENDS.items() for c in codes) + ")"


@query("s6_amendment", "SELECT DISTINCT version, code FROM changed JOIN touched USING (field)", CHANGED, TOUCHED)
def s6(s):
    """The rules that each protocol version touches against the default rules."""
    return S.affected_by(protocol.changes(s["protocols"], RULES), s["protocols"])


@query("s6_amendment_default", "SELECT DISTINCT version, code FROM changed JOIN touched USING (field) WHERE field IN ('visit_window_days', 'hys_days') UNION ALL SELECT version, unnest(['ELIGIBILITY_VIOLATION', 'PROHIBITED_MEDICATION', 'VISIT_WINDOW_DEVIATION']) FROM protocols WHERE visit_window_days = 3 AND hys_days = 14", CHANGED, TOUCHED)
def s6_default(s):
    """With two parameters alone, versions that change neither have the default set."""
    return S.affected_by(protocol.changes(s["protocols"].select("version", "visit_window_days", "hys_days"), RULES), s["protocols"])


@query("s7_human_state", "SELECT fingerprint, min(cut) AS raised, CASE WHEN min(seq) % 3 = 0 AND 6 >= min(cut) + 1 THEN CASE WHEN min(seq) % 2 = 0 THEN 'APPROVED' ELSE 'UNRESOLVED' END WHEN 6 - min(cut) >= 4 THEN 'STANDING_LIMITS' ELSE 'PENDING' END AS state FROM seen GROUP BY 1 HAVING min(cut) <= 6", SAE, SEEN)
def s7(s):
    every = seen(s)
    answers = every.where("seq % 3 = 0").select("fingerprint", F.when(F.col("seq") % 2 == 0, "APPROVED").otherwise("CLARIFY").alias("decision")).distinct()
    return S.human_state(every, answers, CUT)


@query("s8_response_delay", "SELECT fingerprint, CASE WHEN 6 - min(cut) >= 4 THEN 'STANDING_LIMITS' ELSE 'PENDING' END AS state FROM seen GROUP BY 1 HAVING min(cut) <= 6", SAE, SEEN)
def s8(s):
    every = seen(s)
    return S.human_state(every, every.select("fingerprint", F.lit("APPROVED").alias("decision")), CUT, delay=None).drop("raised")


@query("s9_budget_tier", "SELECT cut, ms, spent, CASE WHEN 10 * spent < 6 * total THEN 'FULL' WHEN 10 * spent < 8 * total THEN 'REDUCED' ELSE 'ESSENTIAL' END AS tier FROM (SELECT cut, ms, coalesce(sum(ms) OVER (ORDER BY cut ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent, (SELECT count(*) FROM lb) AS total FROM (SELECT cut_available AS cut, count(*) AS ms FROM lb GROUP BY 1))")
def s9(s):
    """Each cut's tier, a millisecond a result, when the budget is enough for all of them."""
    return S.budget(s["lb"].groupBy(F.col("cut_available").alias("cut")).agg(F.count("*").alias("ms")), float(s["lb"].count()))


# ---- review cycle

PRINTS = "prints AS (SELECT DISTINCT code, usubjid, subcode, domain, seq, concat_ws('|', code, usubjid, domain, coalesce(CAST(seq AS VARCHAR), ''), subcode) AS fingerprint, string_split(usubjid, '-')[2] AS site FROM findings)"
SEVERE = "CASE WHEN code = 'HYS_LAW_CANDIDATE' OR subcode = 'SAE_MISCODED' THEN 'CRITICAL' WHEN code IN ('SERIOUS_AE', 'DOSING_ERROR', 'ELIGIBILITY_VIOLATION') THEN 'HIGH' ELSE 'MEDIUM' END"
REVIEWED = f"""reviewed AS (SELECT p.*, {SEVERE} AS severity, CASE WHEN code = 'DOSING_ERROR' AND site = 'S03' THEN 'CARRIED' WHEN code IN ('VISIT_WINDOW_DEVIATION', 'MISSING_DOSE', 'AE_BEFORE_FIRST_DOSE') THEN 'DATA_QUERY'
  WHEN code = 'HYS_LAW_CANDIDATE' AND usubjid IN (SELECT usubjid FROM std WHERE testcd IN ('ALT', 'AST') AND vcode IN ('SCREENING', 'BASELINE') AND s > 3 * high) THEN 'MONITOR' WHEN code IN ('SERIOUS_AE', 'HYS_LAW_CANDIDATE') THEN 'ESCALATE' ELSE 'DEVIATION' END AS route FROM prints p)"""
REVIEW = (*ALL_FINDINGS, PRINTS, REVIEWED)


def detected(s):
    """The context and all its findings, computed once for a cycle's nodes."""
    ctx = context(s)
    return ctx, keep(P.detect(ctx["findings"]))


def reviewed(s):
    ctx, found = detected(s)
    memory = found.where("code = 'DOSING_ERROR' and site = 'S03'").select("fingerprint")
    return P.medical_review(found, memory, R.raised_baseline(ctx["labs"], RULES))


@query("p1_detect", f"SELECT code, {SEVERE} AS severity, count(*)::BIGINT AS n FROM prints GROUP BY 1, 2", *ALL_FINDINGS, PRINTS)
def p1(s):
    return P.detect(context(s)["findings"]).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("p2_medical_review", "SELECT route, code, count(*)::BIGINT AS n FROM reviewed GROUP BY 1, 2", *REVIEW)
def p2(s):
    return reviewed(s).groupBy("route", "code").agg(F.count("*").alias("n"))


@query("p2_two_cycles", "SELECT usubjid, site, count(*)::BIGINT AS n FROM prints WHERE code IN ('DOSING_ERROR', 'PROHIBITED_MEDICATION') AND usubjid IN (SELECT usubjid FROM prints WHERE code IN ('DOSING_ERROR', 'PROHIBITED_MEDICATION', 'ELIGIBILITY_VIOLATION', 'DUPLICATE_SUBJECT') AND site < 'S10') GROUP BY 1, 2", *ALL_FINDINGS, PRINTS)
def p2_two_cycles(s):
    """Subjects of sites below S10 were flagged in the cycle before."""
    _, found = detected(s)
    return P.recurring(found, P.flagged(found.where("site < 'S10'"), 4), 5)


@query("p3_data_queries", "SELECT fingerprint, CASE WHEN seq % 4 = 0 THEN 'CONFIRMED' ELSE 'PENDING' END AS reply, coalesce(seq % 4 = 0, FALSE) AS exact_hit FROM reviewed WHERE route = 'DATA_QUERY'", *REVIEW)
def p3(s):
    r = reviewed(s)
    replies = r.where("route = 'DATA_QUERY' and seq % 4 = 0").select(F.concat_ws("|", "domain", "usubjid", F.col("seq").cast("string")).alias("key"), F.lit("CONFIRMED").alias("status"))
    return P.data_queries(r, replies).select("fingerprint", "reply", "exact_hit")


@query("p4_compliance", "SELECT site, code, count(*)::BIGINT AS n, count(DISTINCT usubjid)::BIGINT AS n_subjects, code = 'DOSING_ERROR' AND count(DISTINCT usubjid) >= 2 AS site_escalation FROM reviewed WHERE route IN ('DEVIATION', 'CARRIED') AND code IN ('DOSING_ERROR', 'PROHIBITED_MEDICATION', 'ELIGIBILITY_VIOLATION', 'DUPLICATE_SUBJECT') GROUP BY 1, 2", *REVIEW)
def p4(s):
    return P.compliance(reviewed(s))


GATE = "gate AS (SELECT *, CASE WHEN code = 'SERIOUS_AE' AND site = 'S05' THEN 'MONITORING' WHEN code = 'SERIOUS_AE' AND site IN ('S06', 'S07') THEN 'APPROVED' WHEN code = 'HYS_LAW_CANDIDATE' THEN 'PENDING' ELSE 'PENDING' END AS status FROM reviewed WHERE route = 'ESCALATE')"


def gate(s, r):
    told = s["lb"].sparkSession.createDataFrame([("SERIOUS_AE|S05", "REJECTED"), ("SERIOUS_AE|S06", "APPROVED"), ("SAE|S07", "APPROVED")], "key string, decision string")
    return P.human_gate(r, told, {"SERIOUS_AE": "SAE"})


@query("p5_human_gate", "SELECT fingerprint, status, CASE WHEN status = 'APPROVED' THEN 'EXPEDITED_REPORT' ELSE 'NONE' END AS action FROM gate", *REVIEW, GATE)
def p5(s):
    return gate(s, reviewed(s)).select("fingerprint", "status", "action")


@query("p6_execute", "SELECT 'route:' || route AS what, count(*)::BIGINT AS n FROM reviewed GROUP BY 1 UNION ALL SELECT 'status:' || status, count(*) FROM gate GROUP BY 1 UNION ALL SELECT 'severity:' || severity, count(*) FROM reviewed GROUP BY 1", *REVIEW, GATE)
def p6(s):
    r = reviewed(s)
    return P.execute(r, gate(s, r))


CLARIFIED = f"""liver AS (SELECT usubjid, seq, upper(trim(cls)) AS cls, trim(trt) || CASE WHEN trim(cls) <> '' THEN ' (' || upper(trim(cls)) || ')' ELSE '' END AS m,
  {token('cls')} IN ('STATIN', 'SYSTEMIC_GLUCOCORTICOID', 'ANTIFUNGAL', 'ANTITUBERCULAR') OR regexp_matches(upper(trt), 'ATORVASTATIN|SIMVASTATIN|ROSUVASTATIN|PRAVASTATIN|PARACETAMOL|ACETAMINOPHEN|METHOTREXATE|AMIODARONE|KETOCONAZOLE|FLUCONAZOLE|ISONIAZID') AS is_liver FROM cm),
meds AS (SELECT usubjid, count(*) AS n, count(*) FILTER (is_liver) AS nl, list(m ORDER BY seq) FILTER (is_liver) AS l, list(m ORDER BY seq) AS a, list('CM:' || seq ORDER BY seq) FILTER (is_liver) AS refs, min(seq) AS first FROM liver GROUP BY 1),
alts AS (SELECT usubjid, arg_min(row(orres, unit, visit, dtc, seq), seq) AS x FROM std WHERE testcd = 'ALT' AND vcode IN ('SCREENING', 'BASELINE') GROUP BY 1),
asked AS (SELECT usubjid, CASE WHEN c_custkey % 3 = 0 THEN 'What was the screening ALT?' WHEN c_custkey % 3 = 1 THEN 'Any hepatotoxic medication, and the transaminases?' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'Which drugs?' ELSE 'Why?' END END AS question FROM subjects),
clarified AS (SELECT q.usubjid, question, contains(lower(question), 'alt') OR contains(lower(question), 'trans') AS of_alt, contains(lower(question), 'medic') OR contains(lower(question), 'drug') AS of_cm,
  CASE WHEN x IS NULL THEN 'No screening ALT on record' ELSE 'Screening ALT was ' || x[1] || ' ' || x[2] || ' at ' || x[3] || ' on ' || x[4] END AS alt_text,
  CASE WHEN n IS NULL THEN 'No medicines on record' WHEN nl > 0 THEN nl || ' medicine(s) that may harm the liver: ' || array_to_string(l[1:20], ', ') ELSE 'None of ' || n || ' medicine(s) is known to harm the liver: ' || array_to_string(a[1:20], ', ') END AS cm_text,
  CASE WHEN of_alt AND x IS NOT NULL THEN ['LB:' || x[5]] ELSE [] END AS alt_refs, CASE WHEN NOT of_cm THEN [] WHEN nl > 0 THEN refs WHEN len(alt_refs) = 0 AND first IS NOT NULL THEN ['CM:' || first] ELSE [] END AS cm_refs
  FROM asked q LEFT JOIN alts ON alts.usubjid = q.usubjid LEFT JOIN meds ON meds.usubjid = q.usubjid)"""


def questions(s):
    n = F.col("c_custkey")
    text = F.when(n % 3 == 0, "What was the screening ALT?").when(n % 3 == 1, "Any hepatotoxic medication, and the transaminases?").when(n % 2 == 0, "Which drugs?").otherwise("Why?")
    return s["subjects"].select("usubjid", text.alias("question"))


@query("p7_clarify", "SELECT usubjid, question, CASE WHEN of_alt AND of_cm THEN alt_text || '. ' || cm_text || '.' WHEN of_alt THEN alt_text || '.' WHEN of_cm THEN cm_text || '.' END AS answer, array_to_string(list_concat(alt_refs, cm_refs), ',') AS refs FROM clarified", LABS, STD, CLARIFIED)
def p7(s):
    """Questions about all subjects, with answers and the records that they cite."""
    return P.clarify(questions(s), s["lb"], s["cm"]).withColumn("refs", F.array_join("refs", ","))


@query("p5_clarified", """SELECT fingerprint, CASE WHEN site = 'S05' THEN CASE WHEN (of_alt OR of_cm) AND len(alt_refs) + len(cm_refs) > 0 THEN 'APPROVED_AFTER_CLARIFICATION' ELSE 'UNRESOLVED' END ELSE 'PENDING' END AS status,
  CASE WHEN site = 'S05' AND (of_alt OR of_cm) AND len(alt_refs) + len(cm_refs) > 0 THEN 'EXPEDITED_REPORT' ELSE 'NONE' END AS action
  FROM (SELECT 'SERIOUS_AE|' || usubjid || '|AE|' || seq || '|' || subcode AS fingerprint, usubjid, string_split(usubjid, '-')[2] AS site FROM sae) e JOIN clarified c ON c.usubjid = e.usubjid""", LABS, STD, SAE, CLARIFIED)
def p5_clarified(s):
    """A site's serious events sent back for clarification: approved where records answer, else open."""
    found = P.detect(R.run_rule({"ae": s["ae"], "dm": s["dm"]}, "SERIOUS_AE", RULES)).withColumn("route", F.lit("ESCALATE"))
    told = s["lb"].sparkSession.createDataFrame([("SERIOUS_AE|S05", "CLARIFY")], "key string, decision string")
    return P.human_gate(found, told, {}, answers=P.clarify(questions(s), s["lb"], s["cm"])).select("fingerprint", "status", "action")


@query("p8_memory_rerun", "SELECT fingerprint, CASE WHEN code IN ('HYS_LAW_CANDIDATE', 'SERIOUS_AE') AND site < 'S08' THEN CASE WHEN code = 'HYS_LAW_CANDIDATE' THEN 'MONITOR' ELSE 'ESCALATE' END WHEN site < 'S08' THEN CASE WHEN code IN ('VISIT_WINDOW_DEVIATION', 'MISSING_DOSE', 'AE_BEFORE_FIRST_DOSE') THEN 'DATA_QUERY' ELSE 'DEVIATION' END ELSE 'CARRIED' END AS route FROM prints", *ALL_FINDINGS, PRINTS)
def p8(s):
    """The same cut again after sites from S08 on were reviewed, and all Hy's-law findings rejected: what is known is carried, what was rejected is watched."""
    _, found = detected(s)
    none = found.sparkSession.createDataFrame([], "fingerprint string, cut int")
    baseline = s["mh"].where("false")
    memory = P.remember(none, P.medical_review(found.where("site >= 'S08'"), none, baseline), CUT)
    rejected = found.where("code = 'HYS_LAW_CANDIDATE'").select("fingerprint")
    return P.medical_review(found, memory, baseline, rejected).select("fingerprint", "route")


FIRST_SUBJECT = "(SELECT min(usubjid) FROM subjects)"
SECTIONS = {"demographics": "dm", "site": "dm", "person": "persons", "labs": "lb", "vitals": "vs", "ecg": "eg", "exposure": "ex", "adverse_events": "ae", "conmeds": "cm", "medical_history": "mh", "disposition": "ds", "findings": "findings"}


@query("gr5_patient360", " UNION ALL ".join(f"SELECT '{k}' AS section, count(*)::BIGINT AS n FROM {t} WHERE usubjid = {FIRST_SUBJECT}" for k, t in SECTIONS.items()) + f" UNION ALL SELECT 'visits', count(DISTINCT visit) FROM visits WHERE usubjid = {FIRST_SUBJECT} UNION ALL SELECT 'evidence_refs', count(*) FROM (SELECT DISTINCT domain, seq FROM findings WHERE usubjid = {FIRST_SUBJECT})", *ALL_FINDINGS)
def gr5(s):
    parts = G.patient(context(s, shared=False), s["subjects"].agg(F.min("usubjid")).first()[0])
    out = None
    for name in (*SECTIONS, "visits", "evidence_refs"):
        one = parts[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ---- cut by cut


def whole_study(s):
    """The projection as a Study: tables that arrive by cuts, corrections of all domains."""
    from .study import Study

    tables = {name: s[name] for name in ("dm", "lb", "ae", "ex", "cm", "ds", "mh", "vs", "eg")}
    tables["dm"] = tables["dm"].withColumn("seq", F.lit(None).cast("bigint"))
    return Study(tables, s["corrections_all"], s["ranges"], RULES, s["cuts"])


def watched_study(s, state):
    """whole_study for several cuts: results and lines are computed once, and corrections are written, a folder a domain.

    A domain's written corrections have a size that Spark knows before it joins them: where they are few, records stay where they are.
    """
    keep(s["lines"])
    keep(s["lb"])
    study, every = whole_study(s), None
    for domain in CORRECTED:
        path = f"{state}/corrections/{domain}"
        own = study.corrections.where(F.col("domain") == domain.upper()).drop("domain")
        own.write.parquet(path)
        one = own.sparkSession.read.schema(own.schema).parquet(path).withColumn("domain", F.lit(domain.upper()))
        every = one if every is None else every.unionByName(one)
    study.corrections = every
    return study


@query("cut2_all_fields", "SELECT 'AE' AS domain, usubjid, seq, ser || '/' || hosp AS value FROM ae UNION ALL SELECT 'DM', usubjid, NULL, age FROM dm UNION ALL SELECT 'EX', usubjid, seq, dose FROM ex UNION ALL SELECT 'LB', usubjid, seq, orres FROM lb", cut=CUT)
def cut2_all_fields(s):
    """Fields of four domains as corrected at the cut."""
    view = whole_study(s).view(CUT)
    form = lambda d, value: view[d.lower()].select(F.lit(d).alias("domain"), "usubjid", "seq", value.alias("value"))
    return form("AE", F.concat_ws("/", "ser", "hosp")).unionByName(form("DM", F.col("age"))).unionByName(form("EX", F.col("dose"))).unionByName(form("LB", F.col("orres")))


@query("cut8_advance", "SELECT code, usubjid, subcode, domain, seq FROM findings", *ALL_FINDINGS, cut=CUT + 1)
def cut8(s):
    """The findings of a cut from those of the cut before; the SQL derives them whole."""
    state = source.scratch(s["lb"].sparkSession, "advance")
    study = watched_study(s, state)
    study.advance(CUT, state)
    return study.advance(CUT + 1, state)


REPLIES = """replies AS (SELECT fingerprint, usubjid, seq, raised + seq % 4 AS cut, CASE WHEN seq % 5 < 2 THEN 'APPROVED' WHEN seq % 5 = 2 THEN 'REJECTED' ELSE 'CLARIFY' END AS decision FROM (SELECT fingerprint, usubjid, seq, min(cut) AS raised FROM seen GROUP BY 1, 2, 3) WHERE seq % 7 <> 0
  UNION ALL SELECT fingerprint, usubjid, seq, raised + 5, 'REJECTED' FROM (SELECT fingerprint, usubjid, seq, min(cut) AS raised FROM seen GROUP BY 1, 2, 3) WHERE seq % 5 >= 3 OR seq % 14 = 0)"""
#: The state machine as a recursive walk over cuts, one step a cut.
WALK = """answered AS (SELECT DISTINCT fingerprint FROM replies WHERE decision = 'CLARIFY' AND seq % 2 = 0),
raised AS (SELECT fingerprint, min(cut)::BIGINT AS raised FROM seen GROUP BY 1),
told AS (SELECT r.fingerprint, c.cut, (SELECT arg_max(decision, q.cut) FROM replies q WHERE q.fingerprint = r.fingerprint AND q.cut <= c.cut) AS d FROM raised r JOIN (SELECT range AS cut FROM range(1, 13)) c ON c.cut >= r.raised),
walk AS (SELECT r.fingerprint, raised, raised AS cut, 0 AS pending, CASE WHEN d IN ('APPROVED', 'REJECTED') THEN d WHEN d = 'CLARIFY' AND a.fingerprint IS NOT NULL THEN 'APPROVED' WHEN d = 'CLARIFY' THEN 'UNRESOLVED' ELSE 'PENDING' END AS state, d = 'CLARIFY' AND a.fingerprint IS NOT NULL AS clarified
  FROM raised r JOIN told t ON t.fingerprint = r.fingerprint AND t.cut = r.raised LEFT JOIN answered a ON a.fingerprint = r.fingerprint
  UNION ALL SELECT w.fingerprint, w.raised, w.cut + 1, CASE WHEN w.state IN ('APPROVED', 'REJECTED', 'STANDING_LIMITS') OR d IS NOT NULL THEN w.pending ELSE w.pending + 1 END,
  CASE WHEN w.state IN ('APPROVED', 'REJECTED', 'STANDING_LIMITS') THEN w.state WHEN d IN ('APPROVED', 'REJECTED') THEN d WHEN d = 'CLARIFY' AND a.fingerprint IS NOT NULL THEN 'APPROVED' WHEN d = 'CLARIFY' THEN 'UNRESOLVED' WHEN w.pending + 1 >= 4 THEN 'STANDING_LIMITS' ELSE 'PENDING' END,
  CASE WHEN w.state IN ('APPROVED', 'REJECTED', 'STANDING_LIMITS') THEN w.clarified ELSE coalesce(d = 'CLARIFY' AND a.fingerprint IS NOT NULL, false) END
  FROM walk w JOIN told t ON t.fingerprint = w.fingerprint AND t.cut = w.cut + 1 LEFT JOIN answered a ON a.fingerprint = w.fingerprint)"""


def history(s):
    """Serious findings as escalations, each with replies at cuts of its own; every second clarification can be answered."""
    every = seen(s)
    first = every.groupBy("fingerprint", "usubjid", "seq").agg(F.min("cut").alias("raised"))
    kind = F.when(F.col("seq") % 5 < 2, "APPROVED").when(F.col("seq") % 5 == 2, "REJECTED").otherwise("CLARIFY")
    replies = first.where("seq % 7 <> 0").select("fingerprint", "seq", (F.col("raised") + F.col("seq") % 4).alias("cut"), kind.alias("decision"))
    replies = replies.unionByName(first.where("seq % 5 >= 3 or seq % 14 = 0").select("fingerprint", "seq", (F.col("raised") + 5).alias("cut"), F.lit("REJECTED").alias("decision")))
    answered = replies.where("decision = 'CLARIFY' and seq % 2 = 0").select("fingerprint")
    return S.human_history(every, replies.select("fingerprint", "cut", "decision"), answered, 12)


@query("s7_history", "SELECT fingerprint, raised, cut, state, pending::BIGINT AS cuts_pending, coalesce(clarified, false) AS clarified FROM walk", SAE, SEEN, REPLIES, WALK)
def s7_history(s):
    """Every escalation at every cut: replies, answered clarifications, ageing, standing limits."""
    return history(s)


def human_decisions(s):
    h = history(s)
    return DS.events(h, "HUMAN_GATE", h["fingerprint"], h["state"], h["cut"], F.concat(F.lit("pending "), h["cuts_pending"].cast("string")))


@query("s10_history", """SELECT 'HUMAN_GATE|' || fingerprint AS decision_id, cut, old_status, status FROM (SELECT fingerprint, cut, state AS status, lag(state) OVER (PARTITION BY fingerprint ORDER BY cut) AS old_status FROM walk) WHERE old_status IS NULL OR old_status <> status""", SAE, SEEN, REPLIES, WALK)
def s10_history(s):
    """Decisions' transitions: of the states that every cut reports, those that differ from the one before."""
    return DS.transitions(human_decisions(s)).select("decision_id", "cut", "old_status", "status")


@query("s10_state", """SELECT 'HUMAN_GATE|' || fingerprint AS decision_id, min(cut) AS first_cut, max(cut) FILTER (old_status IS NULL OR old_status <> status) AS cut, arg_max(status, cut) AS status, count(*) FILTER (old_status IS NULL OR old_status <> status) AS n_transitions
  FROM (SELECT fingerprint, cut, state AS status, lag(state) OVER (PARTITION BY fingerprint ORDER BY cut) AS old_status FROM walk WHERE cut <= 8) GROUP BY 1""", SAE, SEEN, REPLIES, WALK)
def s10_state(s):
    """Decisions as of a cut."""
    return DS.state_as_of(human_decisions(s), 8).select("decision_id", "first_cut", "cut", "status", "n_transitions")


@query("s10_deviations", "SELECT 'FINDING|' || fingerprint AS decision_id, 'AE:' || max(seq) AS extra FROM seen WHERE seq % 4 = 0 GROUP BY fingerprint", SAE, SEEN)
def s10_deviations(s):
    """Explanations that cite a record which the decision's trace doesn't."""
    every = seen(s).groupBy("fingerprint").agg(F.max("seq").alias("seq"), F.min("cut").alias("cut"))
    ref = F.concat(F.lit("AE:"), F.col("seq").cast("string"))
    traced = DS.events(every, "FINDING", F.col("fingerprint"), F.lit("CONFIRMED"), F.col("cut"), F.lit("found"), F.when(F.col("seq") % 4 == 0, F.array(F.lit("AE:0"))).otherwise(F.array(ref)))
    explained = every.select(F.concat(F.lit("FINDING|"), "fingerprint").alias("decision_id"), F.array(ref).alias("refs"))
    return DS.deviations(explained, traced).select("decision_id", F.array_join("extra", ",").alias("extra"))


@query("ag11_period", """SELECT cut, version, findings, serious, queries, (sum(findings) OVER w)::BIGINT AS findings_so_far, (sum(serious) OVER w)::BIGINT AS serious_so_far, (sum(queries) OVER w)::BIGINT AS queries_so_far,
  CASE WHEN lag(version) OVER w <> version THEN lag(version) OVER w END AS from_version, CASE WHEN lag(version) OVER w <> version THEN version END AS to_version
  FROM (SELECT cut, (SELECT arg_max(c.version, c.cut) FROM cuts c WHERE c.cut <= x.cut) AS version, count(*) AS findings, count(*) FILTER (fingerprint LIKE 'SAE_MISCODED%') AS serious, count(*) FILTER (seq % 3 = 0) AS queries FROM seen x GROUP BY 1) WINDOW w AS (ORDER BY cut)""", SAE, SEEN)
def ag11_period(s):
    """A period's roll-up; cut 5 was run twice, first with other counts."""
    every = seen(s)
    sums = every.groupBy("cut").agg(F.count("*").alias("findings"), F.count_if(F.col("fingerprint").startswith("SAE_MISCODED")).alias("serious"), F.count_if(F.col("seq") % 3 == 0).alias("queries"))
    sums = C.version_as_of(sums.withColumn("at", F.col("cut")), s["cuts"]).drop("at").withColumn("run", F.lit(2))
    again = sums.where("cut = 5").withColumn("findings", F.col("findings") + 100).withColumn("run", F.lit(1))
    return S.period(sums.unionByName(again))


ROUTED = f"""routed AS (SELECT p.*, CASE WHEN code IN ('VISIT_WINDOW_DEVIATION', 'MISSING_DOSE', 'AE_BEFORE_FIRST_DOSE') THEN 'DATA_QUERY'
  WHEN code = 'HYS_LAW_CANDIDATE' AND usubjid IN (SELECT usubjid FROM std WHERE testcd IN ('ALT', 'AST') AND vcode IN ('SCREENING', 'BASELINE') AND s > 3 * high) THEN 'MONITOR' WHEN code IN ('SERIOUS_AE', 'HYS_LAW_CANDIDATE') THEN 'ESCALATE' ELSE 'DEVIATION' END AS route FROM prints p)"""


@query("s1_surveillance", f"""SELECT 'new_records' AS what, ((SELECT count(*) FROM lb_all WHERE cut_available = {CUT}) + (SELECT count(*) FROM ae_all WHERE cut_available = {CUT}) + (SELECT count(*) FROM dm_all WHERE cut_available = {CUT}) + (SELECT count(*) FROM vs_all WHERE cut_available = {CUT}) + (SELECT count(*) FROM eg_all WHERE cut_available = {CUT}))::BIGINT AS n
  UNION ALL SELECT 'corrections', count(*) FROM corrections_all WHERE cut = {CUT} UNION ALL SELECT 'findings', count(*) FROM prints UNION ALL SELECT 'serious', count(*) FROM prints WHERE code IN ('SERIOUS_AE', 'HYS_LAW_CANDIDATE')
  UNION ALL SELECT 'escalations', count(*) FROM routed WHERE route = 'ESCALATE' UNION ALL SELECT 'carried', 0 UNION ALL SELECT 'retracted', 0
  UNION ALL SELECT 'serious_unescalated', count(*) FROM routed WHERE code IN ('SERIOUS_AE', 'HYS_LAW_CANDIDATE') AND route <> 'ESCALATE'
  UNION ALL SELECT CASE WHEN code <> 'SERIOUS_AE' OR seq % 3 = 2 THEN 'human:PENDING' WHEN seq % 3 = 0 THEN 'human:APPROVED' WHEN seq % 3 = 1 AND len(alt_refs) + len(cm_refs) > 0 THEN 'human:APPROVED' ELSE 'human:UNRESOLVED' END, count(*) FROM routed r LEFT JOIN clarified c ON c.usubjid = r.usubjid WHERE route = 'ESCALATE' GROUP BY 1
  UNION ALL SELECT 'version', (SELECT arg_max(version, cut) FROM cuts WHERE cut <= {CUT})
  UNION ALL SELECT 'data_queries', count(*) FROM routed WHERE route = 'DATA_QUERY'""", *ALL_FINDINGS, PRINTS, ROUTED, CLARIFIED, cut=CUT)
def s1(s):
    """A cut's thirteen steps, its figures at the end."""
    from .surveillance import Surveillance

    spark = s["lb"].sparkSession
    state = source.scratch(spark, "watch")
    study = watched_study(s, state)
    codes = F.explode(F.array(F.lit("SAE_CODED"), F.lit("SAE_MISCODED")))
    replies = s["ae"].withColumn("_c", codes).where("seq % 3 < 2").select(F.concat_ws("|", F.lit("SERIOUS_AE"), "usubjid", F.lit("AE"), F.col("seq").cast("string"), "_c").alias("fingerprint"), F.lit(CUT).cast("bigint").alias("cut"), F.when(F.col("seq") % 3 == 0, "APPROVED").otherwise("CLARIFY").alias("decision"))
    watch = Surveillance(study, state, replies, questions(s))
    out = watch.run_cut(CUT).where("what not in ('untrusted', 'quarantined_sites', 'quarantined', 'queries')")
    asked = watch.written("queries", CUT).where("not key like 'LAB_SHIFT%'").agg(F.count("*").alias("n")).select(F.lit("data_queries").alias("what"), "n")
    return out.unionByName(asked)


PERSON = "SELECT count(DISTINCT p.person_id) FROM dm d JOIN persons p ON p.usubjid = d.usubjid WHERE"
AGE = "try_cast(d.age AS DOUBLE)"
#: Questions and the SQL of what they ask.
ASKED = (
    ("How many subjects are in the study?", f"{PERSON} true"),
    ("How many subjects under 18?", f"{PERSON} {AGE} < 18"),
    ("How many women at site 3 are aged 30 to 60?", f"{PERSON} sex = 'F' AND siteid = 'S03' AND {AGE} BETWEEN 30 AND 60"),
    ("How many patients older than 65 are in the placebo arm?", f"{PERSON} {AGE} > 65 AND arm = 'PLACEBO'"),
    ("How many subjects withdrew?", f"{PERSON} d.usubjid IN (SELECT usubjid FROM ds WHERE decod = 'DISCONTINUED' AND term LIKE '%WITHDRAW%')"),
    ("How many patients were discontinued due to an adverse event at site 7?", f"{PERSON} siteid = 'S07' AND d.usubjid IN (SELECT usubjid FROM ds WHERE decod = 'DISCONTINUED' AND term = 'ADVERSE EVENT')"),
    ("How many subjects completed the study?", f"{PERSON} d.usubjid IN (SELECT usubjid FROM ds WHERE decod = 'COMPLETED')"),
    ("How many subjects are taking sulfonylurea?", f"{PERSON} d.usubjid IN (SELECT usubjid FROM cm WHERE cls = 'SULFONYLUREA')"),
    ("How many subjects in the drug arm had severe adverse events?", f"{PERSON} arm = 'DRUG' AND d.usubjid IN (SELECT usubjid FROM ae WHERE sev = 'SEVERE')"),
    ("How many subjects have a systolic result at week 8?", f"{PERSON} d.usubjid IN (SELECT usubjid FROM vs WHERE testcd = 'SYSBP' AND {visit('visit')} = 'WEEK8')"),
    ("How many subjects at site 10 had miscoded serious adverse events?", f"{PERSON} siteid = 'S10' AND d.usubjid IN (SELECT usubjid FROM sae WHERE subcode = 'SAE_MISCODED')"),
    ("How many serious adverse events were reported?", "SELECT count(*) FROM sae"),
    ("How many ALT results are recorded at week 2 at site S05?", f"SELECT count(*) FROM lb WHERE testcd = 'ALT' AND site = 'S05' AND {visit('visit')} = 'WEEK2' AND usubjid IN (SELECT usubjid FROM dm)"),
    ("How many lab results between 2024-01-05 and 31-JAN-2024?", f"SELECT count(*) FROM lb WHERE {day('dtc')} BETWEEN DATE '2024-01-05' AND DATE '2024-01-31'"),
    ("How many left-handed subjects discontinued?", "SELECT NULL"),
    ("How many subjects had a hepatotoxicity event?", f"{PERSON} d.usubjid IN (SELECT usubjid FROM ae WHERE term = 'Hepatotoxicity')"),
)


@query("q1_questions", " UNION ALL ".join(f"SELECT '{q}' AS question, {'true' if 'NULL' in sql else 'false'} AS ambiguous, CAST(({sql}) AS BIGINT) AS n" for q, sql in ASKED), SAE, PERSONS)
def q1(s):
    """What questions count; one that isn't understood has no number."""
    from . import router

    ctx = s | {"labs": s["lb"], "persons": I.persons(s["dm"]), "visits": G.visits_of({"LB": (s["lb"], "dtc"), "VS": (s["vs"], "dtc"), "EG": (s["eg"], "dtc"), "EX": (s["ex"], "stdtc")}), "rules": RULES, "findings": R.run_rule(s, "SERIOUS_AE", RULES)}
    ctx["domains"] = {d: s[d.lower()] for d in ("LB", "AE", "EX", "CM", "DS", "VS", "EG", "MH", "DM")}
    out, words = None, router.vocabulary(ctx)
    for question, _ in ASKED:
        intent = router.with_terms(ctx, router.classify(question, words))
        if router.unused(intent):
            one = s["lb"].sparkSession.createDataFrame([(None,)], "n bigint")
        else:
            one = router.count_plan(ctx, intent).select(F.col("n_records" if intent.records else "n_persons").alias("n"))
        one = one.select(F.lit(question).alias("question"), F.lit(bool(router.unused(intent))).alias("ambiguous"), "n")
        out = one if out is None else out.unionByName(one)
    return out


#: The sections of the projection's documents, written out from how they are made.
MADE = """made AS (SELECT CAST(replace(name, 'protocol_', '') AS BIGINT) AS k, name FROM protocol_docs),
parts AS (
  SELECT name, 'p1' AS section, '' AS title, 2 AS n_lines, 'First paragraph.' || chr(10) || 'Its second line.' AS text FROM made WHERE k % 9 = 0 UNION ALL SELECT name, 'p2', '', 1, 'Another, window of 4 days.' FROM made WHERE k % 9 = 0
  UNION ALL SELECT name, '1', 'Eligibility', CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN k % 2 = 0 THEN '- Age ' || (16 + k % 7) || ' years or more' ELSE '' END FROM made WHERE k % 9 <> 0
  UNION ALL SELECT name, '2', 'Visits', 1, CASE WHEN k % 5 <> 0 THEN 'Visit window: plus or minus ' || (2 + k % 4) || ' days.' ELSE 'As planned.' END FROM made WHERE k % 9 <> 0
  UNION ALL SELECT name, 'prohibited-medication', 'Prohibited medication', 1, '- ' || CASE WHEN k % 3 = 0 THEN 'Sulfonylurea' ELSE 'Systemic Glucocorticoid' END FROM made WHERE k % 9 <> 0
  UNION ALL SELECT name, 'notes', 'Notes', 1, 'None.' FROM made WHERE k % 9 <> 0 UNION ALL SELECT name, 'notes-2', 'Notes', 1, 'Bilirubin > 2 x ULN within ' || (7 + k % 9) || ' days.' FROM made WHERE k % 9 <> 0),
refs AS (
  SELECT name, 'ELIGIBILITY_VIOLATION' AS code, 'age_min' AS parameter, CAST(16 + k % 7 AS VARCHAR) AS value, '1' AS section FROM made WHERE k % 9 <> 0 AND k % 2 = 0
  UNION ALL SELECT name, 'VISIT_WINDOW_DEVIATION', 'visit_window_days', CASE WHEN k % 9 = 0 THEN '4' ELSE CAST(2 + k % 4 AS VARCHAR) END, CASE WHEN k % 9 = 0 THEN 'p2' ELSE '2' END FROM made WHERE k % 9 = 0 OR k % 5 <> 0
  UNION ALL SELECT name, 'PROHIBITED_MEDICATION', 'prohibited', CASE WHEN k % 3 = 0 THEN 'Sulfonylurea' ELSE 'Systemic Glucocorticoid' END, 'prohibited-medication' FROM made WHERE k % 9 <> 0
  UNION ALL SELECT name, 'HYS_LAW_CANDIDATE', 'hys_days', CAST(7 + k % 9 AS VARCHAR), 'notes-2' FROM made WHERE k % 9 <> 0)"""


@query("fn19_sections", "SELECT name, section, title, n_lines::BIGINT AS n_lines, text FROM parts", MADE)
def fn19(s):
    """The sections of all protocol documents at once."""
    return protocol.section_table(s["protocol_docs"])


@query("fn21_references", "SELECT name, code, parameter, value, section FROM refs", MADE)
def fn21(s):
    """Which section states which rule's parameter."""
    return protocol.document_references(s["protocol_docs"])


@query("ev1_finding_refs", "SELECT h.usubjid, h.seq, h.name || '#' || r.section AS doc_ref FROM (SELECT h.usubjid, h.seq, 'protocol_' || l.row_no AS name FROM hits h JOIN (SELECT usubjid, max(row_no) AS row_no FROM ds GROUP BY 1) l ON l.usubjid = h.usubjid WHERE matched IS NOT NULL) h LEFT JOIN refs r ON r.name = h.name AND r.code = 'PROHIBITED_MEDICATION'", PROHIBITED, MADE)
def ev1_finding_refs(s):
    """Findings with the section that states their rule, in the document of the subject's last order."""
    found = R.run_rule(s, "PROHIBITED_MEDICATION", RULES).join(s["ds"].groupBy("usubjid").agg(F.max("row_no").alias("_o")), "usubjid")
    refs = protocol.document_references(s["protocol_docs"], ("PROHIBITED_MEDICATION",))
    return protocol.with_references(found, refs, F.concat(F.lit("protocol_"), F.col("_o").cast("string"))).select("usubjid", "seq", "doc_ref")


@query("gr5_many", """SELECT d.usubjid, true AS found, (SELECT string_agg(a.seq || ':' || a.term || '/' || a.sev, ';' ORDER BY a.seq) FROM ae a WHERE a.usubjid = d.usubjid) AS adverse_events, (SELECT string_agg(c.seq || ':' || c.trt, ';' ORDER BY c.seq) FROM cm c WHERE c.usubjid = d.usubjid) AS conmeds,
  (SELECT string_agg(l.seq || ':' || l.orres, ';' ORDER BY l.seq) FROM lb l WHERE l.usubjid = d.usubjid) AS labs, (SELECT string_agg(x.v, ';' ORDER BY x.v) FROM (SELECT DISTINCT v.visit AS v FROM visits v WHERE v.usubjid = d.usubjid) x) AS visits, (SELECT string_agg(s.seq || ':' || s.subcode, ';' ORDER BY s.seq) FROM sae s WHERE s.usubjid = d.usubjid) AS findings
  FROM dm d UNION ALL SELECT '999-S99-999', false, NULL, NULL, NULL, NULL, NULL""", VISITS, SAE)
def gr5_many(s):
    """Sections of all subjects, and of one that nobody knows, by their contents."""
    keep(s["lines"])  # exposure and medicines
    ctx = s | {"persons": I.persons(s["dm"]), "visits": G.visits_of({"LB": (s["lb"], "dtc"), "VS": (s["vs"], "dtc"), "EG": (s["eg"], "dtc"), "EX": (s["ex"], "stdtc")}), "findings": R.run_rule(s, "SERIOUS_AE", RULES)}
    asked = s["dm"].select("usubjid").unionByName(s["lb"].sparkSession.createDataFrame([("999-S99-999",)], "usubjid string"))
    out = G.patients(ctx, asked)
    field = lambda x, name: F.get_json_object(x["record"], f"$.{name}")
    told = lambda section, *names: F.nullif(F.array_join(F.transform(f"sections.{section}", lambda x: F.concat(x["seq"].cast("string"), F.lit(":"), F.concat_ws("/", *[field(x, n) for n in names]))), ";"), F.lit(""))
    visits = F.nullif(F.array_join(F.sort_array(F.transform("sections.visits", lambda x: field(x, "visit"))), ";"), F.lit(""))
    return out.select("usubjid", "found", told("adverse_events", "term", "sev").alias("adverse_events"), told("conmeds", "trt").alias("conmeds"), told("labs", "orres").alias("labs"), visits.alias("visits"), told("findings", "subcode").alias("findings"))


@query("cut7_all", f"""SELECT coalesce(a.domain, c.domain) AS domain, coalesce(a.site, c.site) AS site, coalesce(n_new, 0)::BIGINT AS n_new, coalesce(is_new_site, false) AS is_new_site, coalesce(n_corrections, 0)::BIGINT AS n_corrections
  FROM (SELECT domain, site, count(*) FILTER (cut_available = {CUT}) AS n_new, min(cut_available) = {CUT} AS is_new_site FROM (SELECT 'LB' AS domain, site, cut_available FROM lb UNION ALL SELECT 'AE', site, cut_available FROM ae UNION ALL SELECT 'VS', site, cut_available FROM vs UNION ALL SELECT 'EG', site, cut_available FROM eg UNION ALL SELECT 'DM', siteid, cut_available FROM dm) GROUP BY 1, 2 HAVING count(*) FILTER (cut_available = {CUT}) > 0) a
  FULL JOIN (SELECT domain, string_split(usubjid, '-')[2] AS site, count(*) AS n_corrections FROM corrections_all WHERE cut = {CUT} GROUP BY 1, 2) c ON c.domain = a.domain AND c.site = a.site""")
def cut7_all(s):
    """What a cut brings to every domain and site, corrections too."""
    return C.delta_all({d: s[d.lower()] for d in ("LB", "AE", "VS", "EG", "DM", "EX", "CM")}, s["corrections_all"], CUT)


@query("flt1_undated", f"SELECT domain, usubjid, count(*) FILTER (date BETWEEN DATE '2024-01-05' AND DATE '2024-12-31')::BIGINT AS n_in, count(*) FILTER (date IS NULL)::BIGINT AS n_undated FROM (SELECT 'AE' AS domain, usubjid, {day('stdtc')} AS date FROM ae UNION ALL SELECT 'LB', usubjid, {day('dtc')} FROM lb UNION ALL SELECT 'MH', usubjid, NULL FROM mh) GROUP BY 1, 2")
def flt1_undated(s):
    """Records in a window, and those that have no date to place them by."""
    records = K.long_records({"AE": (s["ae"], "stdtc"), "LB": (s["lb"], "dtc"), "MH": (s["mh"], None)})
    return K.window_counts(records, F.lit("2024-01-05").cast("date"), F.lit("2024-12-31").cast("date"))


@query("flt2_any_domain", f"""SELECT a.usubjid, a.seq, a.date FROM (SELECT usubjid, seq, {day('stdtc')} AS date FROM ae) a
  JOIN (SELECT d.usubjid, coalesce(e.d, CAST({day('d.rfstdtc')} + 56 AS DATE)) AS anchor FROM dm d LEFT JOIN (SELECT usubjid, min(d) AS d FROM visits WHERE visit = 'WEEK8' GROUP BY 1) e ON e.usubjid = d.usubjid) v ON v.usubjid = a.usubjid AND abs(date_diff('day', a.date, v.anchor)) <= 30""", VISITS)
def flt2_any_domain(s):
    """Adverse events around a visit: its earliest record of any domain, else its scheduled day."""
    seen_ = G.visits_of({"LB": (s["lb"], "dtc"), "VS": (s["vs"], "dtc"), "EG": (s["eg"], "dtc"), "EX": (s["ex"], "stdtc")})
    anchors = K.visit_anchors(seen_, s["dm"], "WEEK8", RULES.visit_schedule["WEEK8"])
    return K.anchored(K.long_records({"AE": (s["ae"], "stdtc")}), anchors, 30).select("usubjid", "seq", "date")


@query("fn10_learned", """SELECT name, unnest([lower('ukat/L'), lower('g/L')]) AS "from", unnest([CAST(1 + k % 90 AS DOUBLE), (k % 7) + 0.5]) AS factor, unnest([lower('U/L'), lower('mg/dL')]) AS "to" FROM (SELECT 'm' || row_no AS name, row_no AS k FROM ds WHERE row_no % 4 <> 0)
  UNION ALL SELECT 'm' || row_no, 'mmol/l', 2.0, '%' FROM ds WHERE row_no % 4 = 0""")
def fn10(s):
    """What manuals' sentences say about units."""
    n = F.col("row_no")
    text = F.when(n % 4 != 0, F.concat(F.lit("Manual 1. Note: 1 ukat/L = "), (1 + n % 90).cast("string"), F.lit(" U/L; also 1g/L is equal to "), (n % 7).cast("string"), F.lit(",5 mg/dL.\nOf 1 sample in 3 nothing is known. 2 mg = 3 ml. 1 U/L = 1 U/L.")))
    text = text.otherwise("Then 1 mmol/L equals 2% (about), but 1 mg/dL is not 3 mmol/L.")
    told = s["ds"].select(F.concat(F.lit("m"), n.cast("string")).alias("name"), F.explode(L.learn(text)).alias("l"))
    return told.select("name", "l.*")


@query("ag13_all_sites", "SELECT a.site, (SELECT count(DISTINCT usubjid) FROM lb WHERE lb.site = a.site)::BIGINT AS n_subjects, count(*)::BIGINT AS n, round(stddev_samp(a.v) / avg(a.v), 4) AS cv_site, round((SELECT stddev_samp(b.v) / avg(b.v) FROM plain b WHERE b.testcd = 'GLUC' AND b.site <> a.site), 4) AS cv_other FROM plain a WHERE testcd = 'GLUC' GROUP BY a.site HAVING count(*) > 1", PLAIN)
def ag13_all_sites(s):
    """Glucose at every site against all others."""
    return D.site_variation(s["lb"], "GLUC").select("site", "n_subjects", "n", F.round("cv_site", 4).alias("cv_site"), F.round("cv_other", 4).alias("cv_other"))


@query("s5_instructions", f"SELECT n.name, c.change, coalesce(i.n, 0)::BIGINT AS n_instructions, coalesce(i.said, '') AS instructions FROM (SELECT 'd' || doc_id AS name, doc_id FROM notes) n JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'NEW' WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change FROM notes) c ON c.doc_id = n.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(sentence))), '|') AS said FROM cut WHERE concat_ws('; ', {HITS}) <> '' GROUP BY 1) i ON i.doc_id = n.doc_id", SENTENCES)
def s5_instructions(s):
    """Changed documents with the sentences in them that address automated readers."""
    named = notes(s).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "text")
    old = s["lb"].sparkSession.table("documents").where("doc_id % 5 <> 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.sha2("text", 256).alias("sha256"))
    return S.document_instructions(named, old).select("name", "change", "n_instructions", F.array_join("instructions", "|").alias("instructions"))


@query("rl8_confidence", "SELECT usubjid, subcode, domain, seq, CASE subcode WHEN 'PREGNANCY' THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence FROM eligible", LABS, STD, ELIGIBLE)
def rl8_confidence(s):
    return R.eligibility(s["dm"], labs(s), s["mh"], s["ae"], RULES).withColumn("confidence", R.eligibility_confidence(F.col("subcode")))


@query("fn5_rows", "SELECT usubjid, seq, CASE WHEN upper(trim(orres)) IN ('', 'NA', 'N/A', 'NULL', 'NONE', '.') THEN NULL ELSE trim(orres) END AS orres, trim(visit) AS visit, CASE WHEN row_no % 3 = 0 THEN NULL ELSE unit END AS unit FROM lb")
def fn5_rows(s):
    """Whole rows cleaned."""
    messy = s["lb"].select("usubjid", "seq", F.concat(F.lit(" "), "orres", F.lit("\t")).alias("orres"), F.concat("visit", F.lit("  ")).alias("visit"), F.when(F.col("row_no") % 3 == 0, " n/a ").otherwise(F.col("unit")).alias("unit"))
    return N.normalise_row(messy)


@query("flt6_central", "SELECT l.usubjid, l.seq, c.unit AS central_unit, round(CASE WHEN kind <> 'numeric' THEN NULL WHEN l.unit = c.unit THEN value WHEN l.unit = 'ukat/L' AND c.unit = 'U/L' THEN 60 * value END, 4) AS central_value, CASE WHEN kind <> 'numeric' OR c.unit IS NULL THEN NULL WHEN CASE WHEN l.unit = c.unit THEN value ELSE 60 * value END > c.high THEN 'HIGH' WHEN CASE WHEN l.unit = c.unit THEN value ELSE 60 * value END < c.low THEN 'LOW' ELSE 'NORMAL' END AS central_flag FROM labs l LEFT JOIN (SELECT testcd, unit, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM ranges WHERE lab = 'CENTRAL') c ON c.testcd = l.testcd", LABS)
def flt6_central(s):
    """Every result in the central laboratory's unit and against its range."""
    return L.central(labs(s), s["ranges"]).select("usubjid", "seq", "central_unit", F.round("central_value", 4).alias("central_value"), "central_flag")


@query("src7_kinds", "SELECT name, CASE WHEN k % 4 = 0 THEN 'protocol' WHEN k % 4 = 1 THEN 'lab_manual' WHEN k % 4 = 2 THEN 'sap' ELSE 'other' END AS kind FROM (SELECT 'document ' || row_no AS name, row_no AS k FROM ds)")
def src7(s):
    """Kinds of documents whose names say nothing, by their first lines."""
    k = F.col("row_no") % 4
    head = F.when(k == 0, "# STUDY: Clinical Study Protocol\nText.").when(k == 1, "Central Laboratory Manual\n1 U").when(k == 2, "## Statistical Analysis Plan\nThe protocol says").otherwise("A letter\nabout the protocol and the laboratory manual")
    named = s["ds"].select(F.concat(F.lit("document "), F.col("row_no").cast("string")).alias("name"), head.alias("text"))
    return named.select("name", source.document_kind(F.col("name"), F.col("text")).alias("kind"))
