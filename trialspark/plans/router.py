"""English questions to plans: the text fills slots on the driver, the slots make a lazy DataFrame, and one action answers.

Each slot takes its words out of the question. Words that no slot took, and slots that the asked plan can't use, make the
answer ambiguous: a condition is never left out. What may be named (sites, tests, arms, countries, dispositions) comes
from the study's data. Text is data: a question or a document that gives orders changes no filter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import labs as L
from ..operators import lookups as K
from ..operators import rules as R
from . import protocol

#: Which words ask for which finding and subcode, the more particular first.
FINDINGS = (
    ("SERIOUS_AE", "SAE_MISCODED", r"mis-?coded (?:serious )?(?:adverse )?events?|mis-?coded|coded (?:as )?(?:not |non-)serious"), ("MISSING_DOSE", "NO_EXPOSURE", r"never (?:been )?dosed|no exposure|without (?:any )?(?:exposure|doses?)|undosed"),
    ("HYS_LAW_CANDIDATE", None, r"hy'?s[ -]law(?: criteria| candidates?| cases?)?|(?:drug[ -]induced )?liver (?:injury|signals?|damage)(?: signals?)?"), ("AE_BEFORE_FIRST_DOSE", None, r"(?:adverse )?events? (?:from )?before (?:the |their )?(?:first )?dos(?:e|ing)|before (?:the |their )?first dose|pre-?dose(?: adverse)? events?"),
    ("MISSING_DOSE", None, r"(?:missed|missing|skipped)(?: an?| any| their)? (?:dose|dosing)s?|dos(?:e|ing) gaps?"), ("DOSING_ERROR", None, r"dosing errors?|(?:the |an? )?(?:wrong|incorrect) doses?|(?:mis|over|under)-?dosed|overdos(?:e|es|ing)"),
    ("VISIT_WINDOW_DEVIATION", None, r"(?:visits? )?(?:out ?(?:of|side)|outside)(?: of)? (?:the |their )?(?:visit )?windows?(?: visits?)?|visit[ -]windows?(?: deviations?)?|(?:late|early) visits?|window deviations?"),
    ("PROHIBITED_MEDICATION", None, r"(?:prohibited|forbidden|banned|disallowed)(?: concomitant)? (?:medications?|medicines?|drugs?)"), ("ELIGIBILITY_VIOLATION", None, r"eligibility(?: violations?| criteria)?|ineligible|(?:inclusion|exclusion) criteri(?:a|on)(?: violations?)?"),
    ("DUPLICATE_SUBJECT", None, r"duplicates?(?: subjects?| persons?)?|enrolled twice|double enrol(?:l)?ments?"), ("SERIOUS_AE", None, r"serious (?:adverse )?events?|\bsaes?\b|hospitali[sz]ed"),
)
#: Words for the domains; more than one may be named.
DOMAINS = (
    ("AE", r"adverse[ -]events?|\baes?\b|side effects?"), ("LB", r"lab(?:oratory)?(?:[ -](?:results?|values?|tests?))?\b|\blabs\b"), ("EX", r"exposures?|dosing|\bdoses?\b"), ("CM", r"con(?:comitant )?med(?:ication|icine)?s?\b|medications?|medicines?"), ("DS", r"dispositions?"),
    ("MH", r"(?:medical )?histor(?:y|ies)"), ("DM", r"demographics?"), ("VS", r"vital(?:s| signs?)\b|blood pressures?"), ("EG", r"\becgs?\b|electrocardiograms?"),
)
#: Spoken names of tests; the codes that the data have are names of themselves.
TEST_NAMES = {"alanine aminotransferase": "ALT", "aspartate aminotransferase": "AST", "bilirubin": "BILI", "creatinine": "CREAT", "glucose": "GLUC", "systolic": "SYSBP", "diastolic": "DIABP", "qtc": "QTCF"}
#: How a disposition is said, with the reason that the words imply.
STATUSES = (
    (r"withdrew(?: consent)?|withdrawn|withdrawals?", "DISCONTINUED", "WITHDRAW"), (r"lost to follow-?\s?up", "DISCONTINUED", "LOST TO FOLLOW-UP"), (r"discontinu(?:ed|ing|ation|e)|dropped out|drop-?outs?|stopped early|terminated early|left the study", "DISCONTINUED", None),
    (r"completed(?: the study)?|completers?|finished", "COMPLETED", None), (r"ongoing|still on (?:the )?study|continuing", "ONGOING", None),
)
REASON_NAMES = {"an ae": "ADVERSE EVENT", "aes": "ADVERSE EVENT", "an adverse event": "ADVERSE EVENT", "adverse events": "ADVERSE EVENT", "adverse event": "ADVERSE EVENT", "withdrawal by subject": "WITHDRAWAL BY SUBJECT", "withdrawal": "WITHDRAW", "withdrawing consent": "WITHDRAW", "lost to follow-up": "LOST TO FOLLOW-UP", "lost to follow up": "LOST TO FOLLOW-UP"}
#: Words that carry no condition.
PLAIN = frozenset("""a an and any are as at be been belonging by can check could did do does each enrolled ever every find for from gave get give given got had has have having him her his i in included into is it its list listed me met meet
    meeting meets my of on or our out please potential receive received receiving recorded reported see seen show shows shown some study tell that the their them there these they this those to took taken taking trial under up us was we were what
    when where which who whom whose with would you your people subject subjects patient patients participant participants person persons individual individuals record records result results value values event events visit visits case cases all data
    total number count counts many how much measured measurements tests test criteria arm group site sites age aged years year old display fetch retrieve also both experienced experiencing suffered occurred occurring happened signal signals""".split())
SUBJECT = re.compile(r"\b[0-9]{3}-S[0-9]{2}-[0-9]{3,}\b", re.I)
DAY = r"(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[ -][a-z]{3,9}[ -]\d{4})"
CONFIDENT = 0.6


@dataclass
class Intent:
    kind: str = "unknown"
    subject: str | None = None
    site: str | None = None
    visit: str | None = None
    days: int | None = None
    test: str | None = None
    domains: list[str] = field(default_factory=list)
    finding: str | None = None
    subcode: str | None = None
    records: bool = False  # a count of records, not of subjects
    dates: tuple[str | None, str | None] | None = None
    filters: dict = field(default_factory=dict)
    left: list[str] = field(default_factory=list)  # words that no slot took
    confidence: float = 0.3


@dataclass
class Answer:
    kind: str
    status: str
    value: object = None
    refs: list = field(default_factory=list)
    confidence: float = 0.0
    shortened: bool = False  # refs are the first ones only; value is of all


@dataclass
class Vocabulary:
    """What a question about a study may name."""

    subjects: re.Pattern = SUBJECT
    sites: tuple[str, ...] = ()
    tests: tuple[str, ...] = ("ALT", "AST", "BILI", "GLUC", "CREAT", "HBA1C")
    visits: tuple[str, ...] = ()
    arms: tuple[str, ...] = ("PLACEBO", "DRUG")
    countries: tuple[str, ...] = ()
    reasons: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()


def subject_pattern(sample: str | None) -> re.Pattern:
    """The shape of ids like this one: runs of digits and of letters as long as its own, other characters as they are."""
    if not sample:
        return SUBJECT
    shape = "".join((f"[0-9]{{{len(run)}}}" if run[0].isdigit() else f"[A-Za-z]{{{len(run)}}}") if run[0].isalnum() else re.escape(run) for run in re.findall(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]+", sample))
    return re.compile(rf"\b(?:{shape}|{SUBJECT.pattern[2:-2]})\b", re.I)


def vocabulary(ctx: dict) -> Vocabulary:
    """Read once a context: the distinct values of coded columns, which a study's design bounds."""
    if "vocabulary" not in ctx:
        told = None
        for kind, table, column in (("sites", "dm", "siteid"), ("arms", "dm", "arm"), ("countries", "dm", "country"), ("reasons", "ds", "term"), ("classes", "cm", "cls"), ("tests", "lb", "testcd"), ("tests", "vs", "testcd"), ("tests", "eg", "testcd")):
            if table in ctx and column in ctx[table].columns:
                one = ctx[table].where(F.trim(column) != "").select(F.lit(kind).alias("kind"), F.col(column).alias("value")).distinct()
                told = one if told is None else told.unionByName(one)
        found: dict[str, set] = {}
        for r in told.collect():
            found.setdefault(r.kind, set()).add(r.value.strip().upper())
        visits = tuple(ctx["rules"].visit_schedule) if "rules" in ctx else ()
        ctx["vocabulary"] = Vocabulary(subject_pattern(ctx["dm"].agg(F.min("usubjid")).first()[0]), visits=visits, **{k: tuple(sorted(v, key=lambda x: (-len(x), x))) for k, v in found.items()})
    return ctx["vocabulary"]


class Words:
    """A question from which slots take their words."""

    def __init__(self, text: str):
        self.text = re.sub(r"[’`]", "'", text.lower())

    def take(self, pattern: str) -> re.Match | None:
        m = re.search(pattern, self.text)
        if m:
            self.text = self.text[: m.start()] + " | " + self.text[m.end() :]
        return m

    def left(self) -> list[str]:
        return [w for w in re.findall(r"[a-z0-9][a-z0-9'%./-]*", self.text) if w.rstrip(".") not in PLAIN]


def _day(text: str) -> str | None:
    import datetime as dt

    for shape in ("%Y-%m-%d", "%d-%b-%Y", "%d-%B-%Y"):
        try:
            return dt.datetime.strptime(text.replace(" ", "-"), shape).date().isoformat()
        except ValueError:
            continue
    return None


def _phrase(x: str) -> str:
    return rf"(?<![a-z0-9]){re.escape(x.lower())}(?![a-z0-9])"


def _who(w: Words, out: Intent, v: Vocabulary) -> None:
    """Slots of the subjects: id, site, age, sex, arm, country, disposition, medicine class."""
    f = out.filters
    if m := w.take(f"(?i){v.subjects.pattern}"):
        out.subject = m[0].upper()
    if m := w.take(r"\b(?:at |from |of )?(?:the )?sites? (?:no\.? |number )?(s?[0-9]+)\b(?!-)|(?:\bat |\bfrom )?\b(s[0-9]{2,})\b(?!-)"):
        told = (m[1] or m[2]).upper()
        same = [s for s in v.sites if s == told or re.sub(r"\D", "", s) and int(re.sub(r"\D", "", s)) == int(told.lstrip("S"))]
        out.site = same[0] if same else "S" + told.lstrip("S").zfill(2)
    number = r"(\d{1,3})"
    years = r"(?: years?(?: of age| old)?| yrs?)?"
    if m := w.take(rf"\b(?:aged?|ages?)(?: is| are| was| were)? (?:between |from )?{number} ?(?:-|–|to|and) ?{number}{years}") or w.take(rf"\bbetween {number} and {number} years(?: of age| old)?"):
        f["age"] = (float(m[1]), float(m[2]))
    elif m := w.take(rf"\b(?:aged? )?(?:under|below|younger than|less than)(?: the age of)? {number}\b(?! days?){years}"):
        f["age"] = (-1.0, float(m[1]) - 1e-9)
    elif m := w.take(rf"\b(?:aged? )?(?:over|above|older than|more than)(?: the age of)? {number}\b(?! days?){years}"):
        f["age"] = (float(m[1]) + 1e-9, 1e9)
    elif m := w.take(rf"\b(?:aged? )?(?:at least )?{number}(?: years?(?: of age)?)? (?:or|and) (?:older|over|above)|\baged? at least {number}{years}"):
        f["age"] = (float(m[1] or m[2]), 1e9)
    elif m := w.take(rf"\b(?:aged? )?(?:at most )?{number}(?: years?(?: of age)?)? (?:or|and) (?:younger|under|below)|\baged? at most {number}{years}"):
        f["age"] = (-1.0, float(m[1] or m[2]))
    if m := w.take(r"\b(females?|males?|women|men)\b"):
        f["sex"] = "F" if m[1] in ("female", "females", "women") else "M"
    for x in v.classes:
        if w.take(rf"(?:\b(?:taking|on|with|using|took) )?{_phrase(x)}(?: medications?| medicines?)?") or w.take(rf"(?:\b(?:taking|on|using|took) ){_phrase(x + 's')}"):
            f["cm_class"] = x
            break
    for status, named, implied in STATUSES:
        if w.take(rf"\b(?:{status})\b"):
            f["status"] = named
            if implied:
                f["reason"] = implied
            break
    if "status" in f:
        reasons = sorted({**{r.lower(): r for r in v.reasons}, **REASON_NAMES}.items(), key=lambda x: -len(x[0]))
        for spoken, reason in reasons:
            if w.take(rf"\b(?:due to|because of|owing to|for|after)(?: an?| the)? {_phrase(spoken)}"):
                f["reason"] = reason
                break
    for x in v.countries:
        if w.take(rf"(?:\b(?:in|from) )?{_phrase(x)}"):
            f["country"] = x
            break
    for x in v.arms:
        if w.take(rf"(?:\b(?:in|on|of) )?(?:the )?{_phrase(x)}(?: arm| group)?"):
            f["arm"] = x
            break


def _when(w: Words, out: Intent, v: Vocabulary) -> None:
    """Slots of time: dates, days around a visit, visits."""
    if m := w.take(rf"\bbetween {DAY} and {DAY}|\bfrom {DAY} (?:to|until) {DAY}"):
        out.dates = (_day(m[1] or m[3]), _day(m[2] or m[4]))
    elif m := w.take(rf"\b(?:since|from|on or after) {DAY}"):
        out.dates = (_day(m[1]), None)
    elif m := w.take(rf"\b(?:until|up to|on or before) {DAY}"):
        out.dates = (None, _day(m[1]))
    elif m := w.take(rf"\bon {DAY}"):
        out.dates = (_day(m[1]), _day(m[1]))
    if out.dates and not any(out.dates):
        out.dates, out.left = None, ["date"]
    if m := w.take(r"(?:±|\+/-|\bwithin|\bin) ?(\d+) ?days?(?: of| around| from)?"):
        out.days = int(m[1])
    if m := w.take(r"\b(?:the )?(?:week|wk|w)[ _-]?(\d+)\b(?: visits?)?"):
        out.visit = f"WEEK{int(m[1])}"
    elif m := w.take(r"\b(?:the )?day (-?\d+)\b(?: visits?)?"):
        out.visit = f"DAY{int(m[1])}"
    elif m := w.take(r"\b(?:the )?(screening|baseline|end[ -]of[ -](?:study|treatment)|final visit|eos)\b(?: visits?)?"):
        out.visit = m[1].upper() if m[1] in ("screening", "baseline") else "EOS"
    else:
        for x in v.visits:
            if w.take(_phrase(x)):
                out.visit = x
                break


def _found(w: Words, out: Intent) -> None:
    """The slot of the finding; it goes first, for its phrases hold words of others."""
    for code, sub, said in FINDINGS:
        if m := w.take(rf"(?:\b(?:an?|any|the|of) )*(?:{said})"):
            out.finding, out.subcode, out.filters["_said"] = code, sub, m[0]
            break


def _what(w: Words, out: Intent, v: Vocabulary) -> None:
    """Slots of the records: test, severity, domains."""
    for spoken, code in sorted({**TEST_NAMES, **{t.lower(): t for t in v.tests}}.items(), key=lambda x: -len(x[0])):
        if w.take(_phrase(spoken)):
            out.test = code
            break
    if m := w.take(r"\b(mild|moderate|severe)\b"):
        out.filters["severity"] = m[1].upper()
    for d, said in DOMAINS:
        if w.take(rf"(?:{said})"):
            out.domains.append(d)


def classify(text: str, v: Vocabulary = Vocabulary()) -> Intent:
    """The question's kind and slots; `left` are the words that none of them took."""
    w, out = Words(text), Intent()
    document = re.search(r"\bprotocol\b|\bmanual\b|\bsap\b|\bamendments?\b|\bdocuments?\b|\bversions? \d|\bautomated reviewers?\b|^\s*what(?:'s| is| are) the (?:\w+ ){0,3}(?:windows?|thresholds?|limits?|schedule|conversion|expected dose)", w.text)
    whole = w.take(r"\b(?:everything|overview|summary|summari[sz]e|360|(?:full |patient )?profile)\b(?: (?:about|for|of|on))?")
    counts = w.take(r"\bhow many\b|\b(?:the |total )*number of\b|\bcount(?: of)?\b")
    noun = re.search(r"\b(?:subjects?|patients?|participants?|people|persons?|individuals?|women|men|females?|males?)\b", w.text)
    _found(w, out)
    _who(w, out, v)
    _when(w, out, v)
    _what(w, out, v)
    out.left += w.left()
    said = out.filters.pop("_said", "")
    if document and not out.subject and not counts:
        out = Intent("doc", confidence=0.8)  # its words are searched for
    elif counts:
        out.kind, out.confidence = "count", 0.9
        out.records = not noun and bool(out.domains or out.test or out.finding or re.search(r"\brecords?|results?|events?\b", w.text))
    elif out.subject and whole:
        out.kind, out.confidence = "patient360", 0.9
    elif out.finding:
        out.kind, out.confidence = "finding", 0.85
    elif out.subject or out.domains or out.test:
        out.kind, out.confidence = "lookup", 0.8 if out.subject else 0.5
    elif noun and (out.filters or out.site):
        out.kind, out.confidence = "subjects", 0.7
    if out.kind == "count" and not out.records and out.domains and not out.finding:  # subjects with such records
        out.filters["_domain"] = out.domains
    if said and not noun and out.kind == "count" and out.finding == "SERIOUS_AE":
        out.records = True
    return out


def unused(intent: Intent) -> list[str]:
    """Words and slots that the intent's plan can't use: with any of them the question isn't understood."""
    out = list(intent.left)
    if intent.kind in ("finding", "patient360", "subjects") or intent.kind == "count" and not intent.records:
        out += [name for name in ("days", "dates") if getattr(intent, name) is not None]
    if intent.kind in ("finding", "patient360"):
        out += [name for name in ("visit", "test") if getattr(intent, name) is not None]
    if intent.kind in ("lookup", "patient360", "finding") or intent.records:
        out += [k for k in ("severity",) if k in intent.filters and not (intent.kind == "lookup" or intent.records) or intent.kind == "patient360" and k in intent.filters]
    if intent.kind == "patient360":
        out += [k for k in intent.filters if k != "severity"] + (["site"] if intent.site else [])
    if intent.days is not None and intent.visit is None:
        out.append("days without a visit")
    if intent.subject and intent.kind == "subjects":
        out.append("subject")
    return out


WHO = ("site", "arm", "sex", "country", "age", "status", "reason", "cm_class")


def who(ctx: dict, intent: Intent) -> DataFrame | None:
    """(usubjid) of the subjects that the question is about; None if it is about all."""
    f = {k: v for k, v in intent.filters.items() if k in WHO}
    if intent.site:
        f["site"] = intent.site
    out = K.count_subjects(ctx, **f).select("usubjid").distinct() if f else None
    if intent.subject:
        own = F.col("usubjid") == intent.subject
        out = ctx["dm"].where(own).select("usubjid").distinct() if out is None else out.where(own)
    return out


def subjects_plan(ctx: dict, intent: Intent) -> DataFrame:
    """(usubjid, person_id) of the subjects that meet every slot."""
    f = {k: v for k, v in intent.filters.items() if not k.startswith("_")}
    for name in ("site", "visit", "finding", "subcode", "test"):
        if getattr(intent, name):
            f[name] = getattr(intent, name)
    out = K.count_subjects(ctx, **f)
    if intent.subject:
        out = out.where(F.col("usubjid") == intent.subject)
    for d in intent.filters.get("_domain", ()):
        out = out.join(ctx["domains"][d], "usubjid", "left_semi")
    return out


def count_plan(ctx: dict, intent: Intent) -> DataFrame:
    """(n_persons, n_subjects), or (n_records)."""
    if not intent.records:
        return K.collapse(subjects_plan(ctx, intent))
    found = finding_plan(ctx, intent) if intent.finding else records_plan(ctx, intent)
    return found.agg(F.count("*").alias("n_records"))


DATES = {"AE": ("ae", "stdtc"), "LB": ("lb", "dtc"), "EX": ("ex", "stdtc"), "CM": ("cm", "stdtc"), "DS": ("ds", "stdtc"), "MH": ("mh", None), "DM": ("dm", "rfstdtc"), "VS": ("vs", "dtc"), "EG": ("eg", "dtc")}


def records_plan(ctx: dict, intent: Intent) -> DataFrame:
    """(domain, usubjid, seq, date, fields) of the records that meet every slot."""
    tests = {"SYSBP": "VS", "DIABP": "VS", "QTCF": "EG"}
    asked = intent.domains or ([tests.get(intent.test, "LB")] if intent.test else list(DATES))
    held = lambda d: ctx[DATES[d][0]].withColumn("seq", F.lit(None).cast("bigint")) if "seq" not in ctx[DATES[d][0]].columns else ctx[DATES[d][0]]
    records = K.long_records({d: (held(d), DATES[d][1]) for d in asked if DATES[d][0] in ctx})
    if (own := who(ctx, intent)) is not None:
        records = records.join(own, "usubjid", "left_semi")
    field_ = lambda name: F.try_element_at("fields", F.lit(name))
    if intent.test:
        records = records.where(F.upper(field_("testcd")) == intent.test)
    if "severity" in intent.filters:
        records = records.where(F.upper(N.strip(field_("sev"))) == intent.filters["severity"])
    if intent.dates:
        for day, keep in zip(intent.dates, (lambda c, d: c >= d, lambda c, d: c <= d)):
            records = records.where(keep(F.col("date"), F.lit(day).cast("date"))) if day else records
    if intent.visit and intent.days is not None:
        rules = ctx.get("rules", R.Rules())
        records = K.anchored(records, K.visit_anchors(ctx["visits"], ctx["dm"], intent.visit, rules.visit_schedule.get(intent.visit)), intent.days).drop("anchor")
    elif intent.visit:
        records = records.where(N.visit_code(field_("visit")) == intent.visit)
    return records


def lookup_plan(ctx: dict, intent: Intent) -> DataFrame:
    return records_plan(ctx, intent).select("domain", "usubjid", "seq").orderBy("domain", "usubjid", "seq")


def finding_plan(ctx: dict, intent: Intent) -> DataFrame:
    out = ctx["findings"].where(F.col("code") == intent.finding)
    if intent.subcode:
        out = out.where(F.col("subcode") == intent.subcode)
    own = who(ctx, intent) if intent.filters or intent.subject else None
    if own is not None:
        out = out.join(own, "usubjid", "left_semi")
    return out.where(N.site_of(F.col("usubjid")) == intent.site) if intent.site else out


def confidence_of(kind: str, empty: bool = False, dropped: bool = False, insufficient: bool = False, ambiguous: bool = False) -> float:
    base = 0.2 if ambiguous else 0.3 if insufficient else 0.85 if empty or kind == "doc" else 0.9
    return max(0.05, min(0.95, round(base - 0.1 * dropped, 3)))


def document_answer(ctx: dict, text: str) -> Answer:
    """Differences of versions, unit facts and rules from the documents in force; else all sentences that hold the question's words, most first."""
    low, docs = text.lower(), ctx["documents"]
    versions = [int(x) for x in re.findall(r"\bv(?:ersion)? ?(\d+)\b", low)] or ([int(x) for x in re.findall(r"\bversions (\d+) and (\d+)", low)[0]] if re.search(r"\bversions \d+ and \d+", low) else [])
    by = ctx.get("rules_by")
    if isinstance(by, dict) and len(versions) == 2 and all(x in by for x in versions):
        rows = protocol.diff(docs.sparkSession, by[versions[0]], by[versions[1]]).orderBy("field").collect()
        return Answer("doc", "ok" if rows else "no_match", [tuple(r) for r in rows], [], confidence_of("doc", not rows))
    if re.search(r"\bunits?\b|\bconver(?:t|sion)", low) and "kind" in docs.columns:
        rows = L.learned(docs).orderBy("c_from", "c_to").collect()
        return Answer("doc", "ok" if rows else "no_match", [tuple(r) for r in rows], [], confidence_of("doc", not rows))
    rules = by[versions[0]] if isinstance(by, dict) and len(versions) == 1 and versions[0] in by else ctx.get("rules")
    if rules is not None and re.search(r"\bwhat(?:'s| is| are)\b", low):
        for said, names in protocol.SPOKEN:
            if re.search(said, low):
                found = {n: protocol.told(getattr(rules, n)) for n in names if getattr(rules, n) not in (None, {}, ())}
                return Answer("doc", "ok" if found else "no_match", found, [], confidence_of("doc", not found))
    if "version" in docs.columns and (version := ctx.get("version")) is not None:  # of a kind's versions the one in force: the highest at or below the cut's
        at = docs.where(F.col("version").isNull() | (F.col("version") <= version)).groupBy("kind").agg(F.max_by("name", F.coalesce("version", F.lit(0))).alias("_n")).select(F.col("_n").alias("name"))
        docs = docs.join(at, "name", "left_semi") if not versions else docs.where(F.col("version").isin(versions))
    words = [w for w in re.findall(r"[a-z0-9]{4,}", low) if w not in ("what", "does", "protocol", "manual", "rule", "version", "about", "document", "documents", "says")]
    hits = F.lit(0)
    for w in words:
        hits = hits + F.lower("sentence").contains(w).cast("int")
    rows = docs.select("name", F.explode(N.sentences(F.col("text"))).alias("sentence")).withColumn("hits", hits).withColumn("instruction", N.instruction_reasons(F.col("sentence"))).where("hits > 0").orderBy(F.desc("hits"), "name", "sentence").collect()
    return Answer("doc", "ok" if rows else "no_match", [(r.name, r.sentence, r.instruction) for r in rows], [], confidence_of("doc", not rows))


def with_terms(ctx: dict, intent: Intent) -> Intent:
    """Words that no slot took may be a reported adverse event or a medicine: they are looked up in the data."""
    if intent.left and intent.kind in ("count", "unknown", "subjects") and "ae" in ctx and "term" not in intent.filters:
        asked = " ".join(intent.left)
        hit = ctx["ae"].select(F.lower(N.strip(F.col("term"))).alias("t")).where(F.col("t") != "").where(F.lit(asked).contains(F.col("t"))).agg(F.max_by("t", F.length("t"))).first()[0]
        if hit:
            intent.filters["term"] = hit
            intent.left = re.findall(r"\S+", asked.replace(hit, " ", 1))
            intent.kind = "subjects" if intent.kind == "unknown" else intent.kind
    return intent


def answer(ctx: dict, text: str, limit: int = 1000) -> Answer:
    """One question, one action; what isn't understood or can't be answered says so. ctx may hold `documents` (name, text) and `unavailable` rules. Only refs end at the limit."""
    intent = classify(text, vocabulary(ctx)) if "dm" in ctx else classify(text)
    if "dm" in ctx and intent.left:
        intent = with_terms(ctx, intent)
    if gone := unused(intent):
        return Answer(intent.kind, "ambiguous", None, [], confidence_of(intent.kind, ambiguous=True)) if intent.kind != "unknown" or "dm" in ctx else Answer("unknown", "ambiguous", None, gone[:0], confidence_of("unknown", ambiguous=True))
    if why := ctx.get("unavailable", {}).get(intent.finding):
        return Answer(intent.kind, "insufficient", why, [], confidence_of("finding", insufficient=True))
    if intent.kind == "count":
        row = count_plan(ctx, intent).first()
        n = row.n_records if intent.records else row.n_persons
        return Answer("count", "ok" if n else "no_match", n, [], confidence_of("count", not n))
    if intent.kind == "subjects":
        found = [r.usubjid for r in subjects_plan(ctx, intent).select("usubjid").distinct().orderBy("usubjid").collect()]
        return Answer("subjects", "ok" if found else "no_match", found, [], confidence_of("count", not found))
    if intent.kind == "patient360":
        parts = {name: df.count() for name, df in G.patient(ctx, intent.subject).items()}
        return Answer("patient360", "ok" if parts["demographics"] else "no_match", parts, [], confidence_of("patient360", not parts["demographics"]))
    if intent.kind == "finding":
        found = finding_plan(ctx, intent)
        cited = found.select("domain", "usubjid", "seq")
        known = K.long_records({d: (df, None) for d, df in ctx["domains"].items()}).select("domain", "usubjid", "seq")
        subjects = [r.usubjid for r in found.select("usubjid").distinct().orderBy("usubjid").collect()]
        rows = E.existing(cited, known).where("exists").orderBy("usubjid", "domain", "seq").limit(limit + 1).collect()
        refs = [(r.domain, r.usubjid, r.seq) for r in rows[:limit]]
        return Answer("finding", "ok" if subjects else "no_match", subjects, refs, confidence_of("finding", not subjects), len(rows) > limit)
    if intent.kind == "lookup":
        found = lookup_plan(ctx, intent)
        n, rows = found.count(), found.limit(limit).collect()
        return Answer("lookup", "ok" if n else "no_match", n, [tuple(r) for r in rows], confidence_of("lookup", not n), n > len(rows))
    if intent.kind == "doc" and "documents" in ctx and "text" in ctx["documents"].columns:
        return document_answer(ctx, text)
    return Answer(intent.kind, "insufficient", None, [], confidence_of("error", insufficient=True))


def rewrite_is_safe(old: str, new: str) -> bool:
    """A rewritten answer may name no id or number that the answer didn't."""
    told = lambda t: set(re.findall(r"[0-9]{3}-S[0-9]{2}-[0-9]{3,}|\d+(?:\.\d+)?", t))
    return told(new) <= told(old)
