"""The surveillance of a cut: thirteen steps in order, each written before the next begins.

A step reads the study and what earlier steps and cuts wrote, and gives one table, which replaces what it wrote before;
then a line in the step log says that it is done. A cut that stopped half-way goes on at the first step without a line, and
a cut run again from its start gives the same tables. Decisions are events of the step that takes them.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cuts as C
from ..operators import decisions as DS
from ..operators import detectors as D
from ..operators import ledger as S
from ..operators import review as P
from ..operators import rules as R
from ..sources import study as source
from . import protocol
from .study import NAMES, Study

SERIOUS = ("SERIOUS_AE", "HYS_LAW_CANDIDATE")
REPLIES, REGISTRY = "fingerprint string, cut bigint, decision string", "name string, sha256 string, cut int"


class Surveillance:
    """A study watched cut by cut. replies: the monitor's (fingerprint, cut, decision); asked: its questions (usubjid, question)."""

    def __init__(self, study: Study, state: str, replies: DataFrame | None = None, asked: DataFrame | None = None, total_ms: float | None = None):
        self.study, self.state, self.total_ms = study, state, total_ms
        self.spark: SparkSession = study.corrections.sparkSession
        self.replies = replies if replies is not None else self.spark.createDataFrame([], REPLIES)
        self.asked = asked
        self.decisions = DS.DecisionStore(self.spark, f"{state}/decisions")
        self.began, self._held = time.monotonic(), []

    # what is written

    def written(self, step: str, cut: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.state}/{step}/cut={cut}")

    def so_far(self, step: str, cut: int, schema: str, before: bool = False) -> DataFrame:
        """A step's rows of all cuts up to this one (or before it), with their cut."""
        out = source.load_state(self.spark, f"{self.state}/{step}", schema)
        return out.where(F.col("cut") < cut if before else F.col("cut") <= cut)

    def is_done(self, step: str, cut: int) -> bool:
        return source.exists(self.spark, f"{self.state}/log/cut={cut}/step={step}")

    def once(self, df: DataFrame) -> DataFrame:
        """A step's table from which decisions are taken too: computed once, and released when the step is written."""
        self._held.append(df.persist())
        return df

    def run_cut(self, cut: int, until: str | None = None) -> DataFrame:
        """Run the steps that the cut still lacks, up to `until`; the last one's table."""
        for step, make in STEPS:
            if not self.is_done(step, cut):
                try:
                    source.save_state(make(self, cut), f"{self.state}/{step}", cut)
                finally:
                    while self._held:
                        self._held.pop().unpersist()
                self.spark.createDataFrame([(step, cut)], "step string, cut int").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/log/cut={cut}/step={step}")
            if step == until:
                break
        return self.written(step, cut)

    def run_period(self, cuts: list[int]) -> DataFrame:
        """All cuts in order, then the period's roll-up."""
        for cut in sorted(cuts):
            self.run_cut(cut)
        return self.period()

    def period(self) -> DataFrame:
        sums = source.load_state(self.spark, f"{self.state}/result", "what string, n bigint, cut int").groupBy("cut").pivot("what", ["version", "findings", "serious", "queries"]).agg(F.first("n"))
        return S.period(sums)

    def version(self, cut: int) -> int | None:
        if self.study.cuts is None:
            return None
        return C.version_as_of(self.spark.createDataFrame([(cut,)], "at int"), self.study.cuts).first().version


def budget(w: Surveillance, cut: int) -> DataFrame:
    """The tier by the time spent; safety rules run in each."""
    tier = "FULL" if w.total_ms is None else S.budget_tier(1000 * (time.monotonic() - w.began), w.total_ms)
    return w.spark.createDataFrame([(tier,)], "tier string")


def delta(w: Surveillance, cut: int) -> DataFrame:
    """(domain, site, n_new, is_new_site, n_corrections): what the cut brings."""
    return C.delta_all({d: w.study.tables[d.lower()] for d in NAMES if d.lower() in w.study.tables}, w.study.corrections, cut)


def documents(w: Surveillance, cut: int) -> DataFrame:
    """(name, sha256, change) of the documents against what was last seen of each."""
    if w.study.documents is None:
        return w.spark.createDataFrame([], "name string, sha256 string, change string")
    seen = w.so_far("documents", cut, REGISTRY, before=True).groupBy("name").agg(F.max_by("sha256", "cut").alias("sha256"))
    return S.document_changes(w.study.documents, seen)


def amendment(w: Surveillance, cut: int) -> DataFrame:
    """(version, before, code): the version in force and, if it is another than before, a row for each rule that it touches."""
    now = w.version(cut)
    last = w.so_far("amendment", cut, "version int, before int, code string, cut int", before=True).agg(F.max_by("version", "cut").alias("v")).first().v
    here = w.spark.createDataFrame([(now, last)], "version int, before int")
    if last is None or last == now:
        return here.withColumn("code", F.lit(None).cast("string"))
    return S.affected_rules(protocol.diff(w.spark, w.study.rules(last), w.study.rules(now))).join(here).select("version", "before", "code")


def advance(w: Surveillance, cut: int) -> DataFrame:
    """The findings at the cut, with severity, site and fingerprint."""
    return P.detect(w.study.advance(cut, f"{w.state}/engine", w.version(cut)))


def labs(w: Surveillance, cut: int) -> DataFrame:
    """(site, testcd, shift, matched, usubjid, seq): the cut's results of tests whose unit seems to have changed."""
    raw = w.study.tables["lb"]
    shifts = D.median_shift(raw, cut).where("is_shift").select("site", "testcd", "shift", "matched")
    return raw.where(F.col("cut_available") == cut).select("site", "testcd", "usubjid", F.col("seq").cast("bigint").alias("seq")).join(shifts, ["site", "testcd"]).select("site", "testcd", "shift", "matched", "usubjid", "seq")


def sites(w: Surveillance, cut: int) -> DataFrame:
    """(site, n_signals): sites whose records are too regular to be trusted."""
    return D.quarantine(w.study.tables["lb"], cut, vs=w.study.tables.get("vs")).where("quarantined").select("site", "n_signals")


def crew(w: Surveillance, cut: int) -> DataFrame:
    """The findings with their routes; what earlier cuts routed is carried."""
    known = w.so_far("crew", cut, "fingerprint string, route string, cut int", before=True)
    ctx = w.study.written_view(cut, f"{w.state}/engine")
    results = w.study.context(cut, w.version(cut), view=ctx)["labs"] if "HYS_LAW_CANDIDATE" not in w.study.rules(w.version(cut)).unavailable() else None
    base = R.raised_baseline(results, w.study.rules(w.version(cut))) if results is not None else ctx["dm"].limit(0)
    return P.medical_review(w.written("advance", cut), known, base)


def corrections(w: Surveillance, cut: int) -> DataFrame:
    """(fingerprint, usubjid, seq, code): findings of the cut before on records corrected at this one that are gone."""
    if not w.is_done("advance", cut - 1):
        return w.written("advance", cut).limit(0).select("fingerprint", "usubjid", "seq", "code")
    fixed = w.study.corrections.where(F.col("cut") == cut).select("domain", "usubjid", "seq").distinct()
    before = w.written("advance", cut - 1)
    same = (before.domain == fixed.domain) & (before.usubjid == fixed.usubjid) & before.seq.eqNullSafe(fixed.seq)
    gone = before.join(fixed, same, "left_semi").join(w.written("advance", cut).select("fingerprint"), "fingerprint", "left_anti")
    out = w.once(gone.select("fingerprint", "usubjid", "seq", "code"))
    w.decisions.append(DS.events(out, "FINDING", F.col("fingerprint"), F.lit("RESOLVED"), F.lit(cut), F.lit("the record was corrected"), target=F.col("usubjid"), code=F.col("code")), cut, 9)
    return out


def ledger(w: Surveillance, cut: int) -> DataFrame:
    """(fingerprint, code, usubjid, site, domain, seq, status, escalated): findings on untrusted results or sites are QUARANTINED, the others CONFIRMED; whether a serious one has been escalated by now."""
    found = w.written("advance", cut)
    bad = w.so_far("labs", cut, "usubjid string, seq bigint, cut int").select(F.lit("LB").alias("domain"), "usubjid", "seq").distinct().withColumn("_u", F.lit(True))
    far = w.so_far("sites", cut, "site string, cut int").select("site").distinct().withColumn("_s", F.lit(True))
    raised = w.so_far("crew", cut, "fingerprint string, route string, cut int").where("route = 'ESCALATE'").select("fingerprint").distinct().withColumn("escalated", F.lit(True))
    out = found.join(bad, ["domain", "usubjid", "seq"], "left").join(far, "site", "left").join(raised, "fingerprint", "left")
    out = out.withColumn("status", F.when(F.coalesce("_u", "_s"), "QUARANTINED").otherwise("CONFIRMED")).withColumn("escalated", F.when(F.col("code").isin(*SERIOUS), F.coalesce("escalated", F.lit(False))))
    out = w.once(out.select("fingerprint", "code", "usubjid", "site", "domain", "seq", "status", "escalated"))
    refs = F.when(F.col("seq").isNotNull(), F.array(F.concat_ws(":", "domain", F.col("seq").cast("string")))).otherwise(F.array().cast("array<string>"))
    w.decisions.append(DS.events(out, "FINDING", F.col("fingerprint"), F.col("status"), F.lit(cut), F.col("code"), refs, F.col("usubjid"), F.col("code")), cut, 10)
    return out


def human(w: Surveillance, cut: int) -> DataFrame:
    """The escalations' states at the cut."""
    raised = w.so_far("crew", cut, "fingerprint string, usubjid string, route string, cut int").where("route = 'ESCALATE'").select("fingerprint", "usubjid", F.col("cut").cast("bigint").alias("cut"))
    told = raised.limit(0).select("fingerprint")
    if w.asked is not None:
        view = w.study.written_view(cut, f"{w.state}/engine")
        said = P.clarify(w.asked, view["lb"], view["cm"]).where(F.size("refs") > 0)
        told = raised.join(said, "usubjid", "left_semi").select("fingerprint")
    out = w.once(S.human_history(raised, w.replies, told, cut).where(F.col("cut") == cut).drop("cut"))
    w.decisions.append(DS.events(out, "HUMAN_GATE", F.col("fingerprint"), F.col("state"), F.lit(cut), F.lit("the monitor's state")), cut, 11)
    return out


def queries(w: Surveillance, cut: int) -> DataFrame:
    """(key, target, text): new data queries, and one for each test of a site whose unit seems changed, once a period."""
    data = P.data_queries(w.written("crew", cut), w.spark.createDataFrame([], "key string, status string")).select(F.col("fingerprint").alias("key"), F.col("usubjid").alias("target"), "text")
    labs_ = w.written("labs", cut).groupBy("site", "testcd").agg(F.count("*").alias("n"))
    asked = labs_.select(F.concat_ws("|", F.lit("LAB_SHIFT"), "site", "testcd").alias("key"), F.col("site").alias("target"), F.format_string("Please confirm the unit of %s at site %s (%d results).", "testcd", "site", "n").alias("text"))
    before = w.so_far("queries", cut, "key string, cut int", before=True).select("key")
    out = w.once(data.unionByName(asked).join(before, "key", "left_anti"))
    w.decisions.append(DS.events(out, "QUERY", F.col("key"), F.lit("OPEN"), F.lit(cut), F.col("text"), target=F.col("target")), cut, 12)
    return out


def result(w: Surveillance, cut: int) -> DataFrame:
    """(what, n): the cut's figures."""
    count = lambda step, what, when=None: w.written(step, cut).where(when or "true").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    total = lambda what: w.written("delta", cut).agg(F.coalesce(F.sum(what), F.lit(0)).alias("n")).select(F.lit({"n_new": "new_records", "n_corrections": "corrections"}[what]).alias("what"), "n")
    out = [
        total("n_new"), total("n_corrections"), count("advance", "findings"), count("advance", "serious", f"code in {SERIOUS}"), count("crew", "escalations", "route = 'ESCALATE'"), count("crew", "carried", "route = 'CARRIED'"),
        count("queries", "queries"), count("labs", "untrusted"), count("sites", "quarantined_sites"), count("corrections", "retracted"), count("ledger", "quarantined", "status = 'QUARANTINED'"), count("ledger", "serious_unescalated", "escalated = false"),
        w.written("human", cut).groupBy(F.concat(F.lit("human:"), "state").alias("what")).agg(F.count("*").alias("n")), w.written("amendment", cut).select(F.lit("version").alias("what"), F.col("version").cast("bigint").alias("n")).distinct(),
    ]
    for one in out[1:]:
        out[0] = out[0].unionByName(one)
    return out[0]


#: The steps of a cut, in order.
STEPS: list[tuple[str, Callable[[Surveillance, int], DataFrame]]] = [
    ("budget", budget), ("delta", delta), ("documents", documents), ("amendment", amendment), ("advance", advance), ("labs", labs), ("sites", sites), ("crew", crew),
    ("corrections", corrections), ("ledger", ledger), ("human", human), ("queries", queries), ("result", result),
]
