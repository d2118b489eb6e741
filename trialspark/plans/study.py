"""The engine's objects: a study built as of a cut, its questions, its review cycle and its surveillance."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cuts as C
from ..operators import detectors as D
from ..operators import graph as G
from ..operators import identity as I
from ..operators import incremental as V
from ..operators import labs as L
from ..operators import ledger as S
from ..operators import review as P
from ..operators import rules as R
from ..sources import study as source
from . import router

#: Study files' columns by the engine's names.
NAMES = {
    "DM": {"USUBJID": "usubjid", "SITEID": "siteid", "COUNTRY": "country", "AGE": "age", "SEX": "sex", "DMINIT": "dminit", "BRTHDTC": "brthdtc", "ARM": "arm", "RFSTDTC": "rfstdtc", "SCR_HBA1C": "scr_hba1c"},
    "LB": {"USUBJID": "usubjid", "VISIT": "visit", "LBDTC": "dtc", "LBTESTCD": "testcd", "LBORRES": "orres", "LBORRESU": "unit"},
    "AE": {"USUBJID": "usubjid", "AETERM": "term", "AESEV": "sev", "AESER": "ser", "AESHOSP": "hosp", "AESTDTC": "stdtc"},
    "EX": {"USUBJID": "usubjid", "VISIT": "visit", "EXSTDTC": "stdtc", "EXDOSE": "dose", "EXDOSU": "unit"},
    "CM": {"USUBJID": "usubjid", "CMTRT": "trt", "CMCLAS": "cls", "CMSTDTC": "stdtc"},
    "DS": {"USUBJID": "usubjid", "DSDECOD": "decod", "DSTERM": "term", "DSSTDTC": "stdtc"},
    "MH": {"USUBJID": "usubjid", "MHTERM": "term"},
    "VS": {"USUBJID": "usubjid", "VISIT": "visit", "VSDTC": "dtc", "VSTESTCD": "testcd", "VSORRES": "orres", "VSORRESU": "unit"},
    "EG": {"USUBJID": "usubjid", "VISIT": "visit", "EGDTC": "dtc", "EGTESTCD": "testcd", "EGORRES": "orres", "EGORRESU": "unit"},
}
#: The date column of each domain with visits.
DATED = {"LB": "dtc", "VS": "dtc", "EG": "dtc", "EX": "stdtc"}
#: The tables that several rules read.
WRITTEN = ("dm", "lb", "ae", "ex")


def tables_of(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A study directory's tables under the engine's names; a domain that isn't there has no rows."""
    found, out = source.load_study(spark, path), {}
    for domain, names in NAMES.items():
        df = found.get(domain)
        if df is None:
            df = spark.createDataFrame([], ", ".join(f"{v} string" for v in names.values()) + ", seq bigint, cut_available int, row_no bigint")
        else:
            df = df.select(*[(F.col(k) if k in df.columns else F.lit("")).alias(v) for k, v in names.items()], "seq", "cut_available", "row_no")
        out[domain.lower()] = df
    sites = out["dm"].select("usubjid", F.col("siteid").alias("_s"), F.col("arm").alias("_a"))
    for name in ("lb", "ae", "ex", "cm", "ds", "mh", "vs", "eg"):
        joined = out[name].join(sites, "usubjid", "left").withColumn("site", F.coalesce("_s", F.get(F.split("usubjid", "-"), F.lit(1))))
        out[name] = (joined.withColumn("arm", F.col("_a")) if name == "ex" else joined).drop("_s", "_a")
    return out


class Study:
    """A study's tables as known at a cut, with everything derived from them, lazily; build() moves to another cut."""

    def __init__(self, tables: dict[str, DataFrame], corrections: DataFrame, ranges: DataFrame, rules: R.Rules | dict[int, R.Rules] = R.Rules(), cuts: DataFrame | None = None, documents: DataFrame | None = None):
        self.tables, self.corrections, self.ranges, self.rules_by, self.cuts, self.documents = tables, corrections, ranges, rules, cuts, documents
        self.kept: dict = {}
        self.build()

    def build(self, cut: int | None = None, version: int | None = None) -> Study:
        self.cut, self.version = cut, version
        key = (cut, version)
        if key not in self.kept:
            self.kept[key] = self.context(cut, version)
        self.ctx = self.kept[key]
        return self

    def rules(self, version: int | None) -> R.Rules:
        """The version's rules, else those of the closest lower one, else the lowest."""
        if isinstance(self.rules_by, R.Rules):
            return self.rules_by
        known = sorted(self.rules_by)
        at = [v for v in known if version is None or v <= version]
        return self.rules_by[at[-1] if at else known[0]]

    def view(self, cut: int | None, subjects: DataFrame | None = None) -> dict[str, DataFrame]:
        """The tables as known at the cut, corrections applied; of some subjects only, if given."""
        own = (lambda df: df.join(subjects, "usubjid", "left_semi")) if subjects is not None else (lambda df: df)
        ctx = {name: own(C.as_of(df, cut) if "cut_available" in df.columns else df) for name, df in self.tables.items()}
        if "domain" in self.corrections.columns:
            fixed = C.overlay_all({d: ctx[d.lower()] for d in NAMES if d.lower() in ctx}, self.corrections, NAMES, cut)
            ctx |= {d.lower(): df for d, df in fixed.items()}
        else:
            ctx["lb"] = C.overlay(ctx["lb"], self.corrections, "LBORRES", "orres", cut)
        return ctx

    def written_view(self, cut: int, state: str, again: bool = False) -> dict[str, DataFrame]:
        """view(cut) with the tables that several rules read written once, there or now; `again` replaces them."""
        spark, view = self.corrections.sparkSession, self.view(cut)
        for name in WRITTEN:
            path = f"{state}/view/{name}"
            if again or not source.exists(spark, f"{path}/cut={cut}"):
                source.save_state(view[name], path, cut)
            view[name] = spark.read.schema(view[name].schema).parquet(f"{path}/cut={cut}")
        return view

    def context(self, cut: int | None, version: int | None, subjects: DataFrame | None = None, dosed: DataFrame | None = None, view: dict[str, DataFrame] | None = None) -> dict:
        """view() with everything derived; `dosed` are the visits at which anyone was dosed, if the view holds some subjects only; `view`, if given, is of all subjects."""
        rules = self.rules(version)
        if view is None:
            ctx = self.view(cut, subjects)
        else:
            ctx = dict(view) if subjects is None else {name: df.join(subjects, "usubjid", "left_semi") for name, df in view.items()}
        if dosed is not None:
            ctx["dosed"] = dosed
        for name in ("vs", "eg"):
            ctx.setdefault(name, ctx["lb"].limit(0))
        manuals = L.learned(self.documents) if self.documents is not None and "kind" in self.documents.columns else None
        ctx |= {"labs": L.with_ranges(ctx["lb"], self.ranges, manuals), "visits": G.visits_of({d: (ctx[d.lower()], dated) for d, dated in DATED.items()}), "version": version, "doses": R.first_dose(ctx["dm"], ctx["ex"]), "persons": I.persons(ctx["dm"]), "ranges": self.ranges, "unavailable": rules.unavailable(), "rules": rules, "rules_by": self.rules_by}
        ctx["findings"] = R.all_findings(ctx, rules)
        ctx["domains"] = {"LB": ctx["lb"], "VS": ctx["vs"], "EG": ctx["eg"], "MH": ctx["mh"], "AE": ctx["ae"], "EX": ctx["ex"], "CM": ctx["cm"], "DS": ctx["ds"], "DM": ctx["dm"].withColumn("seq", F.lit(None).cast("bigint"))}
        if self.cuts is not None:
            ctx["cuts"] = self.cuts
        if self.documents is not None:
            ctx["documents"] = self.documents
        return ctx

    def findings(self, cache: str, signature: str) -> DataFrame:
        """The findings at the study's cut and version, kept under the signature of its files (sources.signature): computed once until a file changes.

        What other signatures left there is removed.
        """
        spark = self.corrections.sparkSession
        path = f"{cache}/{signature}/cut={self.cut}/version={self.version}"
        if not source.exists(spark, path):
            source.keep_only(spark, cache, signature)
            self.ctx["findings"].write.mode("overwrite").parquet(path)
        return spark.read.schema(R.FINDING).parquet(path)

    def advance(self, cut: int, state: str, version: int | None = None) -> DataFrame:
        """The findings at the cut, from those kept of the cut before if there are any, else derived whole; kept for the next.

        A cut run again gives the same rows; state holds findings, touched subjects and a line of what was done, by cut.
        """
        spark = self.corrections.sparkSession
        before = spark.read.json(f"{state}/advanced/cut={cut - 1}").first() if source.exists(spark, f"{state}/advanced/cut={cut - 1}") else None
        view = self.written_view(cut, state, again=True)
        dosed_now = sorted(r.visit for r in R.dosed_visits(view["ex"]).where("visit <> ''").collect())  # a study's visits: a few dozen
        done = {"cut": cut, "version": version, "dosed": dosed_now, "whole": before is None, "touched_rules": [], "everyone_rules": sorted(R.RULES)}
        if before is None:
            found = self.context(cut, version, view=view)["findings"]
        else:
            source.save_state(V.touched({d: self.tables[d.lower()] for d in NAMES if d.lower() in self.tables}, self.corrections, cut), f"{state}/touched", cut)
            touched = spark.read.parquet(f"{state}/touched/cut={cut}")
            sums = {r.domain: (r.n, r.c) for r in touched.groupBy("domain").agg(F.sum("n_new").alias("n"), F.sum("n_corrected").alias("c")).collect()}
            again = V.dirty(set(sums), V.changed_fields(self.rules(before["version"]), self.rules(version)), dosed_now != list(before["dosed"]))
            done |= {"touched_rules": list(again.touched), "everyone_rules": list(again.everyone), "new_records": {d: n for d, (n, _) in sums.items()}, "corrections": sum(c for _, c in sums.values())}
            subjects = touched.select("usubjid").distinct()
            if "DUPLICATE_SUBJECT" in again.touched:
                subjects = V.kin(subjects, self.view(cut - 1)["dm"], view["dm"])
            source.save_state(subjects, f"{state}/subjects", cut)
            subjects = spark.read.parquet(f"{state}/subjects/cut={cut}")
            dosed = spark.createDataFrame([(v,) for v in dosed_now], "visit string")
            rules, prior = self.rules(version), spark.read.schema(R.FINDING).parquet(f"{state}/findings/cut={cut - 1}")
            some = R.all_findings(self.context(cut, version, subjects, dosed, view), rules, again.touched)
            whole = R.all_findings(self.context(cut, version, view=view), rules, again.everyone) if again.everyone else prior.limit(0)
            found = V.merged(prior, again, subjects, some, whole)
        source.save_state(found, f"{state}/findings", cut)
        spark.createDataFrame([(json.dumps(done),)], "value string").coalesce(1).write.mode("overwrite").text(f"{state}/advanced/cut={cut}")  # last: a cut without it is done anew
        return spark.read.schema(R.FINDING).parquet(f"{state}/findings/cut={cut}")

    def answer(self, question: str) -> router.Answer:
        return router.answer(self.ctx, question)

    def patient360(self, usubjid: str) -> dict[str, DataFrame]:
        return G.patient(self.ctx, usubjid)

    def related_subjects(self, entity: str, value: str, source_subject: str | None = None) -> DataFrame:
        return G.related_by(self.ctx, entity, value, source_subject)


class ReviewCrew:
    """Review cycles over a study; memory is a state table, so a cut run again opens nothing anew."""

    def __init__(self, study: Study, state: str):
        self.study, self.state = study, state

    def memory(self) -> DataFrame:
        return source.load_state(self.study.ctx["lb"].sparkSession, f"{self.state}/memory", "fingerprint string, cut int")

    def run_cycle(self, cut: int, version: int | None = None, decisions: DataFrame | None = None) -> dict[str, DataFrame]:
        ctx = self.study.build(cut, version).ctx
        spark = ctx["lb"].sparkSession
        known, rules = self.memory(), ctx["rules"]
        source.save_state(P.detect(ctx["findings"]), f"{self.state}/detected", cut)  # written once: the nodes and their readers take it from there
        found = spark.read.parquet(f"{self.state}/detected/cut={cut}")
        base = R.raised_baseline(ctx["labs"], rules) if "HYS_LAW_CANDIDATE" not in ctx["unavailable"] else ctx["dm"].limit(0)
        told = decisions if decisions is not None else spark.createDataFrame([], "key string, decision string")
        said_no = told.where("decision = 'REJECTED'").select("key")
        rejected = found.join(said_no, F.concat_ws("|", "code", "usubjid") == F.col("key"), "left_semi").select("fingerprint")
        reviewed = P.medical_review(found, known, base, rejected)
        flags = source.load_state(spark, f"{self.state}/flags", "usubjid string, cycle bigint")
        again = P.recurring(found, flags, cut)
        gate = P.human_gate(reviewed, told, {})
        source.add_state(reviewed.where("route <> 'CARRIED'").select("fingerprint"), f"{self.state}/memory", cut)
        source.save_state(P.flagged(found, cut), f"{self.state}/flags", cut)
        return {"reviewed": reviewed, "gate": gate, "compliance": P.compliance(reviewed), "report": P.execute(reviewed, gate), "recurring": again}


class StudyWatch:
    """Surveillance cut by cut: findings into the ledger, detectors over sites, quarantine of what isn't trusted."""

    def __init__(self, study: Study, state: str):
        self.study, self.state = study, state

    def run_cut(self, cut: int) -> dict[str, DataFrame]:
        ctx = self.study.build(cut).ctx
        found = P.detect(ctx["findings"])
        source.save_state(found.select("fingerprint"), f"{self.state}/findings", cut)
        raw = self.study.tables["lb"]
        return {"delta": C.delta(raw, cut), "shifts": D.median_shift(raw, cut).where("is_shift"), "sites": D.quarantine(raw, cut, vs=self.study.tables.get("vs"))}

    def run_period(self, cuts: range) -> DataFrame:
        """The ledger after the cuts; a cut run again replaces its findings."""
        for cut in cuts:
            self.run_cut(cut)
        return self.ledger()

    def ledger(self) -> DataFrame:
        spark = self.study.tables["lb"].sparkSession
        return S.ledger(source.load_state(spark, f"{self.state}/findings", "fingerprint string, cut bigint"))
