"""The named tools: what a caller may ask of a study, each a function of its context to a lazy table (patient360: tables by name)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..operators import graph as G
from ..operators import labs as L
from ..operators import lookups as K
from . import protocol
from .router import Intent, finding_plan, lookup_plan


def count_records(ctx: dict, domain: str, **filters) -> DataFrame:
    """(n_records): the domain's records of the subjects that meet the filters."""
    return ctx["domains"][domain.upper()].join(K.count_subjects(ctx, **filters).select("usubjid").distinct(), "usubjid", "left_semi").agg(F.count("*").alias("n_records"))


def lab_values(ctx: dict, usubjid: str, test: str) -> DataFrame:
    return ctx["labs"].where((F.col("usubjid") == usubjid) & (F.col("testcd") == test)).orderBy("date", "seq")


def instruction_like(ctx: dict) -> DataFrame:
    """(name, sentence, reasons): sentences that address automated readers; they are reported, never followed."""
    told = ctx["documents"].select("name", F.explode(N.sentences(F.col("text"))).alias("sentence"))
    return told.withColumn("reasons", N.instruction_reasons(F.col("sentence"))).where("reasons is not null")


def protocol_rule_text(ctx: dict, name: str, section: str) -> DataFrame:
    """(section, title, text) of a document's section; no row where there is none."""
    row = ctx["documents"].where(F.lower("name") == name.lower()).select("text").first()
    parts = protocol.sections(row.text) if row else {}
    key = protocol.section_for(parts, section) if parts else None
    return ctx["documents"].sparkSession.createDataFrame([(key, *parts[key])] if key else [], "section string, title string, text string")


def rule_value(ctx: dict, parameter: str) -> DataFrame:
    """(parameter, value) of the rules in force; no row for what the protocol doesn't state or the rules don't know."""
    value = protocol.told(getattr(ctx["rules"], parameter, None)) if hasattr(ctx.get("rules"), parameter) else None
    return ctx["dm"].sparkSession.createDataFrame([(parameter, value)] if value else [], "parameter string, value string")


TOOLS: dict[str, Callable] = {
    "rule_value": rule_value,
    "count_subjects": lambda ctx, **filters: K.collapse(K.count_subjects(ctx, **filters)),
    "count_records": count_records,
    "records_for_subject": lambda ctx, usubjid, domains=(): lookup_plan(ctx, Intent(subject=usubjid, domains=list(domains))),
    "records_at_visit": lambda ctx, visit, domains=(), days=None: lookup_plan(ctx, Intent(visit=visit, domains=list(domains), days=days)),
    "finding_subjects": lambda ctx, finding, site=None: finding_plan(ctx, Intent(finding=finding, site=site)).select("usubjid").distinct(),
    "lab_values": lab_values,
    "abnormal_labs": lambda ctx, test, **choice: L.abnormal(ctx["labs"], test, **choice),
    "patient360": G.patient,
    "instruction_like": instruction_like,
    "protocol_rule_text": protocol_rule_text,
    "protocol_diff": lambda ctx, old, new: protocol.diff(ctx["dm"].sparkSession, old, new),
    "unit_facts": lambda ctx: L.learned(ctx["documents"]),
}


def call(ctx: dict, tool: str, /, **arguments):
    """A tool by name; an unknown name is a KeyError."""
    return TOOLS[tool](ctx, **arguments)
