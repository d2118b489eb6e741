"""Evidence: citations must exist in the active cut, and the claims behind them must still hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(citations: DataFrame, keys: DataFrame, mark: str) -> DataFrame:
    k = keys.select(F.col("domain").alias("_d"), F.col("usubjid").alias("_u"), F.col("seq").alias("_q")).distinct().withColumn(mark, F.lit(True))
    return citations.join(k, (F.col("domain") == F.col("_d")) & (F.col("usubjid") == F.col("_u")) & F.col("seq").eqNullSafe(F.col("_q")), "left").drop("_d", "_u", "_q")


def existing(citations: DataFrame, records: DataFrame) -> DataFrame:
    """citations with `exists`: whether (domain, usubjid, seq) is in the records; a null seq matches a null one."""
    return _marked(citations, records, "_e").withColumn("exists", F.coalesce("_e", F.lit(False))).drop("_e")


def validated(citations: DataFrame, records: DataFrame, claims: DataFrame) -> DataFrame:
    """citations with the reason why each is dropped (null if it stands): missing from the cut, or its claim fails when it is computed anew."""
    out = _marked(existing(citations, records), claims, "_c")
    return out.withColumn("dropped", F.when(~F.col("exists"), "not_in_cut").when(F.col("_c").isNull(), "check_failed")).drop("_c", "exists")


def assemble(valid: DataFrame) -> DataFrame:
    """Findings that kept record support, with their citations in order, documents last."""
    ref = F.struct(F.when(F.col("domain") == "DOC", 1).otherwise(0), "usubjid", "domain", F.coalesce("seq", F.lit(-1)))
    text = F.concat_ws(":", "domain", "usubjid", F.col("seq").cast("string"))
    return valid.where("dropped is null").groupBy("finding").agg(F.count_if(F.col("domain") != "DOC").alias("n_records"), F.sort_array(F.collect_set(F.struct(ref.alias("k"), text.alias("t")))).alias("_r")).where("n_records > 0").select("finding", "n_records", F.array_join(F.transform("_r", lambda x: x["t"]), ",").alias("refs"))


def _slug(c):
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def resolved(citations: DataFrame, sections: DataFrame) -> DataFrame:
    """Document citations (document, section) with the reason why each is dropped, null if it stands.

    sections: (document, section, title). A document is found by its name, else whatever its letters' case; a section
    by its key, its number without a mark before it, its title's slug or a part of its title. A document's sections
    are gathered in one row, so a citation meets its document once.
    """
    own = sections.groupBy("document").agg(F.collect_list(F.struct("section", "title")).alias("parts"))
    named = own.groupBy(F.lower("document").alias("_name")).agg(F.sort_array(F.collect_list(F.struct("document", "parts"))).alias("_docs"))
    out = citations.join(named, F.lower("document") == F.col("_name"), "left")
    same = F.filter("_docs", lambda d: d["document"] == F.col("document"))
    doc = F.when(F.size(same) > 0, F.get(same, F.lit(0))).otherwise(F.get("_docs", F.lit(0)))
    low = F.lower(F.trim(F.coalesce("section", F.lit(""))))
    number = F.regexp_replace(low, "^[§ ]+", "")
    fits = lambda p: (p["section"] == F.col("section")) | (F.lower(p["section"]) == number) | (_slug(p["title"]) == _slug(low)) | ((low != "") & F.lower(p["title"]).contains(low))
    found = F.coalesce(F.exists(doc["parts"], fits), F.lit(False))
    return out.withColumn("dropped", F.when(F.col("_name").isNull(), "document_not_loaded").when(~found, "section_not_found")).drop("_name", "_docs")
