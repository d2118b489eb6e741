"""The corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of `documents`; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import language_id, line_runs, packing, partenum, pii
from trialspark.llm.common import mark, read, release, remove_path, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes).get("n_chars", "bigint")
    return docs.withColumn("n_chars", F.char_length("text").cast(kind)).select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told stay; null texts, texts without a letter and undecided ones go.

    Without any row of a known language there is nothing to tell languages by, and all texts with a letter stay. A
    null doc_id is not held out. Texts of any length are read whole; repeated rows are judged alike, ties go to the
    first language by name; an empty table gives none.
    """
    model = language_id.train(docs.where(~language_id.held_out()))
    if not model[0]:
        return docs.where(F.col("text").rlike(r"(?U)[^\W\d_]")).select(*COLUMNS)
    scored = language_id.identify(docs, model)
    return scored.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= language_id.MIN_SCORE)).select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays, if need be with an empty text, which null becomes too.

    Repeated rows count as documents of their own; texts of any length are read whole; an empty table gives none.
    """
    return _documents(line_runs.dedup_lines(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared shingles the first row by doc_id (nulls last), then by a hash of its text, stays.

    Rows are told apart by doc_id and text: an unlinked row stays whatever else its doc_id has, and of rows equal in
    both one stays. Rows without words (null and empty texts too) all stay; an empty table gives none.
    """
    return partenum.keep_first(docs).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes <KIND>; every document stays, a null text null; repeated rows are redacted alike.

    Texts of any length are read whole; of overlapping spans the union goes; an empty table gives none.
    """
    return _documents(pii.find(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences.

    Null and empty texts are one piece of the separator; repeated rows are packed one by one; ties of length go by a
    hash of the document; long texts are cut at the capacity; an empty table gives none.
    """
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_common_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL has neither the classifiers nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage wrote is removed once the next has read it; the last one's rows stay."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, since = scratch_path(spark, name), mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, since)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
