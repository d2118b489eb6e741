"""Language identification: multinomial naive Bayes over hashed character n-grams.

n-grams of one to three code points of the lower-cased text (whatever is no letter is one separator) are hashed
into a fixed number of columns; the log-probability matrix, languages by columns, is broadcast, and a batch of
texts is scored in numpy by gathering matrix rows and summing them by document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, read, schema_with, texts_of, tune, with_columns

COLUMNS, TRAIN_DOCS, SMOOTHING, UNKNOWN, MIN_SCORE = 1 << 15, 12_000, 0.5, "und", 0.5
LETTER = re.compile(r"[^\W\d_]")
CHUNK = 1 << 18


def features(texts: list[str], columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams' columns for all texts, one after the other, and how many each text has."""
    # A text is its lower-cased code points between separators (0); runs of separators are one.
    raw = np.frombuffer("\n".join([*(t.lower().replace("\n", " ") for t in texts), ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.cumsum(raw == 10)
    doc[raw == 10] -= 1
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 170)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    points, doc = np.where(letter, raw, 0)[keep].astype(np.uint64), doc[keep]
    mask, out, at = np.uint64(columns - 1), [], []
    one = points * np.uint64(0x9E3779B97F4A7C15)
    a, b = points[:-1], points[1:]
    two = (a * np.uint64(0xC2B2AE3D27D4EB4F) + b * np.uint64(0x165667B19E3779F9)) * np.uint64(0x9E3779B97F4A7C15)
    three = ((a[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + b[:-1]) * np.uint64(0x27D4EB2F165667C5) + b[1:]) * np.uint64(0x9E3779B97F4A7C15)
    same2, same3 = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    for gram, ok, where in ((one, points > 0, doc), (two, ((a > 0) | (b > 0)) & same2, doc[:-1]), (three, (b[:-1] > 0) & same3, doc[:-2])):
        out.append(((gram[ok] >> np.uint64(40)) & mask).astype(np.int64))
        at.append(where[ok])
    order = np.argsort(np.concatenate(at), kind="stable")
    return np.concatenate(out)[order], np.bincount(np.concatenate(at), minlength=len(texts))


def groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about CHUNK characters together, so that arrays stay small."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > CHUNK:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, columns: int = COLUMNS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (columns x languages) and log-priors from rows with a non-null lang.

    At most about train_docs rows are counted, as many of each language, chosen by a hash of doc_id (and of the text
    where that is null); all rows of a language that has fewer. Priors are of all rows, and every language with a row
    is learned. Tasks return count matrices only.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    every = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    each = max(1, train_docs // max(1, len(every)))
    shares = {k: min(1.0, each / n) for k, n in every.items()}
    draw = F.pmod(F.xxhash64(F.lit("share"), F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(1 << 20)) / (1 << 20)
    most = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]) if any(x < 1 for x in shares.values()) else None
    chosen = labelled if most is None else labelled.where(draw < F.try_element_at(most, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = texts_of(batch), batch.column("lang").to_pylist()
            for start, some in groups(texts):
                index, sizes = features(some, columns)
                for lang, part in zip(langs[start : start + len(some)], np.split(index, np.cumsum(sizes)[:-1])):
                    found.setdefault(lang, np.zeros(columns, np.int64))
                    found[lang] += np.bincount(part, minlength=columns)
        for lang, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "at", "n"])

    langs = sorted(every)
    if not langs:
        return [], np.zeros((columns, 0), np.float32), np.zeros(0)
    held = chosen.select("text", "lang").mapInArrow(count, "lang string, at bigint, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()  # at most languages * columns rows
    matrix = np.full((columns, len(langs)), SMOOTHING)
    of = {k: i for i, k in enumerate(langs)}
    matrix[held.column("at").to_numpy(), [of[k] for k in held.column("lang").to_pylist()]] += held.column("n").to_numpy()
    prior = np.log(np.array([every[k] for k in langs], dtype=float))
    return langs, np.log(matrix / matrix.sum(axis=0)).astype(np.float32), prior - prior.max()


def score_texts(texts: list[str], langs: list[str], matrix: np.ndarray, prior: np.ndarray) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its probability; n-grams overlap, so their evidence is tempered."""
    names, scores = [], []
    for _, some in groups(texts):
        index, sizes = features(some, len(matrix))
        total = np.zeros((len(some), max(1, len(langs))))
        full = sizes > 0
        if langs and full.any():
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            total[full] = np.add.reduceat(matrix[index], starts, axis=0, dtype=np.float64) / 3
        total[:, : len(langs)] += prior
        top = total.max(axis=1, keepdims=True)
        share = np.exp(total - top)
        share /= share.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        for t, i, row in zip(some, best, share):
            known = bool(langs) and LETTER.search(t) is not None
            names.append(langs[i] if known else UNKNOWN)
            scores.append(float(row[i]) if known else 0.0)
    return names, scores


def identify(docs: DataFrame, model: tuple) -> DataFrame:
    """docs with lang_pred and score (0 to 1); null texts and texts with no letter are `und` with score 0.

    Every row, one with a null doc_id too, is scored on its whole text, however long; ties go to the first language
    by name; repeated rows are scored alike; without a learned language all is `und`; an empty table gives none;
    columns of docs named lang_pred or score are replaced.
    """
    tune(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = score_texts(texts_of(batch), *shared.value)
        return with_columns(batch, lang_pred=pa.array(names, pa.string()), score=pa.array(scores, pa.float64()))

    return map_rows(docs, add, schema_with(docs, lang_pred="string", score="double"))


def held_out():
    """Whether a row is kept from training; one without a doc_id isn't."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def op4(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
