"""How quality filters interact: what each removes in every order, and whose removals others would have made.

Duplicates come from a sort: rows are range-sorted by the text's fingerprint, the whole text and doc_id, and each is
compared with the row before it. Ranges end within a group of copies too (doc_id takes part in the range key), so a
group of any size is spread; each task says what its last group was, and rows that open a task are judged again by it.
The bits of a document's failures make a mask; counters by part and mask are additive, and every order's report is
summed from them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read, tune

FILTERS = "ABCDE"
SYMBOLS = re.compile(rb"[#$%&*|]")
UPPER, CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))  # bytes of capitals, and those that continue a character
DUPLICATE = 1 << FILTERS.index("E")


def text_mask(raw: bytes) -> int:
    """The bits of filters A to D that a text fails."""
    words = raw.split()  # bytes.split: exactly \x20 and \x09-\x0D
    upper, points = len(raw) - len(raw.translate(None, UPPER)), len(raw.translate(None, CONTINUED))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * upper > 5 * points) << 2 | (SYMBOLS.search(raw) is not None) << 3


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (fp, text, doc_id, nulls last) -> their masks; at the end, the first doc_id of each text of the last fp.

    `head` holds the digest of rows of the task's first fp that no row here makes a duplicate.
    """
    names = ("part", "doc_id", "mask", "fp", "head", "last")
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    opening, fp, text, mask, first = None, None, None, 0, None
    texts: dict[str, int] = {}  # of the fp at hand: one text but for collisions
    for batch in batches:
        out = tuple([] for _ in names)
        rows = zip(batch.column("fp").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("doc_id").to_pylist(), batch.column("part").to_pylist())
        for f, raw, doc, part in rows:
            if opening is None:
                opening = f
            if f != fp or raw != text:
                if text is not None and f == fp and first is not None:
                    texts[digest(text)] = first
                elif f != fp:
                    texts = {}
                fp, text, mask, first = f, raw, text_mask(raw), doc  # doc is the text's least here; null if all are
            fails = first is not None and doc is not None and doc > first
            head = digest(raw) if f == opening and not fails and doc is not None else None
            for column, value in zip(out, (part, doc, mask | DUPLICATE if fails else mask, f if head else None, head, False)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
    if text is not None:
        if first is not None:
            texts[digest(text)] = first
        if texts:
            n = len(texts)
            columns = ([None] * n, list(texts.values()), [0] * n, [fp] * n, list(texts), [True] * n)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def failure_masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """(part, doc_id, mask): one row a row of docs; the bits of mask are the filters it fails, A the lowest.

    Null and empty texts fail A alone, and E if a smaller doc_id has the empty text too. A row is a duplicate if a
    smaller doc_id has its text: rows repeated under one doc_id aren't each other's, and a null doc_id takes no part.
    Texts of any length are read whole; an empty table gives none; other columns of docs are not read.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("fp", F.xxhash64("text"))
    # the ranges' sample holds (fp, doc_id), never a text
    rows = rows.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", F.asc_nulls_last("doc_id"))
    made = cut(rows.select("fp", "text", "doc_id", "part").mapInArrow(compared, "part string, doc_id bigint, mask int, fp bigint, head string, last boolean"))
    ends = made.where("last").groupBy("fp", "head").agg(F.min("doc_id").alias("_first"))  # at most one text a task, but for collisions
    told = made.where("not last and head is not null").join(ends, ["fp", "head"], "left")
    told = told.withColumn("mask", F.when(F.col("_first") < F.col("doc_id"), F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")))
    return made.where("not last and head is null").select("part", "doc_id", "mask").unionByName(told.select("part", "doc_id", "mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive counters; counters of two corpora that share no text add up to those of both.

    A doc_id that is labelled more than once is good or toxic if one of its labels says so.
    """
    told = labels.where("quality = 1 or toxic = 1").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    zero, total = F.lit(0).cast("bigint"), lambda c: F.sum(c).alias(c)
    every = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    lost = masks.join(told, "doc_id").groupBy("part", "mask").agg(total("good"), total("toxic")).select("part", "mask", zero.alias("n"), "good", "toxic")
    return every.unionByName(lost).groupBy("part", "mask").agg(total("n"), total("good"), total("toxic"))


def report(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part, order of the filters and step, from the counters by mask.

    What a step does depends on its filter and on which filters came before, not on their order: these few settings
    are summed first, then written out for all orders.
    """
    bit = {f: 1 << i for i, f in enumerate(filters)}
    orders = [("".join(o), k + 1, bit[f], sum(bit[x] for x in o[:k])) for o in permutations(filters) for k, f in enumerate(o)]
    settings = sorted({(own, before) for *_, own, before in orders})
    many = len(orders) // len(filters)
    each = counts.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(a).alias("own"), F.lit(b).alias("before")) for a, b in settings]))).select("*", "_at.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    here = fails & ~earlier
    total = lambda when, what: F.sum(F.when(when, F.col(what)).otherwise(F.lit(0))).cast("bigint")
    summed = each.groupBy("part", "own", "before").agg(
        total(~fails & ~earlier, "n").alias("kept"), total(here, "n").alias("removed"), total(fails & earlier, "n").alias("redundant"),
        total(F.col("mask") == F.col("own"), "n").alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
        # of the orders, the filter comes first among those that a document fails in one of as many
        F.sum(F.when(fails, F.col("n") * F.expr(f"{many} div bit_count(mask)")).otherwise(F.lit(0))).cast("bigint").alias("shapley"),
    )
    steps = counts.sparkSession.createDataFrame(orders, "filter_order string, step int, own int, before int")
    return summed.join(F.broadcast(steps), ["own", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13(spark, sf_dir):
    masks = failure_masks(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return report(counters(masks, read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


def op13_sql() -> str:
    return r"""
WITH base AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
masks AS (
  SELECT part, doc_id,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM base),
told AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masks LEFT JOIN told USING (doc_id) GROUP BY 1, 2),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step))
SELECT part, filter_order, step,
  sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & own <> 0 THEN n * (120 // bit_count(mask::INT)) ELSE 0 END)::BIGINT AS shapley
FROM counts, steps GROUP BY 1, 2, 3
"""
