"""Phrase collocations by Apriori passes: a pass counts k-grams only where both (k-1)-grams in them are frequent.

Each pass reads the texts once. A task numbers its words, finds the positions whose two overlapping (k-1)-grams may be
frequent with array operations, and counts k-grams a block of words at a time; Spark sums the blocks and keeps the
frequent ones as the level's table. What the next pass must know of a level is broadcast as a bitmap of hashed grams:
its size has a fixed limit whatever the corpus, and a false hit only has a gram counted that the sum then drops, so
levels are exact. Scores need the frequent grams alone, for every part of a frequent phrase is frequent itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read, tune

LEAST, WORDS, TOP, SHARE, SALTS = 10, 3, 2000, 50, 32
#: Words that a task counts at once, distinct words that it numbers at once, and the bitmap's bits: at least, a frequent gram, at most.
BLOCK, NUMBERED, BITS_LEAST, BITS_EACH, BITS_MOST = 2_000_000, 300_000, 1 << 16, 16, 1 << 26
GAP = b"."  # ends a piece and so is no word
ENDS = re.compile(rb"[.,;:!?\n-\r]+")
MIX, FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\t" + word)


def cells_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap's positions of gram hashes; bits is a power of two."""
    return ((hashes ^ (hashes >> np.uint64(29))) * FOLD) >> np.uint64(65 - bits.bit_length())


def held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = cells_of(hashes, len(bitmap) * 64)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(level: DataFrame, most: int = BITS_MOST) -> np.ndarray:
    """A bitmap of a level's grams. Tasks set bits, Spark joins them by or; the driver sees at most `most` bits."""
    bits = min(most, max(BITS_LEAST, 1 << (BITS_EACH * level.count()).bit_length()))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, phrase in zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "phrase"))):
                h = 0
                for word in phrase.split(b" "):
                    h = (h * int(MIX) + word_hash(lang, word)) & 0xFFFFFFFFFFFFFFFF
                hashes.append(h)
            if hashes:
                at = np.unique(cells_of(np.array(hashes, np.uint64), bits))
                cell, first = np.unique(at >> np.uint64(6), return_index=True)
                values = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(values.view(np.int64))], names=["cell", "bits"])

    found = level.select("lang", "phrase").mapInArrow(cells, "cell bigint, bits bigint").groupBy("cell").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


class Block:
    """Words of one language as numbers in order, 0 where a piece ends."""

    def __init__(self, lang: bytes):
        self.lang, self.numbers, self.parts, self.size = lang, {GAP: 0}, [], 0

    def add(self, text: bytes) -> None:
        numbers = self.numbers
        words = ENDS.sub(b" . ", text.lower()).split()  # lower() and split() of bytes know ASCII alone
        ids = [numbers.setdefault(w, len(numbers)) for w in words]
        ids.append(0)
        self.parts.append(np.array(ids, np.int32))
        self.size += len(ids)

    def full(self) -> bool:
        return self.size >= BLOCK or len(self.numbers) > NUMBERED

    def grams(self, k: int, bitmaps: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
        """The k-grams of which both (k-1)-grams may be frequent, and how often each is here; for one word also '', for all words."""
        ids, names = np.concatenate(self.parts).astype(np.int64), list(self.numbers)
        self.parts.clear()
        words = pa.array([b"", *names[1:]], pa.binary())
        if k == 1:
            n = np.bincount(ids, minlength=len(words))
            n[0] = n.sum() - n[0]
            return words, n
        hashes = np.array([word_hash(self.lang, w) for w in names], np.uint64)
        may = held(bitmaps[0], hashes)
        may[0] = False
        ok, own, code, levels = may[ids], hashes[ids], ids, []  # of the gram that starts at each position: may it be frequent, its hash, its number
        for size in range(2, k + 1):
            at = np.flatnonzero(ok[:-1] & ok[1:])  # both overlapping grams
            last = ids[size - 1 :]
            at = at[at < len(last)]
            grams = (code[at] << 32) | last[at]
            if size == k:
                kinds, n = np.unique(grams, return_counts=True)
                columns = []
                for level in (kinds, *reversed(levels)):  # a gram's number leads to its first words' gram
                    columns.append(words.take(pa.array(level[kinds] & 0xFFFFFFFF if columns else kinds & 0xFFFFFFFF)))
                    kinds = (level[kinds] if len(columns) > 1 else kinds) >> 32
                columns.append(words.take(pa.array(kinds)))
                return pc.binary_join_element_wise(*reversed(columns), b" "), n
            kinds, inverse = np.unique(grams, return_inverse=True)
            levels.append(kinds)
            mixed = own[: len(last)] * MIX + hashes[last]
            ok, code = np.zeros(len(last), bool), code[: len(last)].copy()
            ok[at] = held(bitmaps[size - 1], mixed[at])
            code[at], own = inverse, mixed
        raise AssertionError("k is at least 1")


def counted(docs: DataFrame, k: int, bitmaps: list[np.ndarray]) -> DataFrame:
    """(lang, phrase, n) of the k-grams that may be frequent, summed over all documents; k = 1 has n of all words as phrase ''."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def out(block: Block) -> Iterator[pa.RecordBatch]:
        phrases, n = block.grams(k, shared.value)
        for at in range(0, len(phrases), 100_000):
            part = phrases[at : at + 100_000].cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([block.lang.decode()] * len(part), pa.string()), part, pa.array(n[at : at + 100_000], pa.int64())], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[bytes, Block] = {}
        held_words = 0
        for batch in batches:
            for lang, text in zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "text"))):
                block = blocks.get(lang) or blocks.setdefault(lang, Block(lang))
                before = block.size
                block.add(text)
                held_words += block.size - before
                if block.full() or held_words > BLOCK:  # many languages share one bound: the largest block goes
                    lang = max(blocks, key=lambda x: blocks[x].size)
                    held_words -= blocks[lang].size
                    yield from out(blocks.pop(lang))
        for block in blocks.values():
            yield from out(block)

    told = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return told.mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def levels(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> list[DataFrame]:
    """The table of each level: (lang, phrase, n) with n >= least; the first also holds each language's words as phrase ''."""
    tune(docs.sparkSession)
    tables, bitmaps = [], []
    for k in range(1, words + 1):
        if k > 1:
            bitmaps.append(bitmap_of(tables[-1].where("phrase <> ''")))
        tables.append(cut(counted(docs, k, bitmaps).where((F.col("n") >= least) | (F.col("phrase") == ""))))
    return tables


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int | None = TOP, share: int = SHARE) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null lang is 'und'; a language without candidates has no rows, an empty table none.
    Texts of any length are read whole; repeated rows count each time; ties of score go by a, then by phrase. Columns
    of docs other than text and lang are not read. Counts may have up to 14 digits; beyond, the session's decimal
    overflow holds (an error in its default mode). Without `top` all phrases are returned.
    """
    tables = levels(docs, words, least)
    parts = tables[0].where("phrase <> ''")
    for t in tables[1:-1]:
        parts = parts.unionByName(t)
    candidates = tables[1]
    for t in tables[2:]:
        candidates = candidates.unionByName(t)
    candidates = candidates.withColumnRenamed("n", "a").withColumn("_w", F.split("phrase", " "))
    size = F.size("_w")
    joined = lambda start, n: F.array_join(F.slice("_w", start, n), " ")
    cuts = candidates.withColumn("_k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "_k", joined(F.lit(1), F.col("_k")).alias("_first"), joined(F.col("_k") + 1, size - F.col("_k")).alias("_rest"))
    left = parts.select("lang", F.col("phrase").alias("_first"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("_rest"), F.col("n").alias("r"))
    exact = "(cast(1000000 as decimal(7,0)) * cast(a as decimal(14,0)) * cast(a as decimal(14,0))) div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))"
    scored = cuts.join(left, ["lang", "_first"]).join(right, ["lang", "_rest"]).withColumn("score", F.expr(exact))
    scored = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "_k", "l", "r")).alias("_low"))
    # the most frequent longer candidate around each phrase
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))))
    around = candidates.where(size > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("_longer")).groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "_low.l", "_low.r", "_low.score")
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    if top:  # the best of each of SALTS parts of a language first: what one task ranks is bounded, whatever the corpus
        kept = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("_r", rank("lang", "_salt")).where(F.col("_r") <= top)
    ranked = kept.withColumn("rank", rank("lang"))
    ranked = ranked.where(F.col("rank") <= top) if top else ranked
    ranked = ranked.join(tables[0].where("phrase = ''").select("lang", "n"), "lang")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir):
    return collocations(read(spark, sf_dir, "documents").select("text", "lang"))


def op12_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT unnest([1, 2, 3]) AS k),
starts AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM starts GROUP BY 1, 2, 3),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidate AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {LEAST}),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM candidate),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.j, x.n AS l, y.n AS r, ((1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidate WHERE k = 3),
around AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY 1, 2),
kept AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, t.n, s.score FROM lowest s JOIN total t ON t.lang = s.lang LEFT JOIN around o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE o.longer IS NULL OR 100 * o.longer < {SHARE} * s.a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= {TOP}
"""
