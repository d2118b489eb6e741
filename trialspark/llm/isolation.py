"""Quality rules by an isolation forest on rule statistics.

Statistics of each text (word counts and lengths, symbols, repeated lines and words, case, digits) are isolated
by random axis-parallel splits; short mean path lengths mean anomaly. The forest is grown on labelled clean
rows, and the threshold is set on other labelled rows of both kinds. All statistics are of the whole text; the share of
distinct words, which falls with length, is the mean over windows of WINDOW words. How far the lowest window falls
below that mean, beyond MARGIN, tells texts that are junk in part: it is nought in whole texts, so its range is taken as
at least 1, and the trees draw it DRAWN times as often as another statistic.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_STR, hash_share, map_rows, read, schema_with, texts_of, tune, with_columns

TREES, SUBSAMPLE, TRAIN_DOCS, SEED, CLEAN_LOSS, MARGIN, DRAWN, DEEPER = 100, 256, 6_000, 7, 0.002, 0.1, 4, 4
SYMBOLS, SPAN, WINDOW = "#*$%&|<>", 8, 2000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "distinct_share", "longest_word", "stutter_share", "distinct_drop")
WEIGHTS = (*[1] * (len(FEATURES) - 1), DRAWN)


def distinct_shares(words: list) -> list[float]:
    """The share of distinct words in each window: windows start every half window, and the last ends with the text."""
    n = len(words)
    starts = [*range(0, n - WINDOW, WINDOW // 2), n - WINDOW] if n > WINDOW else [0]
    return [len(set(words[i : i + WINDOW])) / max(1, min(n, WINDOW)) for i in starts]


def rule_counts(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts of the contract and the forest's features."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split: exactly \x20 and \x09-\x0D
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACE_STR)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACE_STR)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    ids = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    if n > SPAN:
        window = np.zeros(n - SPAN + 1, np.uint64)
        for j in range(SPAN):
            window = window * np.uint64(0x9E3779B97F4A7C15) + ids[j : n - SPAN + 1 + j]
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        if same.any():
            twice = np.zeros(len(window), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            ends = np.zeros(n + 1, np.int64)
            ends[: len(window)] += twice
            ends[SPAN : SPAN + len(window)] -= twice
            repeat = int((np.cumsum(ends)[:n] > 0).sum())
    size = max(1, chars)
    codes = np.frombuffer(raw, np.uint8)
    held = np.bincount(codes, minlength=256) if len(raw) else np.zeros(256, int)
    upper, lower, digits = int(held[65:91].sum()), int(held[97:123].sum()), int(held[48:58].sum())
    punct = int(held[33:48].sum() + held[58:65].sum() + held[91:97].sum() + held[123:127].sum())
    longest = max(map(len, words), default=0)
    distinct = distinct_shares(words)
    return [n, chars, symbols, dup, repeat], [
        math.log1p(n), chars / max(1, n), symbols / size, dup / max(1, len(lines)), repeat / max(1, n), upper / max(1, upper + lower), digits / size, punct / size,
        sum(distinct) / len(distinct), math.log1p(longest), float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        max(0.0, 1 - min(distinct) / (sum(distinct) / len(distinct)) - MARGIN) if n else 0.0,
    ]


def path_norm(n: float) -> float:
    """The mean path length of unsuccessful searches among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Trees as arrays: the feature (-1 at a leaf), the split, the children, and at leaves the path length.

    A split falls anywhere from a tenth of the feature's whole range below a node's rows to as far above them,
    so a feature that is constant in the grown rows still cuts off what differs in it, after a short path.
    """

    def __init__(self, rows: np.ndarray, ranges: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED, weights=None):
        rng, self.margin = np.random.default_rng(seed), MARGIN * ranges
        self.drawn = np.array(weights if weights is not None else [1] * rows.shape[1]) * (self.margin > 0)
        self.depth = max(1, math.ceil(math.log2(max(2, min(subsample, len(rows))))) + DEEPER)  # deeper than usual: splits of a constant statistic part nothing
        self.norm = max(1.0, path_norm(min(subsample, len(rows))))
        self.trees = [self.grow(rows[rng.choice(len(rows), min(subsample, len(rows)), replace=False)], rng) for _ in range(trees)]

    def grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, split, left, right, path = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            at = len(feature)
            for column, value in ((feature, -1), (split, 0.0), (left, at), (right, at), (path, depth + path_norm(len(part)))):
                column.append(value)
            if depth < self.depth and len(part) > 1 and self.drawn.any():
                k = int(rng.choice(len(self.drawn), p=self.drawn / self.drawn.sum()))
                low, high = part.min(axis=0) - self.margin, part.max(axis=0) + self.margin
                feature[at], split[at] = k, float(rng.uniform(low[k], high[k]))
                goes = part[:, k] < split[at]
                left[at] = node(part[goes], depth + 1)
                right[at] = node(part[~goes], depth + 1)
            return at

        node(rows, 0)
        return np.array(feature), np.array(split), np.array(left), np.array(right), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1: the higher, the sooner a row is isolated."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                k = feature[at]
                inner = k >= 0
                if not inner.any():
                    break
                goes = rows[every, np.maximum(k, 0)] < split[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            total += path[at]
        return 2.0 ** (-total / (len(self.trees) * self.norm))


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 20 or 100 * n_repeat > 30 * n_words


def calibrate(scores: np.ndarray, clean: np.ndarray, loss: float = CLEAN_LOSS) -> float:
    """The least threshold that loses at most that share of clean labelled rows and catches most of the others."""
    good, bad = np.sort(scores[clean]), scores[~clean]
    if not len(good):
        return 1.0
    floor = good[min(len(good) - 1, int(math.ceil((1 - loss) * len(good))))]
    above = bad[bad > floor]
    return float((floor + above.min()) / 2) if len(above) else float(floor)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[Forest | None, float]:
    """A forest on clean labelled rows, and its threshold.

    At most about train_docs labelled rows are used, chosen by a hash of doc_id; a doc_id labelled twice has its lower
    quality. The forest grows on every other clean row, and the threshold is set on the rest and on the junk (one clean row serves for both). Without a clean row all labelled ones stand for clean, and without a
    labelled one as many documents chosen alike. Rows that the base rules fail are left out: they never reach the
    forest's verdict. If that leaves none, there is no forest.
    """

    def measured(rows: DataFrame) -> list:
        def stats(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [rule_counts(t) for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array([base_failed(c[0], c[4]) for c, _ in rows]), pa.array([f for _, f in rows], pa.list_(pa.float64()))], names=["doc_id", "quality", "failed", "f"])

        return sorted(map_rows(rows.select("doc_id", "quality", "text"), stats, "doc_id bigint, quality int, failed boolean, f array<double>").where("not failed").drop("failed").collect())

    def some(df: DataFrame) -> DataFrame:
        share = min(1.0, train_docs / max(1, df.count()))
        return df.where(hash_share("doc_id", share)) if share < 1 else df

    told = some(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(told), "doc_id")) or measured(some(docs.where("doc_id is not null").select("doc_id", "text")).withColumn("quality", F.lit(1)))
    if not rows:
        return None, 1.0
    data, clean = np.array([r.f for r in rows]), np.array([r.quality == 1 for r in rows])
    clean |= not clean.any()
    grown = np.flatnonzero(clean)[::2]
    apart = np.setdiff1d(np.arange(len(rows)), grown) if clean.sum() > 1 else np.arange(len(rows))
    forest = Forest(data[grown], np.maximum(np.ptp(data, axis=0), [*[0.0] * (len(FEATURES) - 1), 1.0]), weights=WEIGHTS)
    return forest, calibrate(forest.score(data[apart]), clean[apart])


def judge(docs: DataFrame, model: tuple) -> DataFrame:
    """docs with the five counts, base_failed, anomaly (0 to 1) and kept.

    A null or empty text has no words and fails the base rules; without a forest what passes those is kept. A score
    equal to the threshold is kept. Texts of any length are read whole; repeated rows are judged alike; an empty table
    gives none; columns of docs with these names are replaced.
    """
    tune(docs.sparkSession)
    docs = docs.drop(*COUNTS, "base_failed", "anomaly", "kept")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        forest, threshold = shared.value
        rows = [rule_counts(t) for t in texts_of(batch)]
        failed = [base_failed(c[0], c[4]) for c, _ in rows]
        scores = np.zeros(len(rows))
        if forest and rows:
            scores = forest.score(np.array([f for _, f in rows]))
        columns = {k: pa.array([c[i] for c, _ in rows], pa.int64()) for i, k in enumerate(COUNTS)}
        return with_columns(batch, **columns, base_failed=pa.array(failed), anomaly=pa.array(scores), kept=pa.array([not f and bool(s <= threshold) for f, s in zip(failed, scores)]))

    return map_rows(docs, add, schema_with(docs, **dict.fromkeys(COUNTS, "bigint"), base_failed="boolean", anomaly="double", kept="boolean"))


def op2(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return judge(docs.select("doc_id", "text"), model).select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
