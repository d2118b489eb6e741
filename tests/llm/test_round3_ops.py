"""Order-preserving packing, collocations and the filter audit against brute force, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.llm import collocations, filter_audit, order_packing
from trialspark.llm.tokens import ByteWords, library

ODD = [(1, None), (2, ""), (None, "Hello world. \n\nHello  world!"), (4, "x" * 30_000), (5, " \t"), (5, " \t"), (None, None), (7, "a<|endoftext|>b It's 3.5 ÀÉ \xa0 é \x00 ok!! " * 40), (8, "one two " * 5000), (9, "End. " * 3000)]
SCHEMA = "doc_id bigint, text string, lang string, source string, start string, mask string, phrase string, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, None if i % 3 == 0 else "en", None if i % 2 else "s", "own", "own", "own", "own") for i, (d, t) in enumerate(ODD)], SCHEMA)


def padding(length, capacity):
    return 0 if length & (length - 1) == 0 else capacity - length


def check_packed(rows, docs, capacity):
    """Pieces tile their documents, sequences have no gaps, ids are the library's. rows: with ids."""
    encoder = library(order_packing.VOCABULARY)
    held = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length > 0
        held[r.doc_id].append((r.start, r.length, r.doc_tokens, bytes(r.ids)))
    want = Counter()
    for d, text in docs:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 1]
        want[d, np.array(ids, "<u4").tobytes()] += 1
    if len({d for d, _ in docs}) == len(docs):
        got = Counter()
        for d, pieces in held.items():
            pieces.sort()
            at = 0
            for start, length, tokens, _ in pieces:
                assert start == at and tokens == sum(p[1] for p in pieces)
                at += length
            got[d, b"".join(p[3] for p in pieces)] += 1
        assert got == want
    else:
        assert sum(r.length for r in rows) == sum(len(raw) // 4 * n for (_, raw), n in want.items())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
    lengths = [sum(n for _, n in s) for s in sequences.values()]
    assert max(lengths, default=0) <= capacity
    return sum(padding(n, capacity) for n in lengths) / max(1, sum(lengths))


def test_order_packing_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = order_packing.pack_in_order(docs, with_ids=True).collect()
    assert check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048) < 0.007
    # order: what follows in a task follows in the numbers of sequences and offsets
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    assert all(b.start == a.start + a.length if a.doc_id == b.doc_id else b.start == 0 and a.start + a.length == a.doc_tokens for a, b in zip(rows, rows[1:]))
    encoder = library(order_packing.VOCABULARY)
    cut = [encoder.decode(np.frombuffer(r.ids, "<u4").tolist()).rstrip("\"')]") for r in rows if r.start + r.length < r.doc_tokens]
    assert sum(t.endswith((".", "!", "?", "\n")) for t in cut) > 0.9 * len(cut)  # the others are within sentences of hundreds of tokens, or at a task's end


@pytest.mark.parametrize("capacity", [16, 100, 2048])
def test_order_packing_edges(spark, odd, capacity):
    rows = order_packing.pack_in_order(odd.repartition(3), capacity, with_ids=True, stretch=5000).collect()
    check_packed(rows, ODD, capacity)
    rows = order_packing.pack_in_order(odd.where("doc_id in (1, 2, 4, 7, 8, 9)").coalesce(1), capacity, with_ids=True, stretch=5000).collect()
    assert check_packed(rows, [x for x in ODD if x[0] in (1, 2, 4, 7, 8, 9)], capacity) < 0.05
    assert order_packing.pack_in_order(odd.limit(0)).count() == 0
    assert odd.count() == len(ODD)


def brute_cost(at, penalty, capacity):
    at, cost = [0, *at], [0]
    for j in range(1, len(at)):
        cost.append(min(cost[i] + padding(at[j] - at[i], capacity) for i in range(j) if at[j] - at[i] <= capacity) + penalty[j - 1] + order_packing.WINDOW)
    return cost[-1]


def test_cheapest_is_the_least_cost():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([8, 13, 64, 100])
        at = np.cumsum([rng.randint(1, rng.choice([3, capacity])) for _ in range(rng.randint(1, 60))])
        penalty = np.array([rng.choice([0, 3, 8, 64]) for _ in at])
        path = order_packing.cheapest(at, penalty, capacity)
        ends = [0, *[int(at[j]) for j in path]]
        assert ends[-1] == at[-1] and all(0 < b - a <= capacity for a, b in zip(ends, ends[1:]))
        got = sum(padding(b - a, capacity) for a, b in zip(ends, ends[1:])) + sum(int(penalty[j]) + order_packing.WINDOW for j in path)
        assert got == brute_cost(at.tolist(), penalty.tolist(), capacity)


def test_byte_words_are_the_librarys_ids():
    rng, encoder, words = random.Random(5), library(order_packing.VOCABULARY), ByteWords(order_packing.VOCABULARY, most=50)
    units = ["a", "It's", "don't", "3.14", "É", "naïve", "日本語", "\n", "\t", " ", "  ", "\xa0", "\x1c", "<|endoftext|>", "😀", "...", "x" * 150, "end.\nStart", "'s", " "]
    for _ in range(600):
        text = "".join(rng.choice(units) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == encoder.encode(text, add_special_tokens=False).ids, text


def brute_phrases(rows, words=3, least=10, top=2000, share=50):
    counts = defaultdict(Counter)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in range(1, words + 1):
                for i in range(len(w) - k + 1):
                    counts["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longer = defaultdict(int)
        for g, a in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longer[g[i : i + k]] = max(longer[g[i : i + k]], a)
        scored = []
        for g, a in candidates.items():
            if 100 * longer[g] < share * a:
                score, _, left, right = min((10**6 * a * a // (f[g[:j]] * f[g[j:]]), j, f[g[:j]], f[g[j:]]) for j in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def test_collocations_by_brute_force(spark, odd, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").unionByName(odd.select("text", "lang"))
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == brute_phrases(rows)
    # small blocks, a full bitmap and longer phrases give the same rows
    monkeypatch.setattr(collocations, "BITS_LEAST", 64)
    monkeypatch.setattr(collocations, "bitmap_of", lambda level, f=collocations.bitmap_of: f(level, 64))
    assert sorted(map(tuple, collocations.collocations(docs, words=4, least=5, top=50).collect())) == brute_phrases(rows, 4, 5, 50)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocation_blocks(monkeypatch):
    a, b = collocations.Block(b"en"), collocations.Block(b"en")
    for t in (b"the cat sat. The cat", b"", b"cat  sat\tthe", b"the the the"):
        a.add(t)
        b.add(t)
    words, n = a.grams(1, [])
    assert dict(zip(words.to_pylist(), n.tolist())) == {b"": 11, b"the": 6, b"cat": 3, b"sat": 2}
    every = [np.full(1 << 10, 2**64 - 1, np.uint64)] * 2
    phrases, n = b.grams(3, every)
    assert dict(zip(phrases.to_pylist(), n.tolist())) == {b"the cat sat": 1, b"cat sat the": 1, b"the the the": 1}


def brute_audit(rows, told):
    least = {}
    for _, d, t in rows:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    parts = defaultdict(list)
    for part, d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = ("A" if len(w) < 50 else "") + ("B" if 100 * len(set(w)) < 65 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else "")
        fails += ("D" if re.search(r"[#$%&*|]", t) else "") + ("E" if d is not None and least[t] < d else "")
        parts[part].append((fails, *told.get(d, (0, 0))))
    out = []
    for part, docs in parts.items():
        shapley, steps = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order):
                removed = [x for x in left if f in x[0]]
                earlier = sum(f in x[0] and any(g in x[0] for g in order[:k]) for x in docs)
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(removed)
                steps.append((order, k + 1, len(left), len(removed), earlier, sum(x[0] == f for x in docs), sum(x[1] for x in removed), sum(x[2] for x in removed), f))
        out += [(part, *s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def test_audit_by_brute_force(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic")
    odd_labels = spark.createDataFrame([(4, 1, None), (4, None, 1), (None, 1, 1), (5, 0, 0), (99999, 1, 1)], labels.schema)
    labels = labels.unionByName(odd_labels)
    told = {}
    for r in labels.collect():
        if r.doc_id is not None:
            good, toxic = told.get(r.doc_id, (0, 0))
            told[r.doc_id] = (max(good, int(r.quality == 1)), max(toxic, int(r.toxic == 1)))
    rows = [(r.source or "", r.doc_id, r.text or "") for r in docs.collect()]
    got = filter_audit.report(filter_audit.counters(filter_audit.failure_masks(docs), labels))
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, told)
    assert filter_audit.report(filter_audit.counters(filter_audit.failure_masks(docs.limit(0)), labels)).count() == 0


def test_audit_groups_over_many_tasks(spark):
    """One group of copies over all ranges, repeated doc_ids at their borders, null doc_ids."""
    rows = [(i // 2, "copy") for i in range(3000)] + [(None, "copy")] * 50 + [(i, f"own {i}") for i in range(200)] + [(7, "own 199"), (500, "own 3"), (500, "own 3")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id bigint, text string, source string")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = filter_audit.failure_masks(docs).where(F.col("mask").bitwiseAND(16) > 0).groupBy("doc_id").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = Counter({d: 2 for d in range(1, 1500)})
    want[199] += 1
    want[500] += 2
    assert {r.doc_id: r["count"] for r in got} == want
