"""Sharding, line dedup, packing and language ID against brute force, and their edge cases."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trialspark.llm import language_id, line_runs, packing, shuffle_shards
from trialspark.llm.tokens import library

ODD = [(1, None), (2, ""), (None, "Hello world\n\nHello world"), (4, "x" * 50_000), (5, " \t"), (5, " \t"), (None, None), (7, "<|endoftext|> It's 3.5 ÀÉ İstanbul é \x00 a b ok!!")]
SCHEMA = "doc_id bigint, text string, lang string, shard string, n_lines string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "en", "own", "own", "own") for d, t in ODD], SCHEMA)


def test_shards_law_and_digests(spark, sf):
    rows = shuffle_shards.op5(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
    n = Counter(r.shard for r in rows)
    assert len(n) == 16 and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    assert {(r.doc_id, r.shard, r.slot) for r in shuffle_shards.op5(spark, sf).collect()} == {(r.doc_id, r.shard, r.slot) for r in rows}
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))] != sorted(docs)


def test_shards_edges(spark, odd, tmp_path):
    rows = shuffle_shards.shuffle_shards(odd, 3).collect()
    assert len(rows) == len(ODD) and Counter(r.shard for r in rows) == {0: 3, 1: 3, 2: 2}
    assert shuffle_shards.shuffle_shards(odd.limit(0)).count() == 0
    shuffle_shards.write_shards(odd, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)


def brute_lines(rows, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in line_runs.op1(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute_lines([tuple(r) for r in docs], 10)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_line_dedup_over_batches(spark, odd, tmp_path, limit):
    """Seven files make four batches, so runs are settled and compacted; both ways of dropping agree."""
    rows = [(i, f"Common line {i % 3}\nown {i}\n  COMMON LINE {i % 2}\t\n\nÉ{i % 4}") for i in range(40)] + ODD
    for k in range(7):
        spark.createDataFrame([(d, t, "own") for d, t in rows[k::7]], "doc_id bigint, text string, n_dropped string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    out = line_runs.dedup_lines(spark.read.parquet(str(tmp_path / "docs")), min_docs=9, broadcast_keys=limit)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()), key=str)
    assert got == brute_lines(rows, 9)
    assert line_runs.dedup_lines(odd.limit(0)).count() == 0


def test_packing_matches_the_library(spark, odd):
    name = "word_bpe_49k.json"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(150).unionByName(spark.createDataFrame([(-1 - i, t) for i, (_, t) in enumerate(ODD)], "doc_id bigint, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.pack(docs, with_ids=True).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids) and r.start * 4 == len(ids.get(r.doc_id, b""))
        ids[r.doc_id] = ids.get(r.doc_id, b"") + r.ids
    for d, t in texts.items():
        want = [*library(name).encode(t, add_special_tokens=False).ids, 1]
        assert ids[d] == b"".join(i.to_bytes(4, "little") for i in want), (d, t[:80])
    check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 4096)


def check_sequences(places, capacity):
    by = {}
    for s, o, n in places:
        by.setdefault(s, []).append((o, n))
    for held in by.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_plan_is_best_fit_decreasing():
    import random

    for seed in range(30):
        rng, capacity = random.Random(seed), 60
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 400))), reverse=True)
        rooms = []
        for n in lengths:
            fit = [i for i, r in enumerate(rooms) if r >= n]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(capacity - n)
        runs = packing.plan(Counter(lengths), capacity)
        places, seen = [], Counter()
        for n in lengths:
            rank, seen[n] = seen[n], seen[n] + 1
            _, start, first, each, offset = max(r for r in runs if r[0] == n and r[1] <= rank)
            places.append((first + (rank - start) // each, offset + (rank - start) % each * n, n))
        assert check_sequences(places, capacity) == len(rooms) == len({p[0] for p in places})


def test_packing_edges(odd):
    rows = packing.pack(odd).collect()
    assert sum(r.length == 1 for r in rows) >= 4
    check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    assert packing.pack(odd.limit(0)).count() == 0


def test_language_accuracy(spark):
    rows = language_id.op4(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, odd, sf):
    model = language_id.train(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = language_id.identify(odd, model).select("text", "lang_pred", "score").collect()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    none = language_id.train(odd.where(F.lit(False)))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_one_file_makes_batches_runs_and_compactions(spark, monkeypatch):
    """Whatever the files: four batches, none of which counts (and so shuffles) a key that earlier ones settled, and runs compacted."""
    seen, add = [], line_runs.LineRuns.add

    def watched(self, counts):
        before = {bytes(r.key) for r in self.settled().collect()} if self.runs() else set()
        add(self, counts)
        seen.append((len(before), self.compacted, sum(bytes(r.key) in before for r in counts.select("key").collect())))

    monkeypatch.setattr(line_runs.LineRuns, "add", watched)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 0").select("doc_id", "text")
    rows = line_runs.dedup_lines(docs).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows), key=str) == brute_lines([tuple(r) for r in docs.collect()], 10)
    assert len(seen) == 4 and [c for _, c, _ in seen] == [0, 1, 1, 3] and seen[1][0] > 0 and [n for *_, n in seen] == [0] * 4


def test_a_later_delivery_goes_on_with_the_runs(spark, tmp_path):
    """Two deliveries, the second to reopened levels: its lines are judged by the documents of both."""
    rows = [(i, f"Shared {i % 5}\nown {i}\n") for i in range(60)]
    form = lambda part: spark.createDataFrame(part, "doc_id bigint, text string")
    root = f"file://{tmp_path}/runs"
    first = line_runs.dedup_lines(form(rows[:40]), min_docs=10, root=root).collect()
    assert not any(r.n_dropped for r in first)
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("runs_")]:
        spark.sql(f"DROP TABLE {name}")  # as in another session
    second = line_runs.dedup_lines(form(rows[40:]), min_docs=10, root=root).collect()
    want = {d: n for d, _, n, _ in brute_lines(rows, 10)}
    assert {r.doc_id: r.n_dropped for r in second} == {d: n for d, n in want.items() if d >= 40} and all(r.n_dropped == 1 for r in second)
    line_runs.LineRuns(spark, root=root).close()


def test_keys_settle_by_the_sum_over_runs(spark):
    runs = line_runs.LineRuns(spark, min_docs=10, fanout=4)
    for n in (6, 6, 6):
        runs.add(spark.createDataFrame([(bytearray(b"k"), n), (bytearray(b"r"), 1)], "key binary, n bigint"))
    assert [spark.table(x).where("key = X'6B'").count() for x in runs.runs()] == [1, 1, 0] and runs.settled().count() == 1
    assert sorted((bytes(r.key), r.n) for r in runs.merged(runs.runs()).collect()) == [(b"k", 12), (b"r", 3)]
    runs.add(spark.createDataFrame([(bytearray(b"s"), 1)], "key binary, n bigint"))
    assert runs.compacted == 1 and sorted((bytes(r.key), r.n) for r in spark.table(runs.runs()[0]).collect()) == [(b"k", 12), (b"r", 3), (b"s", 1)]
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("runs_")]


def brute_languages(train, texts, columns):
    """Naive Bayes by counting in dictionaries, n-grams as strings; hash collisions aside it is the same model."""
    import math
    from collections import defaultdict

    def grams(text):
        low = "".join(c if "a" <= c <= "z" or ord(c) >= 170 else "\0" for c in text.lower())
        while "\0\0" in low:
            low = low.replace("\0\0", "\0")
        low = low if low.startswith("\0") else low
        out = [c for c in low if c != "\0"]
        return out + [a + b for a, b in zip(low, low[1:])] + [a + b + c for a, b, c in zip(low, low[1:], low[2:]) if b != "\0"]

    counts, rows = defaultdict(Counter), Counter()
    for text, lang in train:
        counts[lang].update(grams(text))
        rows[lang] += 1
    total = {k: sum(c.values()) + 0.5 * columns for k, c in counts.items()}
    out = []
    for text in texts:
        score = {k: math.log(rows[k]) + sum(math.log((counts[k][g] + 0.5) / total[k]) for g in grams(text)) / 3 for k in rows}
        out.append(max(sorted(score), key=score.__getitem__))
    return out


def test_language_against_plain_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.where("text is not null").collect()
    model = language_id.train(docs, columns=1 << 20)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    want = brute_languages([(r.text, r.lang) for r in rows if r.lang], [r.text for r in rows], 1 << 20)
    letters = [any(c.isalpha() for c in r.text) for r in rows]
    assert all(got[r.doc_id][0] == (w if ok else "und") for r, w, ok in zip(rows, want, letters)) and len(set(want)) > 2


def test_rare_languages_are_learned(spark):
    words = {"aa": "tra lo mi", "bb": "ksh ugh zz"}
    rows = [(i, " ".join([words["aa"]] * 4), "aa") for i in range(400)] + [(1000 + i, " ".join([words["bb"]] * 4), "bb") for i in range(3)] + [(None, "ksh ugh", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), train_docs=20)
    assert model[0] == ["aa", "bb"]
    assert language_id.score_texts(["ksh zz ugh ugh zz", "mi lo tra"], *model)[0] == ["bb", "aa"]


def test_held_out_is_never_null(spark, odd):
    assert odd.select(language_id.held_out().alias("h")).where("h is null").count() == 0
