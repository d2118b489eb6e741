"""The other operators against brute force, SQL or held-out truth, and their edge cases."""

import hashlib
import html
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from trialspark.llm import chunked_bpe, html_crf, isolation, partenum, pii, vector_links
from trialspark.llm.graphs import components
from trialspark.llm.tokens import library

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (None, "Hello world\n\nHello world"), (4, "x" * 50_000), (5, " \t"), (5, " \t"), (6, "a@b.cd " * 4000), (7, "<|endoftext|> It's 3.5 ÀÉ é \x00 a b ok!!"), (8, "one two three"), (9, "ONE two three")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "own", "own") for d, t in ODD], "doc_id bigint, text string, spans string, kept string")


def texts(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


# ---- components


def test_components(spark):  # both ways
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 530)] + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(150)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), few=0).collect()}
    assert got == {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


# ---- op10


def brute_groups(rows, percent=75):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, index, shared = {d: shingles(t) for d, t in rows}, defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    for held in index.values():
        shared.update((a, b) for i, b in enumerate(held) for a in held[:i])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_jaccard_join(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.op10(spark, SF).collect()}
    want = brute_groups(texts(spark).items())
    assert got == want and any(d != c for d, (_, c) in want.items())


def test_jaccard_join_near_the_threshold(spark):
    """Many sizes, few changes more or less than allowed, a passage shared by all, a large group of near copies."""
    rng, rows = random.Random(3), []
    passage = [f"p{i}" for i in range(60)]
    for i in range(160):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(rng.choice((3, 5, 6, 7, 8, 9, 12, 20, 40, 150)))]
        words = words + passage if i % 2 else words
        for _ in range(3):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 99)}"
            if rng.random() < 0.3:
                del copy[-rng.randint(1, max(1, len(copy) // 8)) :]
            rows.append((len(rows), " ".join(copy)))
    big = [f"b{i}" for i in range(200)]
    for i in range(90):
        copy = list(big)
        copy[rng.randrange(200)] = f"c{i}"
        rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.similarity_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_groups(rows)


def test_signatures_find_every_similar_pair():
    """Noted shingles, weak parts and later hashes lose nothing."""
    rng, bands = np.random.default_rng(4), partenum.Bands()
    noted = np.unique(partenum.mix(np.arange(40, dtype=np.uint64)))
    for trial in range(3000):
        size = int(rng.integers(1, 60))
        pool = partenum.mix(rng.choice(400, 90, replace=False).astype(np.uint64) + np.uint64(40 if trial % 3 else 0))
        a = np.unique(pool[:size])
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.75, 1)], pool[size : size + int(rng.integers(0, 1 + size // 4))]]))
        if len(b) and partenum.similar(a, b):
            own = noted if trial % 2 else np.unique(np.concatenate([noted, a[: len(a) // 2]]))
            assert len(np.intersect1d(partenum.signatures(a, own, bands), partenum.signatures(b, own, bands)))


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(7)
    sets = []
    for size in (1, 2, 5, 31, 32, 33, 60, 500, 520, 4000, 5000):
        pool = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        sets += [np.unique(pool), np.unique(pool[: max(1, size * 7 // 8)]), np.unique(pool[: max(1, size * 3 // 4)]), np.unique(np.concatenate([pool[: size // 3], rng.integers(0, 1 << 63, size, dtype=np.uint64)]))]
    known = partenum.Sketches(np.array([len(x) for x in sets]), [partenum.sketch(x).tobytes() for x in sets])
    p, q = np.triu_indices(len(sets), 1)
    may, are = known.may_be_similar(p, q), np.array([partenum.similar(sets[i], sets[j]) for i, j in zip(p, q)])
    assert are.sum() > 10 and not (are & ~may).any()
    assert (may & ~are & (np.minimum(known.n[p], known.n[q]) > 400)).sum() == 0  # large sets that share a third are told apart


def test_verified_runs_longer_than_one(spark, monkeypatch):
    monkeypatch.setattr(partenum, "HUB_PAIRS", 2)
    rng = np.random.default_rng(8)
    sets = {i: np.unique(np.concatenate([np.arange(30, dtype=np.uint64), rng.integers(1 << 40, 1 << 41, int(rng.integers(1, 14)), dtype=np.uint64)])) for i in range(20)}
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 20)]
    table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "node bigint, elements binary")
    for limit in (partenum.BROADCAST_IDS, 0):
        monkeypatch.setattr(partenum, "BROADCAST_IDS", limit)
        got = {(r.a, r.b): r.linked for r in partenum.verified(spark.createDataFrame(pairs, "a bigint, b bigint"), table, 75).collect()}
        assert got == {(a, b): partenum.similar(sets[a], sets[b]) for a, b in pairs} and len(set(got.values())) == 2


def test_jaccard_join_edges(spark, odd):
    got = sorted((tuple(r) for r in partenum.similarity_components(odd).collect()), key=str)
    by = defaultdict(list)
    for d, n, c in got:
        by[d].append((n, c))
    assert len(got) == len(ODD) and by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[5] == [(0, 5)] * 2 and by[8] == [(1, 8)] and by[9] == [(1, 8)]
    assert partenum.similarity_components(odd.limit(0)).count() == 0


# ---- op7


def test_vectors_match_sql(spark):
    got = sorted(tuple(r) for r in vector_links.op7(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(vector_links.op7_sql()).fetchall()) and len(got) == 500


def test_vectors_over_small_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows, base = [], rng.normal(size=(40, 16))
    for i in range(300):
        v = base[i % 40] + rng.normal(size=16) * rng.choice([0, 0.05, 0.2])
        rows.append((i, [float(x) for x in (v * rng.uniform(0.1, 9)).astype(np.float32)], int(i % 3)))
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [None] + [1.0] * 15, 1), (303, [float("nan")] * 16, 1), (304, rows[0][1], None), (305, rows[0][1], 0), (306, rows[0][1], 0), (307, [1.0, 2.0], 0), (308, [], 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    good = {i: (np.array(v, np.float64), lab) for i, v, lab in rows if lab is not None and i not in (300, 301, 302, 303, 308)}
    links = defaultdict(set)
    for i, (x, a) in good.items():
        for j, (y, b) in good.items():
            if i != j and a == b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i].add(j)
    got = {r.vec_id: r for r in vector_links.near_vectors(table, block=32).collect()}
    assert len(got) == len(rows)
    for i, *_ in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(reach), min(reach) == i), i
    assert vector_links.near_vectors(table.limit(0)).count() == 0


def test_quantised_products_are_within_their_bound():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 24)) * np.exp(rng.normal(size=(200, 24)) * 2)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    q = vector_links.quantise(x)
    for threshold in (0.2, 0.6, 0.9):
        may = set(zip(*map(np.ndarray.tolist, vector_links.may_link(q, q, threshold))))
        assert may >= set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= threshold))))


# ---- op6


def test_chunked_bpe_matches_the_library(spark):
    docs = {d: t or "" for d, t in texts(spark).items() if d % 4 == 0}
    encoder, lib = chunked_bpe.ChunkEncoder(), library("byte_bpe_50k.json")
    odd = ["", "a", "x" * 20_000, " " * 3000, "é" * 5000, " a b" * 5000, "a  b\n\n c " * 3000, "<|endoftext|> x<|endoftext|>" * 50, "日本語 テキスト " * 800, "It's we'll 3.14 " * 900, "\ta b  c d" * 500]
    for text in [*docs.values(), *odd]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == (len(ids), ",".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False)), text[:60]
        assert "".join(encoder.stretches(text)) == text
    assert encoder.encoded < encoder.asked


def test_chunks_are_shared_and_queries_carry_digests(spark, odd):
    rng = random.Random(5)
    body = " ".join(f"word{rng.randint(0, 10**6)}" for _ in range(4000))
    known = set(chunked_bpe.ChunkEncoder().stretches(body))
    assert sum(len(s) for s in chunked_bpe.ChunkEncoder().stretches("Other start. " + body) if s in known) > 0.9 * len(body)
    lib = library("byte_bpe_50k.json")
    docs = texts(spark, "/root/testdata/sf0.001")
    for r in chunked_bpe.op6(spark, "/root/testdata/sf0.001").collect():
        ids = lib.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    rows = chunked_bpe.encode_docs(odd.withColumnRenamed("kept", "ids")).collect()
    assert len(rows) == len(ODD) and all(r.n_tokens == 0 for r in rows if not r.text)
    assert chunked_bpe.encode_docs(odd.limit(0)).count() == 0


# ---- op3

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    out = [("email", *m.span()) for m in PATTERNS[0].finditer(text)]
    out += [("ip", *m.span()) for m in PATTERNS[1].finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in PATTERNS[2].finditer(text):
        d = digits(m[0])[::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PATTERNS[3].finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_personal_data_base_spans(spark):
    docs = texts(spark)
    rows = pii.op3(spark, SF).collect()
    for r in rows:
        base = plain_spans(docs[r.doc_id] or "")
        n = Counter(k for k, *_ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in pii.BASE_KINDS)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(told.split(",")) - {""} <= set(r.spans.split(","))
    secrets = {d: [m.span(1) for m in re.finditer(r'(?i)token = "(\w{40})"', t or "")] for d, t in docs.items()}
    added = {r.doc_id: {s for s in r.spans.split(",") if s.startswith("secret:")} for r in rows}
    assert all(added[d] == {f"secret:{a}:{b}" for a, b in spans} for d, spans in secrets.items())


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_of_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(4000):
        text = "".join(rng.choice(["1", "23", "4", "255", ".", ".", "@", "a", "b-", " ", "-", "+", "+1", "(", "é", "x.y", "4111111111111111"]) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_trees_tell_unseen_candidates(odd):
    trees, limits = pii.model()
    rows = pii.examples(3000, 99)
    chance = trees.chance(np.array([pii.describe(t, k, a, b) for t, k, a, b, _ in rows]))
    taken = [c >= limits[r[1]] for c, r in zip(chance, rows)]
    right = sum(t and r[4] for t, r in zip(taken, rows))
    assert right >= 0.95 * sum(taken) and right >= 0.8 * sum(r[4] for r in rows)
    out = {(r.doc_id, r.text, r.spans) for r in pii.find(odd).collect()}
    assert len(out) == len(ODD) - 1 and (1, None, "") in out and next(t for d, t, _ in out if d == 6) == "<EMAIL> " * 4000
    assert pii.find(odd.limit(0)).count() == 0


def test_nothing_of_a_long_secret_remains():
    rng, model = random.Random(4), pii.model()
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    alpha = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hexa, card = "0123456789abcdef", "4111111111111111"
    codes = [pick(alpha + "+/", 342) + "==", *(pick(alpha, k) for k in (199, 200, 201, 400, 2000, 20_000)), ".".join(pick(alpha + "-_", k) for k in (36, 300, 342)), pick(hexa, 300) + "a" + card + "b" + pick(hexa, 300), "a" * 40 + pick("abcdef", 60) + pick(hexa, 500)]
    for code in codes:
        for before, after in (('token = "', '" ends'), ("the key: ", " ends"), ("Bearer: ", "")):
            text = "It begins " + before + code + after
            (base, more), = pii.all_spans([text], *model)
            left = pii.redact(text, base + more)
            assert left == "It begins " + before + "<SECRET>" + after, (len(code), left)
    for code in (pick(alpha, 344), pick(alpha + "+/", 2000)):
        (base, more), = pii.all_spans([f"It is {code} here"], *model)
        assert pii.redact(f"It is {code} here", base + more) == "It is <SECRET> here"
    assert pii.all_spans(["see " + "/".join(["usr", "share", "doc"] * 100) + "/12 there"], *model) == [([], [])]


# ---- op2


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_quality_rules(spark):
    docs, labels = texts(spark), {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = isolation.op2(spark, SF).collect()
    for r in rows:
        c = plain_counts(docs[r.doc_id] or "")
        assert [r[k] for k in isolation.COUNTS] == c
        assert r.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0]) and not (r.base_failed and r.kept)
    clean, junk = [[r for r in rows if labels.get(r.doc_id) == q and not r.base_failed] for q in (1, 0)]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean) and sum(not r.kept for r in junk) >= 0.8 * len(junk)


def test_quality_edges(spark, odd):
    repeated = "a b c d e f g h i j " * 30
    assert isolation.rule_counts(repeated)[0] == plain_counts(repeated)
    model = isolation.train(odd, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    rows = isolation.judge(odd, model).collect()
    assert len(rows) == len(ODD) and all(r.base_failed and not r.kept for r in rows if not r.text) and next(r for r in rows if r.doc_id == 6).base_failed
    assert isolation.judge(odd.limit(0), model).count() == 0


def test_long_texts_that_turn_to_junk(spark):
    """Wherever the junk is: no line, no word in a row and no 8-word window of it is repeated."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = isolation.train(docs, labels)
    clean = [r.text for r in docs.join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").select("text").collect()]
    whole = max(clean, key=lambda t: len(t.split()))
    good, few, rng = whole.split(), sorted(set(whole.split()))[:12], random.Random(3)
    junk = [few[0]]
    while len(junk) < 8000:
        junk.append(rng.choice([w for w in few if w != junk[-1]]))
    lines = lambda words: "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    head, tail = good[:2100], good[2100:4200]
    made = [lines(x) for x in (head + tail, head + junk, junk + head, head + junk + tail)]
    assert len(head) == 2100
    table = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id bigint, text string")
    rows = sorted(isolation.judge(table, model).collect())
    assert not any(r.base_failed for r in rows) and [r.kept for r in rows] == [True, False, False, False]
    assert isolation.distinct_shares(["a"] * 5000) == [1 / 2000] * 4 and isolation.distinct_shares([]) == [0.0]


# ---- op8


def test_extraction_of_unseen_written_pages():
    chain, wrong, total = html_crf.model(), 0, 0
    for blocks, states in html_crf.labelled_pages(200, 77):
        wrong += sum(a != b for a, b in zip(chain.decode(html_crf.matrix(blocks)), states))
        total += len(states)
    assert wrong <= 0.01 * total


def test_extraction_of_pages(spark):
    rows = {r.page_id: r for r in html_crf.op8(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html or "", re.S)
        inside = re.sub(r"<[^>]*\Z", "", body[1]) if body else ""
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n\n".join(b for b in blocks if b)
        assert rows[r.page_id].text == want and rows[r.page_id].n_chars == len(want) and rows[r.page_id].url == r.url


def test_extraction_edges(spark):
    pages = ["", None, "plain words only", "<p>open", "<article><p>a &lt;b&gt; &amp;c &#233;</p><script>x</script><!-- y --><form><p>no</p></form><p>d\n\t e</p>", "<div " * 3000, "<article>" + "<p>Long text here. </p>" * 5000 + "</article>", "<<>>&&&<a", "<p title='a>b'>Quoted attribute.</p>"]
    table = spark.createDataFrame([(i, p, "own") for i, p in enumerate(pages)] + [(0, "", "own")], "page_id bigint, html string, text string")
    rows = {r.page_id: r for r in html_crf.extract(table).collect()}
    assert rows[0].text == rows[1].text == "" and rows[4].text == "a <b> &c é\n\nd e" and rows[6].text.count("\n\n") == 4999
    assert html_crf.extract(table.limit(0)).count() == 0
