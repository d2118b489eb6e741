"""Signatures, hot groups, identities and the pipeline's choice among near copies."""

import random

import numpy as np
import pytest

from trialspark.llm import partenum

from .test_more_ops import SF, brute_groups, texts


def near_copies(n: int, words: int, seed: int) -> list[str]:
    """A large group whose members differ from each other in up to two words, some of them too far from the first."""
    rng = random.Random(seed)
    base = [f"g{seed}w{i}" for i in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.choice((1, 1, 1, 2, words // 12))):
            copy[rng.randrange(words)] = f"c{seed}x{i}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("flush, block", [(2_000, 16), (partenum.FLUSH, partenum.BLOCK)])
def test_hot_groups_in_blocks(spark, monkeypatch, flush, block):
    """Large groups over many blocks of signatures and many pairs of blocks, with members the first one isn't like."""
    monkeypatch.setattr(partenum, "FLUSH", flush)
    monkeypatch.setattr(partenum, "BLOCK", block)
    rows = list(enumerate([*near_copies(140, 120, 1), *near_copies(60, 60, 2), *(f"alone {i} " * 9 for i in range(20))]))
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.similarity_components(df).collect()}
    assert got == brute_groups(rows)


def test_fewer_signatures_than_shingles(spark):
    sets = [partenum.shingles(t or "") for t in texts(spark).values()]
    bands, none = partenum.Bands(), np.zeros(0, np.uint64)
    sizes = [(len(s), len(partenum.signatures(s, none, bands))) for s in sets if len(s) > 20]
    assert sum(n for _, n in sizes) < 0.9 * sum(k for k, _ in sizes)


def test_signatures_leave_out_one_part_of_a_partition():
    """Sets that differ in one part of each partition share the subset of the others."""
    rng, bands = np.random.default_rng(1), partenum.Bands()
    a = np.unique(rng.integers(0, 1 << 63, 120, dtype=np.uint64))
    band, m, enough = bands.plans(len(a))[0]
    part = ((a >> np.uint64(32)) * np.uint64(m * partenum.PARTS)) >> np.uint64(32)
    gone = np.isin(part, np.arange(m) * partenum.PARTS)  # the first part of every partition
    mine, other = (partenum.signatures(x, np.zeros(0, np.uint64), bands) for x in (a, a[~gone]))
    assert enough <= m and (bands.of(len(a)) != bands.of(int((~gone).sum())) or len(np.intersect1d(mine, other)) > 0)


def test_identities_are_told_apart():
    a, b = (np.sort(partenum.mix(np.arange(i, i + 9, dtype=np.uint64))) for i in (0, 50))
    node, check = partenum.identity(a)
    assert partenum.node_of(a) == node and partenum.node_of(a, frozenset({node})) == check and partenum.node_of(b, frozenset({node})) == partenum.identity(b)[0]
    assert len({*partenum.identity(a), *partenum.identity(b)}) == 4


def test_one_row_of_each_group_stays(spark):
    words, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    rows = [(3, words), (5, words + " more"), (5, other), (9, None), (9, None), (7, other), (7, other), (None, other + " x"), (2, ""), (4, words.upper())]
    df = spark.createDataFrame([(d, t, "en", "mine", 0, "x") for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, text_key string")
    got = partenum.keep_first(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, words), (5, other), (9, None), (9, None), (2, "")], key=str)
    assert partenum.keep_first(df.where("doc_id = 7")).count() == 1  # equal rows are one
    assert partenum.keep_first(df.limit(0)).count() == 0 and SF


@pytest.mark.parametrize("chain", [True, False])
def test_open_groups_cover_all_pairs_that_may_be_missed(spark, chain):
    """Groups in a long chain stay apart, groups of one crowd become one; members of one group with two roots always meet."""
    rng = random.Random(3)
    groups = [list(range(i * 10, i * 10 + 11)) for i in range(12)] if chain else [sorted(rng.sample(range(60), 40)) for _ in range(30)]
    own = {10 * i + 3: [1000 + 10 * i + k for k in range(9)] for i in range(4)}  # what smallest members of one task stand for
    stars = [(g[0], x, partenum.ALL) for g in groups for x in g[1:]] + [(a, x, partenum.OWN) for a, held in own.items() for x in held]
    roots = {x: x - x % 4 for g in [*groups, *own.values()] for x in g} if chain else {x: x - x % 4 for x in range(0, 2000)}
    known = [(x, r) for x, r in roots.items() if any(x in s[:2] for s in stars)]
    got = partenum.open_groups(spark.createDataFrame(stars, "a bigint, b bigint, marks bigint"), spark.createDataFrame(known, "node bigint, root bigint")).collect()
    held = {}
    for r in got:
        held.setdefault(r.of, {})[r.node] = (r.root, r.main)
    assert (len(held) > 5) == chain and all(len({m for _, m in h.values()}) == 1 for h in held.values())
    met = {(x, y) for h in held.values() for x in h for y in h if h[x][0] != h[y][0]}
    for g in groups:
        every = {y for x in g for y in [x, *own.get(x, ())]}
        assert {(x, y) for x in every for y in every if roots[x] != roots[y]} <= met
