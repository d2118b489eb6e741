"""Set-similarity join of word shingles by PartEnum signatures.

Sets are grouped into bands of sizes; two sets with Jaccard similarity 3/4 or more lie in one band or in
neighbouring ones, and differ in at most k elements, k being a seventh of their sizes together. The domain of
shingles is split by a hash into first-level partitions, and each of these into PARTS second-level parts. If two
sets differ in at most k elements, all but k // 2 of the partitions hold at most one difference, so that in those
the sets agree on all parts but one: each subset of PARTS - 1 parts of a partition, with what the set holds of
it, is one signature, and similar sets share one in each such partition. A set need not enumerate all partitions:
of any k // 2 + 1 of them one is shared, so it stops after the first that are so many.

Signatures that say little are left out where that loses nothing. A subset is weak for a set if all that the set
holds of it is nothing, or shingles that a noted share of the corpus has; partitions with a weak subset aren't
counted among those so many. A set that has too few others goes on to a second hash, then to ones where only empty
subsets are weak, and last to one where all count. Of two similar sets the one that stops first has k // 2 + 1
partitions without weak subsets, one of which the sets share, and the other has not stopped before that.

Sets that are equal are one class from the start. What shares a signature is paired: small groups all with all,
others with their smallest member (within a task first, so a signature of many sets is few rows when it is dealt
out), and pairs are verified on the exact sets. Members that this leaves unconnected are compared with the others
block by block, each pair of blocks in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, read, texts_of, tune, width
from .graphs import components

WORDS, PERCENT, PARTS = 5, 75, 3
NOTED_SHARE, NOTED_LEAST, NOTED_MOST, WINDOW_DOCS = 0.0004, 16, 1 << 20, 4096
STRONG_SEEDS, FULL_SEEDS = 2, 6
FLUSH, BUCKET_SIGNATURES = 600_000, 750_000
ALL_PAIRS_UP_TO, BROADCAST_IDS, HUB_PAIRS, SKETCH_CHUNK, BLOCK = 8, 1_000_000, 256, 1 << 20, 512

U = np.uint64
BASE = 0xD1342543DE82EF95
BYTE = (np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) ^ U(0x632BE59BD9B4E019)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: list = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 17, 1 << n.bit_length())
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, U(b))])) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def shingles(text: str) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles of five words; of all its words if they are fewer."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.concatenate([[False], ~BLANK[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edge):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * up[: len(raw)])])
    start, stop = edge[::2], edge[1::2]
    words = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    size = min(WORDS, len(words))
    out = np.full(len(words) - size + 1, U(size))
    for j in range(size):
        out = out * U(0x9E3779B97F4A7C15) + words[j : j + len(out)]
    return np.unique(mix(out))


def identity(elements: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, as signed 64-bit numbers: its node, and what tells it from other sets of that node."""
    sums = [mix(elements ^ U(k)).sum(dtype=np.uint64) + U(len(elements)) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    node, check = mix(np.array(sums)).astype(np.int64).tolist()
    return node, check


def node_of(elements: np.ndarray, mixed: frozenset = frozenset()) -> int:
    """A set's node; where different sets have one (`mixed`), the second hash stands for it."""
    node, check = identity(elements)
    return check if node in mixed else node


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def sketch(elements: np.ndarray) -> np.ndarray:
    """A parity sketch: each element flips one of its bits, so two sketches differ in no more bits than their sets in elements.

    It has two bits for each element, rounded up to a power of two: a sketch of one width for all would say nothing
    of sets larger than itself.
    """
    bits = 64 << max(0, (2 * len(elements) - 1).bit_length() - 6)
    flips = np.bincount((elements >> U(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view("<u8")


class Sketches:
    """Sketches of sets and their sizes, compared by rows; the wider of two is folded to the other's width."""

    def __init__(self, n: np.ndarray, sketches: list[bytes]):
        self.n, self.width = n, np.array([len(x) // 8 for x in sketches], np.int64)
        self.at, self.bits = {}, {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width >= w)
            self.at[w] = np.zeros(len(sketches), np.int64)
            self.at[w][own] = np.arange(len(own))
            self.bits[w] = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[i], "<u8").reshape(-1, w)) for i in own])

    def may_be_similar(self, p: np.ndarray, q: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """False only for pairs of rows that sizes or sketches prove too different."""
        small, large = np.minimum(self.n[p], self.n[q]), np.maximum(self.n[p], self.n[q])
        keep, most, width = 100 * small >= percent * large, (small + large) * (100 - percent) // (100 + percent), np.minimum(self.width[p], self.width[q])
        for w in np.unique(width[keep]).tolist():
            mine, at, bits = np.flatnonzero(keep & (width == w)), self.at[w], self.bits[w]
            step = max(1, SKETCH_CHUNK // w)
            for k in range(0, len(mine), step):
                i = mine[k : k + step]
                keep[i] = np.bitwise_count(bits[at[p[i]]] ^ bits[at[q[i]]]).sum(axis=1, dtype=np.int64) <= most[i]
        return keep


class Bands:
    """Size bands and their numbers of partitions, for one similarity. A band reaches over two steps of that similarity, so half of its sets have none similar in the next."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.ends = percent, [0]

    def of(self, size: int) -> int:
        while self.ends[-1] < size:
            self.ends.append((self.ends[-1] + 1) * 10_000 // self.percent**2)
        return int(np.searchsorted(self.ends, size))

    def end(self, band: int) -> int:
        while len(self.ends) <= band:
            self.of(self.ends[-1] + 1)
        return self.ends[band]

    def differ(self, both: int) -> int:
        """How many elements two similar sets with so many together differ in, at most."""
        return both * (100 - self.percent) // (100 + self.percent)

    def partitions(self, band: int) -> int:
        bad = self.differ(2 * self.end(band)) // 2
        return bad + 1 + bad // 5

    def plans(self, size: int) -> list[tuple[int, int, int]]:
        """(band, partitions, how many without weak subsets are enough) for which a set of this size makes signatures."""
        band, most = self.of(size), size * 100 // self.percent
        out = [(band, self.differ(size + min(most, self.end(band))))]
        if most > self.end(band):
            out.append((band + 1, self.differ(size + most)))
        return [(b, self.partitions(b), k // 2 + 1) for b, k in out]


def signatures(elements: np.ndarray, noted: np.ndarray, bands: Bands) -> np.ndarray:
    """A set's signatures as 64-bit hashes of (band, seed, partition, part left out, what is in the others)."""
    if len(noted):
        at = np.searchsorted(noted, elements)
        rare = noted[np.minimum(at, len(noted) - 1)] != elements
    else:
        rare = np.ones(len(elements), bool)
    out, seeded = [np.zeros(0, np.uint64)], {}
    for band, m, enough in bands.plans(len(elements)):
        for seed in range(STRONG_SEEDS + FULL_SEEDS + 1):
            if seed not in seeded:
                x = mix(elements ^ mix(np.array([seed + 1], np.uint64))[0]) if seed else elements
                order = np.argsort(x) if seed else slice(None)
                seeded[seed] = (x[order], rare[order].astype(np.int64), mix(x[order] + U(seed + 77)))
            x, scarce, content = seeded[seed]
            part = (((x >> U(32)) * U(m * PARTS)) >> U(32)).astype(np.int64)
            starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
            sums, held = np.zeros(m * PARTS, np.uint64), np.zeros(m * PARTS, np.int64)
            sums[part[starts]] = np.add.reduceat(content, starts)
            if seed < STRONG_SEEDS:
                held[part[starts]] = np.add.reduceat(scarce, starts)
            else:
                held[part[starts]] = 1
            sums, held = sums.reshape(m, PARTS), held.reshape(m, PARTS)
            strong = held.sum(axis=1, keepdims=True) > held if seed < STRONG_SEEDS + FULL_SEEDS else np.ones((m, PARTS), bool)
            whole = np.cumsum(strong.all(axis=1))
            stop = int(np.searchsorted(whole, enough)) + 1  # the partition with which there are enough
            key = (U(band) << U(40)) + (U(seed) << U(32))
            names = mix(np.arange(min(stop, m) * PARTS, dtype=np.uint64) + key).reshape(-1, PARTS)
            every = mix(sums.sum(axis=1, keepdims=True, dtype=np.uint64)[:stop] - sums[:stop] + names)
            out.append(every[strong[:stop]])
            if stop <= m:
                break
    return np.concatenate(out)


def sets_of(docs: DataFrame) -> DataFrame:
    """kind 0: (doc_id, text_key, n, node, check, sketch) for each row; kind 1: (x, c), shingles found often in a window of documents."""
    names = ["kind", "doc_id", "text_key", "n", "node", "check", "sketch", "x", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = [], set()

        def noted():
            x, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= max(3, int(NOTED_SHARE * len(held)))
            n = int(often.sum())
            held.clear()
            seen.clear()
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), *[none] * 5, pa.nulls(n, pa.binary()), pa.array(x[often].astype(np.int64)), pa.array(c[often].astype(np.int64))], names=names)

        for batch in batches:
            ns, nodes, checks, sketches = [], [], [], []
            for text in texts_of(batch):
                elements = shingles(text)
                ns.append(len(elements))
                sketches.append(sketch(elements).tobytes() if len(elements) else None)
                node, check = identity(elements) if len(elements) else (None, None)
                nodes.append(node)
                checks.append(check)
                if len(elements) and node not in seen:
                    seen.add(node)
                    held.append(elements)
            n = batch.num_rows
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), *[pa.array(c, pa.int64()) for c in (ns, nodes, checks)], pa.array(sketches, pa.binary()), none, none], names=names)
            if len(held) >= WINDOW_DOCS:
                yield noted()
        if held:
            yield noted()

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(run, "kind int, doc_id bigint, text_key bigint, n bigint, node bigint, check bigint, sketch binary, x bigint, c bigint")


PLAIN, PAIRS, HUBS = 0, 1, 2
#: What a pair is besides a candidate: a smallest member and another one of a large group, of one task's or of all.
OWN, ALL = 1, 2


def signature_blocks(docs: DataFrame, noted, mixed: frozenset, buckets: int, percent: int) -> DataFrame:
    """(bucket, kind, nodes, at, high, low): signatures dealt to buckets, packed by task; 40 bits of each are kept beside its bucket.

    A signature that more than ALL_PAIRS_UP_TO sets of a block share sends the smallest of them only (HUBS), and the
    pairs of that one with the others go along as they are (PAIRS).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, nodes, sigs, sizes, seen, held = Bands(percent), [], [], [], set(), 0

        def packed(kind: int, key: np.ndarray, node: np.ndarray):
            bucket = (key >> U(40)).astype(np.int64)
            edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                own, local = np.unique(node[a:b], return_inverse=True)
                yield int(bucket[a]), kind, own.astype("<i8").tobytes(), local.astype("<u2" if len(own) < 1 << 16 else "<u4").tobytes(), (key[a:b] >> U(8)).astype("<u4").tobytes(), (key[a:b] & U(255)).astype("<u1").tobytes()

        def blocks():
            every, node = np.concatenate(sigs), np.repeat(np.array(nodes, np.int64), sizes)
            key = (((every & U(0xFFFFFF)) % U(buckets)) << U(40)) | (every >> U(24))
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else np.zeros(0, np.int64)
            many = np.diff(np.concatenate([starts, [len(key)]]))
            large = np.repeat(many > ALL_PAIRS_UP_TO, many)
            yield from packed(PLAIN, key[~large], node[~large])
            if large.any():
                first = starts[many > ALL_PAIRS_UP_TO]
                yield from packed(HUBS, key[first], node[first])
                pairs = unique_pairs(np.repeat(node[first], many[many > ALL_PAIRS_UP_TO]), node[large], np.full(int(large.sum()), OWN))
                yield int(key[first[0]] >> U(40)), PAIRS, pairs[0].astype("<i8").tobytes(), pairs[1].astype("<i8").tobytes(), b"", b""

        def flush():
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            columns = list(zip(*blocks())) or [()] * len(kinds)
            nodes.clear(), sigs.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "kind", "nodes", "at", "high", "low"])

        for batch in batches:
            for text in texts_of(batch):
                elements = shingles(text)
                if not len(elements) or (node := node_of(elements, mixed)) in seen:
                    continue  # the same set's signatures need no second copy
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                own = signatures(elements, noted.value, bands)
                nodes.append(node)
                sigs.append(own)
                sizes.append(len(own))
                held += len(own)
                if held >= FLUSH:
                    yield flush()
                    held = 0
        if nodes:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket int, kind int, nodes binary, at binary, high binary, low binary")


def unique_pairs(a: np.ndarray, b: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of different numbers, each once, in order, with their marks together."""
    order = np.lexsort((b, a))
    a, b, marks = a[order], b[order], marks[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    marks = np.bitwise_or.reduceat(marks, np.flatnonzero(first)) if len(a) else marks
    a, b = a[first], b[first]
    return a[a != b], b[a != b], marks[a != b]


def pairs_of(table: pa.Table) -> pa.Table:
    """(a, b, marks) of what shares a signature of this bucket: all pairs of small groups; others, and those that hold a HUBS row, the pairs with their smallest member."""
    nodes, sigs, hubs, ends = [], [], [], [[], [], []]
    for kind, own, at, high, low in zip(*(table.column(c).to_pylist() for c in ("kind", "nodes", "at", "high", "low"))):
        if kind == PAIRS:
            ends[0].append(np.frombuffer(own, "<i8"))
            ends[1].append(np.frombuffer(at, "<i8"))
            ends[2].append(np.full(len(at) // 8, OWN))
            continue
        high = np.frombuffer(high, "<u4")
        nodes.append(np.frombuffer(own, "<i8")[np.frombuffer(at, "<u2" if len(at) == 2 * len(high) else "<u4")])
        sigs.append((high.astype(np.uint64) << U(8)) | np.frombuffer(low, "<u1").astype(np.uint64))
        hubs.append(np.full(len(high), kind == HUBS))
    if nodes:
        node, sig, hub = np.concatenate(nodes), np.concatenate(sigs), np.concatenate(hubs)
        order = np.argsort(sig, kind="stable")
        node, sig, hub = node[order], sig[order], hub[order]
        same = sig[1:] == sig[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        node, sig, hub = node[shared], sig[shared], hub[shared]
        order = np.lexsort((node, sig))
        node, sig, hub = node[order], sig[order], hub[order]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [len(sig)]]))
        large = sizes > ALL_PAIRS_UP_TO
        if len(starts):
            large |= np.logical_or.reduceat(hub, starts)
        for n in range(2, ALL_PAIRS_UP_TO + 1):
            of = starts[(sizes == n) & ~large]
            if len(of):
                i, j = np.triu_indices(n, 1)
                members = node[of[:, None] + np.arange(n)]
                ends[0].append(members[:, i].ravel())
                ends[1].append(members[:, j].ravel())
                ends[2].append(np.zeros(len(of) * len(i), np.int64))
        if large.any():
            ends[0].append(np.repeat(node[starts[large]], sizes[large]))
            ends[1].append(node[np.repeat(large, sizes)])
            ends[2].append(np.full(len(ends[1][-1]), ALL))
    a, b, marks = unique_pairs(*(np.concatenate([np.zeros(0, np.int64), *e]) for e in ends))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "marks": pa.array(marks, pa.int64())})


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for the pairs, on the exact sets.

    The sets of the b of one a follow that a's set, in runs of about HUB_PAIRS: a run is read as a stream, its first
    set is all that is held, and a set that many pairs share as their a moves once for each run.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, None
        for batch in batches:
            a, b, linked = [], [], []
            for own, second, node, elements in zip(*(batch.column(c).to_pylist() for c in ("hub", "second", "node", "elements"))):
                elements = np.frombuffer(elements, "<u8")
                if not second:
                    hub, held = own, elements
                else:
                    assert own == hub, "a run begins with its first set"
                    a.append(own)
                    b.append(node)
                    linked.append(similar(held, elements, percent))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    pairs = cut(pairs.select("a", "b"))
    few = pairs.count() <= BROADCAST_IDS  # 24 bytes each; beyond that the sets are shuffled to them
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).alias("runs"))
    dealt = pairs.join(runs, "a").select(F.col("a").alias("hub"), "b", F.pmod(F.xxhash64("b"), F.col("runs")).alias("run"))
    firsts = dealt.select(F.col("hub").alias("node"), "hub", "run").distinct()
    seconds = dealt.select(F.col("b").alias("node"), "hub", "run")
    parts = [sets.join(F.broadcast(x) if few else x, "node").select("hub", "run", F.lit(k).alias("second"), "node", "elements") for k, x in enumerate((firsts, seconds))]
    rows = parts[0].unionByName(parts[1]).repartition("hub", "run").sortWithinPartitions("hub", "run", "second")
    return rows.mapInArrow(check, "a bigint, b bigint, linked boolean")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches don't rule out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.arange(batch.num_rows)
        n = np.concatenate([batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb")])
        known = Sketches(n, batch.column("xa").to_pylist() + batch.column("xb").to_pylist())
        return batch.select(["a", "b"]).filter(pa.array(known.may_be_similar(rows, rows + batch.num_rows, percent)))

    left = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("xa"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("xb"))
    both = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return map_rows(both.select("a", "b", "na", "nb", "xa", "xb"), run, "a bigint, b bigint")


def members_of(shared: DataFrame) -> DataFrame:
    """(of, node): what shares a large group with its smallest member; a group over several tasks has what their smallest members stand for."""
    stars = lambda mark, a, b: shared.where(F.col("marks").bitwiseAND(mark) > 0).select(F.col("a").alias(a), F.col("b").alias(b))
    every, own = stars(ALL, "of", "node"), stars(OWN, "by", "node")
    hubs = every.select("of", F.col("of").alias("by")).unionByName(every.select("of", F.col("node").alias("by"))).distinct()
    further = hubs.join(own, "by").select("of", "node")
    alone = own.join(hubs.select("by").distinct(), "by", "left_anti").select(F.col("by").alias("of"), "node")  # the others' members are among a larger group's
    out = every.unionByName(further).unionByName(alone)
    return out.unionByName(out.select("of", F.col("of").alias("node"))).distinct()


def open_groups(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """(of, main, node, root): the groups with members whose roots differ from the main one.

    Groups that overlap, directly or over others, are one where comparing all that they have is fewer pairs than
    comparing each; its main root is what most of it has. Others are groups of one main, their smallest members' root.
    """
    union = components(stars).withColumnRenamed("root", "union")
    union = cut(union.join(roots, "node", "left").select("node", "union", F.coalesce("root", "node").alias("root")))
    sizes = union.groupBy("union", "root").count().groupBy("union").agg(F.sum("count").alias("n"), F.count("*").alias("parts"), F.max_by("root", F.struct("count", "root")).alias("main")).where("parts > 1")
    marked = lambda mark: stars.where(F.col("marks").bitwiseAND(mark) > 0).select("a", "b")
    own = marked(OWN).groupBy(F.col("a").alias("b")).agg(F.count("*").alias("own"))
    stand = marked(ALL).join(own, "b", "left").groupBy("a").agg(F.sum(1 + F.coalesce("own", F.lit(0))).alias("held"))
    stand = stand.unionByName(own.select(F.col("b").alias("a"), F.col("own").alias("held"))).groupBy("a").agg(F.sum("held").alias("held"))
    apart = stand.join(union, F.col("a") == F.col("node")).groupBy("union").agg(F.sum(F.col("held").cast("double") ** 2).alias("apart"))
    split = cut(sizes.join(apart, "union").select("union", "main", (F.col("apart") > F.col("n").cast("double") ** 2).alias("wide")))
    once = union.join(split.where("wide").select("union", "main"), "union").select(F.col("union").alias("of"), "main", "node", "root")
    named = union.join(split.where("not wide").select("union"), "union", "left_semi").select("node", "root")
    if split.where("not wide").isEmpty():
        return once
    left = stars.join(named.select(F.col("node").alias("a")), "a", "left_semi")
    held = members_of(left).join(named.select(F.col("node").alias("of"), F.col("root").alias("main")), "of").join(named, "node").select(F.col("main").alias("of"), "main", "node", "root").distinct()
    return once.unionByName(held.join(held.where("root <> main").select("of").distinct(), "of", "left_semi"))


def cross_pairs(held: DataFrame, percent: int) -> DataFrame:
    """(a, b): the likely pairs of members of one group whose roots differ; held is (of, main, node, root, n, sketch).

    Members of the main root need no comparison with each other. They and the rest are dealt to blocks of about
    BLOCK; each block of the rest meets each block, one pair of blocks a task.
    """

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        node, root, n, block = (table.column(c).to_numpy() for c in ("node", "root", "n", "block"))
        known = Sketches(n, table.column("sketch").to_pylist())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        p, q = np.repeat(left, len(right)), np.tile(right, len(left))
        keep = (root[p] != root[q]) & ((node[p] < node[q]) | (i != j))
        p, q = p[keep], q[keep]
        ok = known.may_be_similar(p, q, percent)
        a, b = node[p[ok]], node[q[ok]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    blocks, rest = lambda n: F.ceil(n / BLOCK).cast("int"), F.col("root") != F.col("main")
    counts = cut(held.groupBy("of").agg(blocks(F.count_if(~rest)).alias("mains"), blocks(F.count_if(rest)).alias("rests")))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_IDS else counts  # 16 bytes each
    place = F.when(rest, F.col("mains") + F.pmod(F.xxhash64("node"), F.greatest("rests", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.greatest("mains", F.lit(1))))
    placed = held.join(counts, "of").where("rests > 0").withColumn("block", place.cast("int"))
    other = F.explode(F.sequence(F.when(rest, F.lit(0)).otherwise(F.col("mains")), F.col("mains") + F.col("rests") - 1))
    dealt = placed.withColumn("other", other).select("of", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "n", "sketch")
    return dealt.groupBy("of", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def sets_for(pairs: DataFrame, classes: DataFrame, docs: DataFrame, unique: bool, mixed: frozenset = frozenset()) -> DataFrame:
    """(node, elements) for the ends of pairs, read from the text of each class's smallest doc_id; unique: no doc_id is repeated."""

    def elements(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingles(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([pa.array([node_of(e, mixed) if len(e) else None for e in made], pa.int64()), pa.array([e.astype("<u8").tobytes() for e in made], pa.binary())], names=["node", "elements"])

    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = cut(nodes.join(classes, "node").select(F.col("rep").alias("doc_id")).distinct())
    few = ids.count() <= BROADCAST_IDS  # 8 bytes each; beyond that the texts are shuffled to their ids
    on = docs.doc_id.eqNullSafe(ids.doc_id)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, on, "left_semi")
    sets = map_rows(texts.select("text"), elements, "node bigint, elements binary").where("node is not null")
    return cut(sets if unique else sets.dropDuplicates(["node"]))


def similarity_rows(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for each row of docs; text_key is xxhash64 of the text.

    component_id is the smallest doc_id reachable by links; two rows link if 100 * |intersection| >= percent *
    |union| of their shingle sets. kept: the row is its component's first by doc_id (nulls last), then text_key, or
    one equal to that in both; ties are such repeated rows. Null texts and texts without words have empty sets, link
    with nothing and are kept and their own component, as are rows whose set no other row's comes near. Rows with a
    repeated doc_id are joined by what their texts say. Texts of any length are read whole. An empty table gives no
    rows. Sets are held as sorted 64-bit hashes of their shingles, and told apart by 128 bits.
    """
    spark = docs.sparkSession
    tune(spark)
    made = cut(sets_of(docs))
    told = made.where("node is not null").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high")
    mixed = frozenset(r.node for r in told.select("node").collect())  # different sets of one 64-bit hash: a handful among ten billion
    made = made.withColumn("node", F.when(F.col("node").isin(*mixed), F.col("check")).otherwise(F.col("node"))) if mixed else made
    rows = made.where("kind = 0").select("doc_id", "text_key", "n", "node")
    unique = rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    total, count = rows.agg(F.sum("n"), F.count("*")).first()
    first_row = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")
    classes = cut(made.where("kind = 0 and node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(first_row).alias("keeper"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    # a shingle noted is in at least NOTED_SHARE of the documents, so there are at most mean set size / NOTED_SHARE; which are noted changes no result
    often = made.where("kind = 1").groupBy("x").agg(F.sum("c").alias("c")).where(F.col("c") >= max(NOTED_LEAST, NOTED_SHARE * (count or 0)))
    noted = np.sort(np.array([r[0] for r in often.orderBy(F.desc("c"), "x").limit(NOTED_MOST).select("x").collect()], dtype=np.int64).astype(np.uint64))
    buckets = max(width(spark), -(-int((total or 0) * 0.9) // BUCKET_SIGNATURES), 1)
    blocks = signature_blocks(docs, spark.sparkContext.broadcast(noted), mixed, buckets, percent)
    shared = cut(blocks.groupBy("bucket").applyInArrow(pairs_of, "a bigint, b bigint, marks bigint").groupBy("a", "b").agg(F.bit_or("marks").alias("marks")))
    pairs = cut(likely(shared.select("a", "b"), classes, percent))
    sets = sets_for(pairs, classes, docs, unique, mixed)
    first = cut(verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, percent))
    roots = cut(components(first.where("linked")))
    rest = cut(verified(apart(pairs.join(first, ["a", "b"], "left_anti"), roots), sets, percent))
    links = first.unionByName(rest).where("linked").select("a", "b")
    roots = cut(components(links))
    stars = shared.where("marks > 0")
    if not stars.isEmpty():
        held = open_groups(stars, roots).join(classes.select("node", "n", "sketch"), "node")
        more = cut(cross_pairs(held, percent).join(pairs, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            last = cut(verified(more, sets_for(more, classes, docs, unique, mixed), percent))
            roots = cut(components(links.unionByName(last.where("linked").select("a", "b"))))
    reach = classes.select("node", "rep", "keeper").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = reach.groupBy("root").agg(F.min("rep").alias("low"), F.min("keeper").alias("first"))
    found = cut(reach.join(lowest, "root").select("node", "low", "first"))
    own = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")
    out = rows.join(found, "node", "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"), F.coalesce(own.eqNullSafe(F.col("first")) | F.col("first").isNull(), F.lit(True)).alias("kept"))


def similarity_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs, as similarity_rows has them."""
    return similarity_rows(docs, percent).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: of rows equal in doc_id and text, which are one component's if they have words, one stays; rows without words all do.

    Rows go by doc_id and text, so an unrelated row of the same doc_id stays. An empty table gives none; a column of docs named text_key is kept as it is.
    """
    rows = cut(similarity_rows(docs, percent))
    gone = rows.where("not kept").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    again = rows.where("kept and n_shingles > 0").groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).count().where("count > 1").drop("count")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_k"))
    kept = docs.join(gone, on, "left_anti")
    if again.isEmpty():
        return kept
    return kept.join(again, on, "left_anti").unionByName(kept.join(again, on, "left_semi").dropDuplicates(["doc_id", "text"]))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not connected yet."""
    left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(left, "a", "left").join(right, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def op10(spark, sf_dir):
    return similarity_components(read(spark, sf_dir, "documents"))


def op10_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS r FROM documents UNION SELECT links.x, reach.r FROM reach JOIN links ON links.y = reach.x),
roots AS (SELECT x, min(r) AS r FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, roots.r AS component_id FROM documents d JOIN roots ON roots.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
