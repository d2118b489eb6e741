"""Embedding near-dedup: int8 tile products with rigorous error bounds, recomputed in double where they may link.

A unit vector x is stored as int8 codes times a scale, x', with e = |x - x'|. Then
    |x.y - x'.y'| <= e_x |y'| + e_y |x'| + e_x e_y,
so only pairs whose tile product plus that bound reaches the threshold can link, and only they are computed in
double precision. Vectors are dealt to the leaves of a tree over a few directions; unit vectors of cosine t are at
most sqrt(2 - 2t) apart, in those directions as well, so pairs of leaves whose boxes lie further apart have no
link. Tiles are pairs of bounded parts of the other leaves of one label; a tile returns link counts and a spanning
forest of its links, never all of them, so a dense group costs its size and not its square in rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, read, tune
from .graphs import components

THRESHOLD, BLOCK, PART, BROADCAST_LABELS = 0.98, 1024, 8192, 100_000
#: The tree: its directions and leaves at most, and the vectors that it is grown on (bytes at most); what it is changes no result.
DIRECTIONS, LEAVES, SAMPLE, SAMPLE_BYTES, SLACK = 8, 256, 4096, 16 << 20, 1e-6


def usable(vector: list | None) -> bool:
    """Not null, no null or non-finite component, not zero."""
    if not vector or any(x is None for x in vector):
        return False
    x = np.asarray(vector, dtype=np.float64)
    return bool(np.isfinite(x).all() and x.any() and np.isfinite(norm(x)) and norm(x) > 0)


def norm(x: np.ndarray) -> float:
    return float(np.sqrt(np.dot(x, x)))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales, and a bound on |x - x'| for each row of unit vectors."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127
    codes = np.clip(np.rint(unit / scale[:, None]), -127, 127).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1)) + 1e-12
    return codes, scale, error


def may_link(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs whose quantised product plus its error bound reaches the threshold.

    Codes are multiplied as float32: products of int8 codes are whole numbers, and sums stay exact below 2**24,
    that is for up to 1040 dimensions; longer vectors are multiplied as float64.
    """
    kind = np.float32 if a[0].shape[1] <= 1040 else np.float64
    product = (a[0].astype(kind) @ b[0].T.astype(kind)).astype(np.float64) * a[1][:, None] * b[1][None, :]
    na, nb = (np.sqrt(((x[0] * x[1][:, None]) ** 2).sum(axis=1)) for x in (a, b))
    bound = a[2][:, None] * nb[None, :] + b[2][None, :] * na[:, None] + a[2][:, None] * b[2][None, :] + 1e-9
    return np.nonzero(product + bound >= threshold)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """Positions of the links that join two parts not joined before."""
    parent, out = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append(k)
    return out


def tile_links(left: tuple, right: tuple | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into left, and right or left) of the pairs with cosine >= threshold in double precision."""
    other = right or left
    units = [x / np.sqrt((x * x).sum(axis=1))[:, None] for x in (left[1], other[1])]
    i, j = may_link(quantise(units[0]), quantise(units[1]), threshold)
    if right is None:
        i, j = i[i < j], j[i < j]
    keep = []
    for at in range(0, len(i), 1 << 16):
        x, y = left[1][i[at : at + (1 << 16)]], other[1][j[at : at + (1 << 16)]]
        keep.append((x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= threshold)
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


class Tree:
    """Leaves over the main directions of a sample of unit vectors, all of one length; others have leaf 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.size = sample.shape[1] if len(sample) else 0
        self.axes = np.linalg.svd(sample, full_matrices=False)[2][:DIRECTIONS] if len(sample) else np.zeros((0, 0))
        self.splits: list[tuple[int, float]] = []  # (axis, value) of inner nodes, level by level
        parts = [self.places(sample)] if len(sample) else []
        while parts and 2 * len(parts) <= leaves:
            halves = []
            for part in parts:
                axis = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
                value = float(np.median(part[:, axis])) if len(part) else 0.0
                self.splits.append((axis, value))
                halves += [part[part[:, axis] < value], part[part[:, axis] >= value]]
            parts = halves
        self.depth = len(self.splits).bit_length()

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Coordinates along the directions, and the length of what is across them: distances between these are no larger than those of the vectors."""
        along = unit @ self.axes.T
        return np.column_stack([along, np.sqrt(np.maximum((unit * unit).sum(axis=1) - (along * along).sum(axis=1), 0))])

    def leaf(self, places: np.ndarray) -> np.ndarray:
        at = np.zeros(len(places), np.int64)
        if self.splits:
            axis, value = np.array([a for a, _ in self.splits]), np.array([v for _, v in self.splits])
            rows = np.arange(len(places))
            for _ in range(self.depth):
                at = 2 * at + 1 + (places[rows, axis[at]] >= value[at])
            at -= len(self.splits)
        return at


def matrix_of(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def near_leaves(boxes: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, list[int]]]:
    """For each leaf those whose boxes, lows and highs, are near enough for a link."""
    reach, out = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK, []
    for a, (low, high) in sorted(boxes.items()):
        gap = {b: np.maximum(0, np.maximum(low - h, lo - high)) for b, (lo, h) in boxes.items()}
        out.append((a, [b for b in sorted(boxes) if np.sqrt((gap[b] ** 2).sum()) <= reach]))
    return out


def prepared(batch: pa.RecordBatch, kind: str) -> pa.RecordBatch:
    """Vectors as bytes; null what can't link; -0.0 is 0.0."""
    column = batch.column("embedding")
    lengths = pc.unique(pc.list_value_length(column)).to_pylist()
    if column.null_count == 0 and len(lengths) == 1 and lengths[0] and column.flatten().null_count == 0:
        data = column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1) + np.zeros(1, kind)
        wide = data.astype(np.float64)
        with np.errstate(all="ignore"):
            size = (wide * wide).sum(axis=1)
        good = np.isfinite(wide).all(axis=1) & np.isfinite(size) & (size > 0)
        rows = [x.tobytes() if g else None for x, g in zip(data, good)]
    else:
        every = column.to_pylist()
        rows = [(np.asarray(x, dtype=kind) + np.zeros(1, kind)).tobytes() if usable(x) else None for x in every]
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(rows, pa.binary())], names=["vec_id", "label", "vector"])


def planted(classes: DataFrame, n: int, longest: int, leaves: int, kind: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """classes with their leaf, and (leaf, near): which leaves may hold links with each."""
    spark, wide = classes.sparkSession, int(kind[2])
    share = min(1.0, min(SAMPLE, SAMPLE_BYTES * wide // max(1, 8 * longest)) / n)
    drawn = classes.where((F.length("vector") == longest) & (F.pmod(F.xxhash64(F.lit("tree"), "vector"), F.lit(1 << 20)) < int(share * (1 << 20))))
    sample = [bytes(r.vector) for r in drawn.select("vector").collect()]
    tree = Tree(units(matrix_of(sample, kind)) if sample else np.zeros((0, 0)), leaves)
    shared, ends = spark.sparkContext.broadcast(tree), len(tree.axes) + 1

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, t = batch.column("vector").to_pylist(), shared.value
        at, leaf, places = np.array([len(x) == t.size * wide for x in raw], bool), np.zeros(len(raw), np.int32), np.full((len(raw), ends), np.nan)
        if at.any():
            places[at] = t.places(units(matrix_of([x for x, a in zip(raw, at) if a], kind)))
            leaf[at] = t.leaf(places[at])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(list(places), pa.list_(pa.float64()))], names=[*batch.schema.names, "leaf", "places"])

    fields = ", ".join(f"{name} {t}" for name, t in classes.dtypes)
    placed = cut(map_rows(classes, place, f"{fields}, leaf int, places array<double>"))
    known = F.filter("places", lambda x: ~F.isnan(x))  # vectors of another length are in leaf 0 with all others they compare with
    edges = [f(F.get(known, F.lit(i))).alias(f"{name}{i}") for i in range(ends) for name, f in (("low", F.min), ("high", F.max))]
    rows = placed.groupBy("leaf").agg(*edges).collect()  # a row a leaf
    boxes = {r.leaf: tuple(np.array([np.nan if r[f"{name}{i}"] is None else r[f"{name}{i}"] for i in range(ends)], float) for name in ("low", "high")) for r in rows}
    boxes = {leaf: (np.nan_to_num(low, nan=-np.inf), np.nan_to_num(high, nan=np.inf)) for leaf, (low, high) in boxes.items()}
    return placed.drop("places"), spark.createDataFrame(near_leaves(boxes, threshold), "leaf int, near array<int>")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, part: int = PART, leaves: int = LEAVES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine is at least the threshold. Unusable
    vectors (null, zero, null or non-finite components, or another length than those compared) and null
    labels link with nothing. Equal vectors of a label are one class: they link with each other without being
    compared, and a class is compared once. Rows with a repeated vec_id count as vectors of their own. A cosine
    equal to the threshold links; links have no order, so there are no other ties. Other columns, whatever their names,
    are left out; vectors may be of any length; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    tune(spark)
    kind = "<f4" if "float" in dict(vectors.dtypes)["embedding"] else "<f8"
    label = dict(vectors.dtypes)["label"]
    rows = cut(map_rows(vectors.select("vec_id", "label", "embedding"), lambda batch: prepared(batch, kind), f"vec_id bigint, label {label}, vector binary"))
    able = "label is not null and vector is not null"
    # a class: a label's equal vectors; null vec_ids are ids like others, after all numbers
    classes = rows.where(able).groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("node", F.xxhash64("label", "vector", F.length("vector"))))
    mixed = [r.node for r in classes.groupBy("node").count().where("count > 1").collect()]  # classes of one 64-bit hash: a handful among ten billion
    if mixed:
        classes = classes.withColumn("node", F.when(F.col("node").isin(mixed), F.xxhash64(F.lit("second"), "label", "vector")).otherwise(F.col("node")))

    n, largest, longest = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.length("vector")).alias("size")).agg(F.sum("n"), F.max("n"), F.max("size")).first()
    wanted = 1 << max(0, min(leaves, -(-(largest or 0) // part)).bit_length() - 1)
    if wanted == 1:
        placed, near = classes.withColumn("leaf", F.lit(0)), spark.createDataFrame([(0, [0])], "leaf int, near array<int>")
    else:
        placed, near = planted(classes, n, longest, wanted, kind, threshold)
    # (label, leaf, parts): each leaf of a label in parts of bounded size
    per = cut(placed.groupBy("label", "leaf").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")))
    every = per.groupBy("label").agg(F.collect_list(F.struct("leaf", "parts")).alias("every"))  # at most LEAVES a label
    known = per.join(every, "label").join(F.broadcast(near), "leaf")
    known = F.broadcast(known) if per.count() <= BROADCAST_LABELS else known
    own = placed.drop("rep").join(known, ["label", "leaf"]).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "vector"), F.col("parts")).cast("int"))
    own = own.withColumn("here", F.struct("leaf", "part"))
    met = F.flatten(F.transform(F.filter("every", lambda x: F.array_contains("near", x["leaf"])), lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda k: F.struct(x["leaf"].alias("leaf"), k.alias("part")))))
    tiled = own.withColumn("other", F.explode(met)).select("label", F.greatest("here", "other").alias("i"), F.least("here", "other").alias("j"), "here", "node", "copies", "vector")
    tiled = tiled.select("label", F.concat_ws("/", "i.leaf", "i.part").alias("i"), F.concat_ws("/", "j.leaf", "j.part").alias("j"), F.concat_ws("/", "here.leaf", "here.part").alias("here"), "node", "copies", "vector")

    def tile(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, raw = pc.equal(table.column("here"), i).to_numpy(), table.column("vector").to_pylist()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        out_node, out_n, out_a, out_b = [], [], [], []
        for n in sorted({len(x) for x in raw}):  # vectors of another length never compare
            same = np.array([len(x) == n for x in raw])
            own, num, at, data = node[same], copies[same], left[same], matrix_of([x for x, s in zip(raw, same) if s], kind)
            order = np.argsort(own, kind="stable")
            data, own, num, at = data[order], own[order], num[order], at[order]
            a, b = np.flatnonzero(at), np.flatnonzero(at if i == j else ~at)
            xs, ys = [], []
            for p in range(0, len(a), block):
                for q in range(p if i == j else 0, len(b), block):
                    u, v = a[p : p + block], b[q : q + block]
                    x, y = tile_links((own[u], data[u]), None if i == j and p == q else (own[v], data[v]), threshold)
                    xs.append(u[x])
                    ys.append(v[y])
            x, y = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (xs, ys))
            links = np.bincount(x, weights=num[y], minlength=len(own)) + np.bincount(y, weights=num[x], minlength=len(own))
            hit = links > 0
            out_node.append(own[hit])
            out_n.append(links[hit].astype(np.int64))
            keep = forest(x, y, len(own))
            out_a.append(own[x[keep]])
            out_b.append(own[y[keep]])
        counts, ca, cb = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (out_n, out_a, out_b))
        nodes = np.concatenate(out_node) if out_node else np.zeros(0, np.int64)
        none = pa.nulls(len(ca), pa.int64())
        return pa.table({"a": pa.concat_arrays([pa.array(nodes), pa.array(ca)]), "b": pa.concat_arrays([pa.nulls(len(nodes), pa.int64()), pa.array(cb)]), "n": pa.concat_arrays([pa.array(counts), none])})

    found = cut(tiled.groupBy("label", "i", "j").applyInArrow(tile, "a bigint, b bigint, n bigint"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null"))
    # the smallest vec_id of a component
    class_roots = placed.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = class_roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = placed.select("label", "vector", "node", "copies").join(links, "node", "left").join(class_roots.select("node", "root").join(lowest, "root"), "node").drop("node", "root")
    joined = rows.withColumn("_hash", F.xxhash64("label", "vector")).join(known.withColumn("_hash", F.xxhash64("label", "vector")), ["_hash", "label", "vector"], "left")
    out = joined.select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7(spark, sf_dir):
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op7_sql() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= {THRESHOLD}),
reach AS (SELECT vec_id AS x, vec_id AS r FROM v UNION SELECT p.x, reach.r FROM reach JOIN pairs p ON p.y = reach.x),
roots AS (SELECT x, min(r) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM pairs GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, roots.component_id, v.vec_id = roots.component_id AS kept
FROM v JOIN roots ON roots.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id"""
