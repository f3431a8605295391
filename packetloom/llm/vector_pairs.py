"""Near-duplicate vectors by randomly rotated binary codes with correction factors (Gao and Long, 2024).

1. Equal vectors of a label are one class, with a count and a smallest id.
2. Each class is normalised and rotated. Stored are the signs of its coordinates (its code, one bit each), the inner product of
   code and vector (its correction factor), and its rotated coordinates rounded to a byte each (for its turn as a query).
3. Blocks of one label meet in pairs; only what is stored travels. The code of one and the rounded coordinates of the other give
   an estimate of the cosine without bias, and a bound on its error decides: pairs that the bound puts below the threshold are
   dropped. What leaves a task is which vectors have a pair left, never the pairs.
4. Those vectors, now whole, meet in the same pairs of blocks; what the bound leaves is recomputed in double precision.

A task holds two blocks at most, and a pair is looked at once. The work is quadratic in the classes of a label.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise, table

THRESHOLD = 0.93
#: Vectors in a block, about.
BLOCK = 4096
#: Standard deviations of the estimate that a pair may lie below the threshold before it is dropped unseen. At 6 a link is
#: lost with a chance of about one in 10^9.
CONFIDENCE = 6.0
#: Rows of a block that are compared at a time.
STRIPE = 256
#: Labels whose block counts are broadcast at most. Classes that hold more than one in HOT_SHARE rows are joined apart: there are
#: fewer than HOT_SHARE of them.
BROADCAST_LABELS, HOT_SHARE = 10_000, 1000


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 3) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is stored of unit vectors: codes (a bit a coordinate, packed), correction factors <code, vector>, and the rotated
    coordinates as bytes with the step between two of them."""
    turned = unit @ rotation(unit.shape[1])
    factor = np.abs(turned).sum(1) / np.sqrt(unit.shape[1])
    step = np.abs(turned).max(1) / 127
    return np.packbits(turned >= 0, axis=1), factor, np.rint(turned / step[:, None]).astype(np.int8), step


def likely(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], dim: int, threshold: float, same: bool, confidence: float = CONFIDENCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (in the rounded coordinates and steps `left`, in the codes and factors `right`) that the bound leaves."""
    rounded, step = left
    packed, factor = right
    # <code, other> / factor has mean <vector, other>; the part of other across the vector spreads it by this much:
    spread = np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1))
    # A pair at the threshold t has sqrt(1 - t^2) of the query across the vector; nearer pairs have less.
    low = threshold - confidence * spread * np.sqrt(max(0.0, 1 - threshold**2)) - 1e-5
    scaled = np.where(np.unpackbits(packed, axis=1, count=dim) > 0, 1, -1).astype(np.float32) / (np.sqrt(dim) * factor[:, None]).astype(np.float32)
    scaled, low = scaled.T.copy(), low.astype(np.float32)
    # Rounding moves a coordinate by half a step at most, and so <code, other> by that times the root of dim.
    off = np.float32(np.sqrt(dim) / 2) * step.astype(np.float32)[:, None] / factor.astype(np.float32)
    for at in range(0, len(rounded), STRIPE):
        part = slice(at, at + STRIPE)
        i, j = np.nonzero((rounded[part].astype(np.float32) * step[part, None].astype(np.float32)) @ scaled + off[part] >= low)
        i += at
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i):
            yield i, j


class Forest:
    """Joins nodes 0 to n - 1; the least of a tree is its root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def join_all(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins all pairs. A pair whose ends a tree already joins adds nothing: one pair a tree and round, until none is left."""
        while len(i):
            nodes, place = np.unique(np.concatenate((i, j)), return_inverse=True)
            roots = np.array([self.root(k) for k in nodes.tolist()], np.int64)[place]
            ri, rj = roots[: len(i)], roots[len(i) :]
            apart = ri != rj
            i, j = i[apart], j[apart]
            for k in np.unique(ri[apart], return_index=True)[1].tolist():
                self.join(int(i[k]), int(j[k]))


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> Column:
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~odd & F.exists(vector_col, lambda x: x != 0), F.lit(False))


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Usable rows (id, label, v), and classes of equal ones (node, label, v, n, low)."""
    rows = vectors.where(_usable(vectors, id_col, vector_col, label_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    classes = rows.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    return rows, materialise(classes.select(F.monotonically_increasing_id().alias("node"), "label", "v", "n", "low"), "vector-classes")


def _stored(classes: DataFrame, block: int) -> DataFrame:
    """(node, label, dim, blocks, block, code, factor, rounded, step), written."""
    sizes = classes.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    small = sizes.count() <= BROADCAST_LABELS
    placed = classes.withColumn("dim", F.size("v")).join(F.broadcast(sizes) if small else sizes, ["label", "dim"])
    placed = placed.select("node", "label", "dim", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "v")
    label = classes.schema["label"].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                code, factor, rounded, step = encode(_unit(part.column("v"), dim))
                columns = [*part.columns[:5], pa.array([x.tobytes() for x in code]), pa.array(factor), pa.array([x.tobytes() for x in rounded]), pa.array(step)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:5], "code", "factor", "rounded", "step"])

    return materialise(placed.mapInArrow(store, f"node long, label {label}, dim int, blocks int, block int, code binary, factor double, rounded binary, step double"), "vector-codes")


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # neither squares too large nor too small
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bytes(values: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(-1, width)


def _pairs_of_blocks(stored: DataFrame) -> DataFrame:
    """Block b meets every block of its label once: as the first of the pairs (b, b..), as the second of (..b, b)."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return stored.select("*", other.alias("other")).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("blocks", "other")


def _hopeful(stored: DataFrame, threshold: float) -> DataFrame:
    """(node, label, dim, first, second, block): the vectors that the bound leaves a pair, by pair of blocks."""
    label = stored.schema["label"].dataType.simpleString()

    def estimate(rows: pa.Table) -> pa.Table:
        dim = rows["dim"][0].as_py()
        one, a, b = _sides(rows)
        keep = np.zeros(len(one), bool)
        if len(a) and len(b):
            code, rounded = _bytes(rows["code"], -(-dim // 8), np.uint8), _bytes(rows["rounded"], dim, np.int8)
            factor, step = rows["factor"].to_numpy(), rows["step"].to_numpy()
            for i, j in likely((rounded[a], step[a]), (code[b], factor[b]), dim, threshold, a is b):
                keep[a[i]] = keep[b[j]] = True
        return rows.filter(pa.array(keep)).select(["node", "label", "dim", "first", "second", "block"])

    return _pairs_of_blocks(stored).groupBy("label", "dim", "first", "second").applyInArrow(estimate, f"node long, label {label}, dim int, first int, second int, block int")


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are of the first block, and the places of both sides; one and the same for a block with itself."""
    one = rows["block"].to_numpy() == rows["first"].to_numpy()
    if rows["first"][0] == rows["second"][0]:
        a = b = np.arange(len(one))
    else:
        a, b = np.flatnonzero(one), np.flatnonzero(~one)
    return one, a, b


def _verified(hopeful: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): how many rows a class is linked to, and a smaller class that links of a task join it to."""
    whole = hopeful.join(classes.select("node", "v", "n"), "node")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        x = _unit(rows["v"].combine_chunks(), rows["dim"][0].as_py())
        node, n = rows["node"].to_numpy(), rows["n"].to_numpy()
        _, a, b = _sides(rows)
        links, forest = np.zeros(len(node), np.int64), Forest(len(node))
        code, factor, rounded, step = encode(x)
        for i, j in likely((rounded[a], step[a]), (code[b], factor[b]), x.shape[1], threshold, a is b):
            for at in range(0, len(i), 1 << 14):
                p, q = a[i[at : at + (1 << 14)]], b[j[at : at + (1 << 14)]]
                linked = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                p, q = p[linked], q[linked]
                np.add.at(links, p, n[q])
                np.add.at(links, q, n[p])
                forest.join_all(p, q)
        keep = links > 0
        root = np.array([forest.root(k) for k in range(len(node))], np.int64)
        return pa.table({"node": node[keep], "links": links[keep], "root": node[root[keep]]})

    return whole.groupBy("label", "dim", "first", "second").applyInArrow(compare, "node long, links long, root long")


def vector_links(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of vectors; other columns are not read.

    Only vectors with the same non-null label and length are compared. Null, empty and zero vectors, those with null or non-finite
    components and those with a null id link with nothing; a null id has a null component and is kept. Rows with the same id are
    vectors of their own, each with its own links; kept compares ids. An empty input gives no rows.
    """
    rows, classes = _classes(vectors, id_col, vector_col, label_col)
    found = materialise(_verified(_hopeful(_stored(classes, block), threshold), classes, threshold), "links")
    component = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = classes.select("node", "label", "v", "n", "low").join(degree, "node", "left").join(component, "node", "left")
    lowest = linked.where("component is not null").groupBy("component").agg(F.min("low").alias("least"))
    result = linked.join(lowest, "component", "left").where("n > 1 or least is not null").select("label", "v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id"))
    result = materialise(result, "vector-results")
    # A class may hold a large share of all rows: few can, and these are joined without a shuffle.
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(1, total // HOT_SHARE)
    known = rows.join(F.broadcast(result.where(hot)), ["label", "v"])
    others = rows.join(F.broadcast(result.where(hot).select("label", "v")), ["label", "v"], "left_anti").join(result.where(~hot), ["label", "v"], "left")
    columns = ("id", "n_links", "component_id")
    usable = known.select(*columns).union(others.select(*columns))
    alone = vectors.where(~_usable(vectors, id_col, vector_col, label_col)).select(F.col(id_col).alias("id"), F.lit(0), F.col(id_col))
    out = usable.union(alone).select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))
