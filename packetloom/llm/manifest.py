"""Merkle manifest of a dataset: a hash tree of fan-out 3 over the rows of each source, and one over the sources' roots.

The tree is cut into aligned subtrees of a fixed height ("blocks"). A block is one row of a table; its digests lie in van Emde Boas
order, that is, the upper half of its levels first, then each lower subtree, and so on within each. Places of nodes are computed, never
stored, both when a block is built and when the siblings of a leaf are read. The roots of blocks are the leaves of the next tier of
blocks, up to a single one, so that no task holds more than a block whatever the size of a source.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, materialise, preceding, table

FANOUT = 3
#: Levels of edges in a block: 729 leaves, 1093 digests.
BLOCK_HEIGHT = 6
BYTES, DIGITS = 32, 64


@lru_cache
def places(levels: int) -> list[np.ndarray]:
    """For each depth of a whole tree of so many levels, where its nodes stand in van Emde Boas order."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    upper = levels // 2
    top, bottom = places(upper), places(levels - upper)
    begins = sum(map(len, top)) + sum(map(len, bottom)) * np.arange(FANOUT**upper)
    return [*top, *((begins[:, None] + p[None, :]).ravel() for p in bottom)]


def height_of(block: int, leaves: int, most: int) -> int:
    """Levels that a block spans. Only the first block of a tier may be the tree's only one; then it ends at its single root."""
    height = most
    while block == 0 and height and FANOUT ** (height - 1) >= leaves:
        height -= 1
    return height


def build(leaves: list[bytes], height: int) -> bytes:
    """The digests of a block in van Emde Boas order, from those of its leaves; places without a node are zero."""
    layout = places(height + 1)
    store = np.zeros((sum(map(len, layout)), BYTES), np.uint8)
    nodes = b"".join(leaves)
    for depth in range(height, -1, -1):
        store[layout[depth][: len(nodes) // BYTES]] = np.frombuffer(nodes, np.uint8).reshape(-1, BYTES)
        if depth:
            digits = nodes.hex().encode()
            nodes = b"".join(sha256(digits[i : i + FANOUT * DIGITS]).digest() for i in range(0, len(digits), FANOUT * DIGITS))
    return store.tobytes()


class Block:
    """A stored block, opened to read siblings."""

    def __init__(self, number: int, leaves: int, store: bytes, most: int):
        self.height = height_of(number, leaves, most)
        digests = np.frombuffer(store, np.uint8).reshape(-1, BYTES)
        self.levels = [digests[p[: -(-leaves // FANOUT ** (self.height - d))]].tobytes().hex().encode() for d, p in enumerate(places(self.height + 1))]

    def leaf(self, i: int) -> bytes:
        return self.levels[self.height][i * DIGITS : (i + 1) * DIGITS]

    def path(self, i: int) -> list[tuple[bytes, bytes]]:
        """For each level from the leaf up, the digests (as hex) left and right of the node in its run of three."""
        out = []
        for depth in range(self.height, 0, -1):
            level, first = self.levels[depth], i - i % FANOUT
            out.append((level[first * DIGITS : i * DIGITS], level[(i + 1) * DIGITS : (first + FANOUT) * DIGITS]))
            i //= FANOUT
        return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root (as hex) that a leaf and the siblings on its path give."""
    for left, right in path:
        digest = sha256(left + digest + right).hexdigest().encode()
    return digest


def row_digest(fields: list[Column]) -> Column:
    """SHA-256 (as hex) of fields, each as its length in UTF-8 bytes, a colon and its text; null is a dash."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _tiers(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes: (tree, place, digest), places gapless from 0 in each tree. Returns the tables of blocks (tree, block, leaves, store, root,
    only), lowest tier first, and (tree, root)."""
    width = FANOUT**height

    def made(key: tuple, rows: pa.Table) -> pa.Table:
        block = key[1].as_py()
        store = build(rows.sort_by("place")["digest"].to_pylist(), height_of(block, len(rows), height))
        columns = {"tree": key[0].as_py(), "block": block, "leaves": len(rows), "store": store, "root": store[:BYTES]}
        return pa.Table.from_pylist([columns])

    tiers: list[DataFrame] = []
    roots: DataFrame | None = None
    while True:
        dealt = nodes.withColumn("block", F.expr(f"place div {width}")).groupBy("tree", "block")
        blocks = materialise(dealt.applyInArrow(made, "tree string, block long, leaves long, store binary, root binary"), "blocks")
        tiers.append(blocks)
        many = blocks.where("block > 0").select("tree").distinct()
        done = blocks.select("tree", "root").join(many, "tree", "left_anti")
        roots = done if roots is None else roots.union(done)
        nodes = blocks.join(many, "tree", "left_semi").select("tree", F.col("block").alias("place"), F.col("root").alias("digest"))
        if nodes.isEmpty():
            return tiers, roots


PATH = "subroot string, lefts array<string>, rights array<string>"


def _climb(nodes: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """nodes: (tree, place); blocks with the path above their roots. Returns (tree, place, subroot, lefts, rights): the whole path."""

    def walk(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        block, above = _opened(key, found, height)
        out = []
        for place in rows["place"].to_pylist():
            path = [(left.decode(), right.decode()) for left, right in block.path(place % FANOUT**height)]
            lefts, rights = [p[0] for p in path] + above["lefts"], [p[1] for p in path] + above["rights"]
            out.append({"tree": key[0].as_py(), "place": place, "subroot": above["subroot"], "lefts": lefts, "rights": rights})
        return pa.Table.from_pylist(out, pa.schema([("tree", pa.string()), ("place", pa.int64()), ("subroot", pa.string()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))]))

    dealt = nodes.select("tree", "place", F.expr(f"place div {FANOUT**height}").alias("block"))
    return dealt.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(walk, f"tree string, place long, {PATH}")


def _opened(key: tuple, found: pa.Table, height: int) -> tuple[Block, dict]:
    above = found.to_pylist()[0]
    return Block(key[1].as_py(), above["leaves"], above["store"], height), above


def _with_paths(tiers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The lowest tier with the path above each block's root. tops: (tree, subroot, lefts, rights), the path above each tree's root."""
    paths: DataFrame | None = None
    for tier, blocks in reversed(list(enumerate(tiers))):
        many = blocks.where("block > 0").select("tree").distinct()
        above = blocks.join(many, "tree", "left_anti").select("tree", "block").join(tops, "tree")
        if paths is not None:
            above = above.union(paths.select("tree", F.col("place").alias("block"), "subroot", "lefts", "rights"))
        whole = blocks.join(above, ["tree", "block"])
        if not tier:
            return whole
        lower = tiers[tier - 1]
        below = lower.join(lower.where("block > 0").select("tree").distinct(), "tree", "left_semi")
        paths = _climb(below.select("tree", F.col("block").alias("place")), whole, height)
    raise ValueError("a manifest has one tier at least")


@dataclass
class Manifest:
    """leaves: the rows' id and leaf (hex) with tree, place and changed; sources and overall: tiers of blocks, lowest first; subroots:
    (tree, root) of each source; root: hex, None for a table without rows."""

    leaves: DataFrame
    sources: list[DataFrame]
    overall: list[DataFrame]
    subroots: DataFrame
    root: str | None
    height: int
    id_col: str

    def proofs(self) -> DataFrame:
        """(id, leaf, subroot, root, proof_sha256, folded_root, verified): a row for each row of the table. proof_sha256 is the digest of
        the siblings from the leaf up; folded_root is what they give with the changed leaf (the row's own where nothing is changed)."""
        height, width, id_col = self.height, FANOUT**self.height, self.id_col
        top = self.overall[-1].select("tree", "block", F.lit(None).cast("string").alias("subroot"), F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"))
        overall = _with_paths(self.overall, top.drop("block"), height)
        of_source = _climb(self.subroots.select(F.lit("").alias("tree"), "place"), overall, height).select("place", "lefts", "rights")
        tops = self.subroots.join(of_source, "place").select("tree", F.lower(F.hex("root")).alias("subroot"), "lefts", "rights")
        blocks = _with_paths(self.sources, tops, height)
        kind = self.leaves.schema[id_col].dataType.simpleString()

        def prove(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
            block, above = _opened(key, found, height)
            upper = [(left.encode(), right.encode()) for left, right in zip(above["lefts"], above["rights"])]
            leaves, proofs, folded = [], [], []
            for place, changed in zip(rows["place"].to_pylist(), rows["changed"].to_pylist()):
                leaf, path = block.leaf(place % width), block.path(place % width) + upper
                leaves.append(leaf.decode())
                proofs.append(sha256(b"".join(left + right for left, right in path)).hexdigest())
                folded.append(fold(leaf if changed is None else changed.hex().encode(), path).decode())
            columns = [rows[id_col], *map(pa.array, (leaves, [above["subroot"]] * len(rows), proofs, folded), [pa.string()] * 4)]
            return pa.table(columns, names=[id_col, "leaf", "subroot", "proof_sha256", "folded_root"])

        dealt = self.leaves.select(id_col, "tree", "place", "changed", F.expr(f"place div {width}").alias("block"))
        out = dealt.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(prove, f"`{id_col}` {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
        root = F.lit(self.root).cast("string")
        return out.select(id_col, "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def manifest(rows: DataFrame, fields: list[str], id_col: str = "doc_id", source_col: str = "source", changed: dict[str, Column] | None = None, height: int = BLOCK_HEIGHT) -> Manifest:
    """The manifest of a table: a leaf for each row, its digest that of the named fields.

    Leaves of a source (null is a source of its own) stand by id, null ids first, rows of one id by their digest; equal rows are leaves
    of their own. Sources stand in byte order, null first. A tree of one leaf is that leaf. changed gives other contents of fields, to be
    held against the manifest by proofs(). Other columns, whatever their names, play no part. An empty table has no root and no proofs."""
    now = [F.col(f) for f in fields]
    then = [(changed or {}).get(f, F.col(f)) for f in fields]
    differs = F.lit(False)
    for a, b in zip(now, then):
        differs = differs | ~a.eqNullSafe(b)
    digest, other = F.unhex(row_digest(now)), F.when(differs, F.unhex(row_digest(then)))
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))  # in the order of sources, null first
    hashed = materialise(rows.select(F.col(id_col), tree.alias("tree"), digest.alias("digest"), other.alias("changed")), "digests")
    leaves = materialise(preceding(hashed, ["tree"], [F.col(id_col), F.col("digest")], F.lit(1), "place"), "leaves")
    sources, roots = _tiers(leaves.select("tree", "place", "digest"), height)
    subroots = materialise(preceding(materialise(roots, "roots"), [], [F.col("tree")], F.lit(1), "place"), "subroots")
    overall, root = _tiers(subroots.select(F.lit("").alias("tree"), "place", F.col("root").alias("digest")), height)
    last = root.first()
    return Manifest(leaves, sources, overall, subroots, last["root"].hex() if last else None, height, id_col)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc_fold(F.col("doc_id"), 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed={"text": tampered}).proofs()
