"""Exact Jaccard join of documents on word shingles by T-occurrence search (DivideSkip, Li et al., 2008).

1. Each text becomes its set of hashed shingles. Equal sets are one class from here on; its smallest id stands for it.
2. A partner shares at least ceil(0.8 n) of a set's n shingles, so a set with more than n // 5 shingles that no other set has
   can be put aside. A first count over a hash-chosen share of the shingle space, then a full one over what is left, finds
   those sets exactly (a share can only undercount).
3. Shingles that the same sets hold are one entry with a weight: its name is a hash of its inverted list. Sets shrink to
   weighted lists of entries, rarest first.
4. Two similar sets share an entry among their rarest n // 5 + 1 shingles. What such entries connect is a neighbourhood; one of
   bounded size goes to one task, each set once. Larger ones go there list by list, long lists in pairs of blocks.
5. In a task, DivideSkip answers each set as a query: it merges the short inverted lists and binary-probes the long ones. Pairs
   that earlier links of the task already join are not looked at again; only joining links leave the task.
6. Components of the links, over class representatives.

Exact up to hashes: words have 64-bit hashes of XXH3, shingles a mixed sum of five of these, sets a mixed sum of their shingles'. Two
different shingles or sets meet with a chance of 1 in 10^19 a pair. What the join returns are components, not links: pairs that
earlier links already join are not verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, connected_components, cut, flat, long_values, materialise, shuffle_partitions, slices, table, unused
from .vector_pairs import Forest

SHINGLE_WORDS = 5
#: Two sets link when 100 |A and B| >= PERCENT |A or B|.
PERCENT = 80
#: Share of the shingle space that the first count covers.
FIRST_SHARE = 0.3
#: Sets in a block of a long list; sampled shingles that a task gathers before it deals them out; ids that are broadcast at most.
BLOCK, GATHERED, BROADCAST_IDS = 4096, 1 << 19, 1_000_000
#: A neighbourhood of so many sets, or bytes of entries, goes to one task at most.
TOGETHER_SETS, TOGETHER_BYTES = 4096, 16 << 20
#: Weighs the cost of probing against that of merging when lists are divided into long and short.
MU = 0.05

#: Bytes of text that are split into words at once.
SPLIT_BYTES = 2 << 20
#: Bytes of text whose sampled shingles, about four million, one bucket of the first count takes.
BUCKET_BYTES = 80 << 20
#: A key that more than one in HOT_SHARE rows hold is joined apart, by broadcast: there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: One in so many sets tells which shingles are hot. This routes rows, it changes no result.
ROUTING_SAMPLE = 64

#: Lower case of A-Z, and one kind of white space.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b" " * 5)
#: Odd weights of the words of a shingle.
WEIGHTS = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, A-Z in lower case; of all words as one where there are fewer."""
    for part in by_bytes(texts, SPLIT_BYTES):
        yield from _shingles_of(part, k)


def _shingles_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    raw, offsets = flat(texts)
    data = np.frombuffer(raw.translate(FOLD), np.uint8)
    solid = data != 32
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = solid[firsts]
    word_of = np.searchsorted(np.flatnonzero(begins), offsets)
    words = cut(data[solid], np.flatnonzero(begins[solid])).dictionary_encode()
    hashed = np.array([xxhash.xxh3_64_intdigest(w, 7) for w in slices(words.dictionary)], np.uint64)[words.indices.to_numpy()]
    rows = max(0, len(hashed) - k + 1)
    sums = np.zeros(rows, np.uint64)
    for n in range(k):
        sums += hashed[n : n + rows] * WEIGHTS[n]
    sums = _mixed(sums)
    for a, b in zip(word_of[:-1].tolist(), word_of[1:].tolist()):
        if b - a >= k:
            yield np.unique(sums[a : b - k + 1])
        elif b > a:
            yield _mixed((hashed[a:b] * WEIGHTS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def shingles(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), k))


def set_key(tokens: np.ndarray) -> int:
    """A hash of a set, as a signed long: 0 for the empty set alone."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        value = _mixed(np.array([np.add.reduce(_mixed(tokens + np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(tokens))], np.uint64))
    return int(value.astype(np.int64)[0]) or 1


def _first_count(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """A row per document (set_key, id, n), and rows (part, owners, alone) that say how many of a set's sampled shingles no other
    set has, as seen by one bucket of the shingle space."""
    limit = np.uint64(int(FIRST_SHARE * 2**64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        keys: list[int] = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            # Documents go to buckets by place, shingles by value.
            rows: list[tuple] = []
            for at in range(0, len(ids), 4096):
                cut = slice(at, at + 4096)
                rows.append((abs(hash((keys[at], len(ids), at))) % buckets, ids[cut], keys[cut], sizes[cut], None, None))
            if parts:
                token, owner = np.concatenate(parts), np.concatenate(owners)
                order = np.argsort(token)
                token, owner = token[order], owner[order]
                first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
                low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
                token, owner = token[first], np.where(low == high, low, 0)  # 0: held by several sets already
                bucket = (token % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in range(buckets):
                    mine = order[cuts[b] : cuts[b + 1]]
                    if len(mine):
                        rows.append((b, None, None, None, token[mine].tobytes(), owner[mine].tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 6
            for kept in (ids, keys, sizes, parts, owners):
                kept.clear()
            kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["bucket", "ids", "keys", "sizes", "tokens", "owners"])

        gathered = 0
        for batch in batches:
            for i, tokens in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))):
                key = set_key(tokens)
                ids.append(i), keys.append(key), sizes.append(len(tokens))
                sample = tokens[: np.searchsorted(tokens, limit)]
                if len(sample):
                    parts.append(sample), owners.append(np.full(len(sample), key, np.int64))
                    gathered += len(sample)
                if gathered >= GATHERED or len(ids) >= 1 << 16:
                    yield flush()
                    gathered = 0
            pa.default_memory_pool().release_unused()
        yield flush()

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, keys, sizes in zip(rows["ids"], rows["keys"], rows["sizes"]):
            if keys is not None:
                out.append(pd.DataFrame({"set_key": pd.array(list(keys), "Int64"), "id": pd.array(list(ids), "Int64"), "n": pd.array(list(sizes), "Int64"), "part": pd.array([pd.NA] * len(keys), "Int32"), "owners": None, "alone": None}))
        token = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in rows["tokens"] if x is not None)])
        if len(token):
            owner = np.concatenate([np.frombuffer(x, np.int64) for x in rows["owners"] if x is not None])
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
            key, alone = np.unique(low[(low == high) & (low != 0)], return_counts=True)
            part = key % buckets
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(buckets + 1))
            blobs = [(b, key[order[cuts[b] : cuts[b + 1]]].tobytes(), alone[order[cuts[b] : cuts[b + 1]]].astype(np.int32).tobytes()) for b in range(buckets) if cuts[b] < cuts[b + 1]]
            none = pd.array([pd.NA] * len(blobs), "Int64")  # not a float anywhere: keys need all their bits
            parts, owners, alone = zip(*blobs) if blobs else ((), (), ())
            out.append(pd.DataFrame({"set_key": none, "id": none, "n": none, "part": pd.array(list(parts), "Int32"), "owners": list(owners), "alone": list(alone)}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("set_key", "id", "n", "part", "owners", "alone")})

    dealt = docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(deal, "bucket int, ids array<long>, keys array<long>, sizes array<long>, tokens binary, owners binary")
    return dealt.groupBy("bucket").applyInPandas(count, "set_key long, id long, n long, part int, owners binary, alone binary")


def _alone(first: DataFrame) -> DataFrame:
    """(set_key, alone): the counts of all buckets added up."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(x, np.int64) for x in rows["owners"]])
        alone = np.concatenate([np.frombuffer(x, np.int32) for x in rows["alone"]])
        key, place = np.unique(key, return_inverse=True)
        return pd.DataFrame({"set_key": key, "alone": np.bincount(place, alone).astype(np.int64)})

    return first.where("part is not null").select("part", "owners", "alone").groupBy("part").applyInPandas(add, "set_key long, alone long")


def _weighted_sets(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, n, shared, entries array<(df, x, w)>): the sets that may have a partner, as weighted entries; a node is a set's key, x
    names an inverted list of df sets."""
    small = chosen.count() <= BROADCAST_IDS
    named = chosen.where("rep is not null")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(F.broadcast(named) if small else named, "rep")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets = [], []
            for key, tokens in zip(batch.column(1).to_pylist(), shingle_sets(batch.column(0))):
                found = set_key(tokens)
                if key is None or key == found:  # another row may have the same id and another text
                    keys.append(found), sets.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "tokens"])

    kinds = "node long, n long, tokens array<long>"
    # Sets that only rows without an id have cannot be asked for by id: all such rows are read.
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(text_col).alias("text"), F.lit(None).cast("long").alias("set_key")).mapInArrow(read, kinds)
    nameless = nameless.join(chosen.where("rep is null").select(F.col("set_key").alias("node")), "node", "left_semi")
    sets = materialise(texts.select("text", "set_key").mapInArrow(read, kinds).union(nameless).dropDuplicates(["node"]), "sets")
    postings = sets.select("node", "n", F.explode("tokens").alias("token"))
    sample = sets.where(F.pmod(F.xxhash64("node"), F.lit(ROUTING_SAMPLE)) == 0).select(F.explode("tokens").alias("token"))
    expected = max(50, sets.count() // (ROUTING_SAMPLE * HOT_SHARE))
    hot = sample.groupBy("token").count().where(F.col("count") > expected).orderBy(F.desc("count"), "token").limit(HOT_SHARE * HOT_SHARE).select("token")
    common, others = postings.join(F.broadcast(hot), "token"), postings.join(F.broadcast(hot), "token", "left_anti")

    def lists(of: DataFrame) -> DataFrame:
        return of.groupBy("token").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("node")).alias("x")).where("df > 1")

    both = common.join(F.broadcast(lists(common)), "token").union(others.join(lists(others), "token"))
    entries = both.repartition("node").groupBy("node", "n", "df", "x").agg(F.count("*").alias("w"))
    return entries.groupBy("node", "n").agg(F.sum("w").alias("shared"), F.collect_list(F.struct("df", "x", "w")).alias("entries")).where("shared >= n - n div 5")


def _prepared(weighted: DataFrame) -> DataFrame:
    """(node, n, entries, weights, rare, lengths): entries by name as bytes, and the rarest with the lengths of their lists."""

    def sort(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for node, n, shared, entries in zip(frame["node"], frame["n"], frame["shared"], frame["entries"]):
                entries = sorted((e["df"], e["x"], e["w"]) for e in entries)
                names, weights = np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries], np.int64)
                before = n - shared + np.cumsum(weights) - weights  # shingles that no other set has come first
                rare = entries[: int(np.searchsorted(before, n // 5, "right"))]
                order = np.argsort(names)
                out.append((node, n, names[order].tobytes(), weights[order].astype(np.int32).tobytes(), [e[1] for e in rare], [e[0] for e in rare]))
            yield pd.DataFrame(out, columns=["node", "n", "entries", "weights", "rare", "lengths"])

    return weighted.mapInPandas(sort, "node long, n long, entries binary, weights binary, rare array<long>, lengths array<long>")


def _tasks(prepared: DataFrame, buckets: int) -> DataFrame:
    """(bucket, x, first, second, block, node, n, entries, weights): a row per set and place where it is compared; x is a
    neighbourhood or, in large ones, a list."""
    near = connected_components(prepared.select(F.col("node").alias("a"), F.explode("rare").alias("b")))
    placed = prepared.join(near.withColumnRenamed("component", "x"), "node")
    sizes = placed.groupBy("x").agg(F.count("*").alias("sets"), F.sum(F.octet_length("entries") * 1.5).alias("bytes")).where("sets > 1")
    fits = (F.col("sets") <= TOGETHER_SETS) & (F.col("bytes") <= TOGETHER_BYTES)
    zero = F.lit(0)
    carried = ("node", "n", "entries", "weights")
    small = placed.join(sizes.where(fits).select("x"), "x").select("x", zero.alias("first"), zero.alias("second"), zero.alias("block"), *carried)
    large = placed.join(sizes.where(~fits).select("x"), "x", "left_semi").select(F.explode(F.arrays_zip("rare", "lengths")).alias("e"), *carried)
    blocks = F.ceil(F.col("e.lengths") / BLOCK).cast("int")
    split = large.select(F.col("e.rare").alias("x"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), blocks.alias("blocks"), *carried)
    pairs = split.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    listed = pairs.select("x", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", *carried)
    return small.union(listed).select(F.pmod(F.xxhash64("x", "first", "second"), F.lit(buckets)).cast("int").alias("bucket"), "*")


def divide_skip(sizes: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray | None, joined: Forest, name: list[int]) -> Iterator[tuple[int, int]]:
    """Index pairs of sets that are similar enough and that `joined` does not join yet (name: their nodes there); pairs are joined
    as they come. side: only pairs of different sides, where given. Each set is a query against those that are no smaller."""
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    sets = [sets[k] for k in order]
    count = len(sets)
    owner = np.repeat(np.arange(count), [len(s[0]) for s in sets])
    entry = np.concatenate([s[0] for s in sets])
    by_entry = np.lexsort((owner, entry))
    entry, owner = entry[by_entry], owner[by_entry]
    begin = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1])))
    names, end = entry[begin], np.concatenate((begin[1:], [len(entry)]))
    reach = np.searchsorted(sizes, sizes * 100 // PERCENT, "right")  # sets that are small enough to be similar
    trees = len({joined.root(k) for k in name})
    for q in range(count):
        if trees < 2:
            return
        if reach[q] <= q + 1:
            continue
        need = -(-2 * PERCENT * int(sizes[q]) // (100 + PERCENT))
        at = np.searchsorted(names, sets[q][0])
        weights = sets[q][1].astype(np.int64)
        starts, ends = begin[at], end[at]
        lengths = ends - starts
        shared = lengths > 1
        starts, ends, lengths, weights = starts[shared], ends[shared], lengths[shared], weights[shared]
        if int(weights.sum()) < need:
            continue
        longest = np.argsort(-lengths, kind="stable")
        room = need / (MU * np.log2(lengths[longest[0]]) + 1)
        n_long = int(np.searchsorted(np.cumsum(weights[longest]), min(room, need - 1), "right"))
        long, short = longest[:n_long], longest[n_long:]
        # Merge the short lists: equal candidates come together, their weights add up.
        merged = np.concatenate([owner[a:b] for a, b in zip(starts[short].tolist(), ends[short].tolist())])
        weight = np.repeat(weights[short], lengths[short])
        later = (merged > q) & (merged < reach[q])
        merged, weight = merged[later], weight[later]
        if not len(merged):
            continue
        turn = np.argsort(merged, kind="stable")
        merged, weight = merged[turn], weight[turn]
        first = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        candidate, overlap = merged[first], np.add.reduceat(weight, first)
        rest = int(weights[long].sum())
        keep = overlap >= need - rest
        if side is not None:
            keep &= side[order[candidate]] != side[order[q]]
        candidate, overlap = candidate[keep], overlap[keep]
        if len(candidate):
            mine = joined.root(name[order[q]])
            apart = np.array([joined.root(name[k]) != mine for k in order[candidate]], bool)
            candidate, overlap = candidate[apart], overlap[apart]
        for k in long.tolist():  # probe the long lists for what is left
            if not len(candidate):
                break
            probed = owner[starts[k] : ends[k]]
            spot = np.minimum(np.searchsorted(probed, candidate), len(probed) - 1)
            overlap = overlap + (probed[spot] == candidate) * int(weights[k])
            rest -= int(weights[k])
            keep = overlap + rest >= need
            candidate, overlap = candidate[keep], overlap[keep]
        union = sizes[q] + sizes[candidate] - overlap
        for c in candidate[100 * overlap >= PERCENT * union].tolist():
            if joined.join(name[order[q]], name[order[c]]):
                trees -= 1
                yield int(order[q]), int(order[c])


def _links(lists: DataFrame) -> DataFrame:
    """(a, b): each set that links of a task join to a lesser one, with the least that they join it to."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        reps, node = np.unique(rows["node"].to_numpy(np.int64), return_inverse=True)
        joined = Forest(len(reps))
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, (a, b) in enumerate(zip(rows["entries"], rows["weights"])):
            known.setdefault(int(node[k]), (np.frombuffer(a, np.int64), np.frombuffer(b, np.int32)))
        size, block, first = rows["n"].to_numpy(np.int64), rows["block"].to_numpy(), rows["first"].to_numpy()
        second = rows["second"].to_numpy()
        for places in rows.groupby(["x", "first", "second"], sort=False).indices.values():
            if len({joined.root(int(node[k])) for k in places}) < 2:
                continue
            side = None if first[places[0]] == second[places[0]] else block[places] == first[places]
            names = [int(node[k]) for k in places]
            for _ in divide_skip(size[places], [known[m] for m in names], side, joined, names):
                pass  # the pairs are in `joined` now
        roots = [joined.root(k) for k in range(len(reps))]
        out = [(reps[k], reps[root]) for k, root in enumerate(roots) if k != root]
        return pd.DataFrame(out, columns=["a", "b"])

    return lists.groupBy("bucket").applyInPandas(search, "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row per row of docs: the set's size and the smallest id that links reach.

    Null and empty texts have no shingles and link with nothing, not even with each other. Rows with a null id link like others, but
    never name a component: theirs is null if no row with an id is reached. Rows with the same id and other texts are documents of
    their own. Ids are whole numbers. Other columns are not read. Two runs give the same rows; an empty input gives none.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    first = materialise(_first_count(docs, buckets, id_col, text_col), "first-count")
    sets = first.where("part is null").select("set_key", "id", "n")
    full = sets.where("n > 0")
    classes = full.groupBy("set_key").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"))
    classes = materialise(classes.join(_alone(first), "set_key", "left").select("set_key", "rep", "n", "copies", (F.coalesce("alone", F.lit(0)) <= F.expr("n div 5")).alias("chosen")), "classes")
    chosen = classes.where("chosen").select("rep", "set_key")
    prepared = materialise(_prepared(_weighted_sets(docs, chosen, id_col, text_col)), "entries")
    links = _links(_tasks(prepared, 4 * buckets))
    component = connected_components(links)
    least = component.join(classes.select(F.col("set_key").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    moved = component.join(least, "component").select(F.col("node").alias("set_key"), "least")
    named = materialise(classes.join(moved, "set_key", "left").select("set_key", "copies", F.coalesce("least", "rep").alias("component_id")), "names")
    # A text may be a large share of all rows: few can, and their rows are named without a shuffle.
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.col("copies") > max(1, total // HOT_SHARE)
    often = F.broadcast(named.where(hot).select("set_key", "component_id"))
    known = full.join(often, "set_key")
    rest = full.join(often, "set_key", "left_anti").join(named.where(~hot).select("set_key", "component_id"), "set_key", "left")
    columns = (F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return known.select(*columns).union(rest.select(*columns)).union(sets.where("n = 0").select(*columns[:2], F.col("id").alias("component_id")))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, without those that a document with a smaller id reaches by links. Rows with the
    same id count as the same document; rows with a null id stay."""
    name = unused(docs, "gone")
    gone = materialise(similar_documents(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct(), "gone")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, F.col(id_col) == F.col(name), "left_anti")


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_values(spark)
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
