"""Mixing, the source audit and the manifest against plain versions, and their odd inputs."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import manifest, mixing, source_audit

from ..conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n\t ", "a", "x y\x1cz\x85w", "Éa it's\n12 # $", "日本語 👍🏽 " * 30, "word\nother " * 30000, "日" * 300_000, "same text", "same text", "same text"]
    rows = [(i % 9, t, None if i == 1 else "en", [None, "", "b", "a"][i % 4]) for i, t in enumerate(texts)] + [(None, "no id here", None, None), (None, "no id here", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clashes = ("size", "row", "place", "block", "tree", "tie", "number", "part", "start", "term", "count", "docs", "rank", "item", "value", "words", "shard", "digest", "changed", "leaf", "turn", "weight")
    return frame.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("clash") for c in clashes})


# 11. Mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Round by round: share out by weight, cut at the most, share out again what was over."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, over, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while over > 1e-9 and open_:
        units = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += over * weight[s] / units
        over = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def checked(rows, sources):
    by = collections.defaultdict(list)
    for r, s in zip(rows, sources):
        by[s].append(r)
    want = plain_targets({s: sum(r["size"] for r in v) for s, v in by.items()})
    for s, v in by.items():
        size = sum(r["size"] for r in v)
        block = max(1, min(mixing.BLOCK_WORDS, size // mixing.LEAST_BLOCKS))
        assert all(r.source_size == size and r.target == pytest.approx(want[s]) and r.taken <= 2 * r["size"] for r in v)
        assert abs(sum(r.taken for r in v) - want[s]) < 2 * block


def test_mix_of_the_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = sorted(mixing.op11_mixing(spark, DATA).collect())
    assert [r["size"] for r in rows] == [len(WORD.findall(d.text or "")) for d in sorted(docs)]
    checked(rows, [d.source for d in sorted(docs)])
    assert rows == sorted(mixing.op11_mixing(spark, DATA).collect())


def test_mix_of_odd_rows(spark, odd):
    pieces = mixing.mix_documents(odd, shards=3)
    rows = pieces.groupBy("row", "doc_id", "source", "size", "source_size", "target").agg(F.sum("words").alias("taken")).collect()
    want = collections.Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in odd.collect())
    assert collections.Counter((r.doc_id, r.source, r["size"]) for r in rows) == want
    checked(rows, [r.source for r in rows])
    assert mixing.mix_documents(odd.where("false")).count() == 0


def test_shards_get_disjoint_pieces_of_exact_quotas(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sized = mixing.with_words(docs, ["doc_id", "source"])
    plan = mixing.quotas(mixing.source_targets(sized), shards=5)
    pieces = mixing.mix(sized, plan, [F.col("doc_id")]).where("shard is not null")
    assert pieces.count() == pieces.select("row", "pass", "start").distinct().count()
    blocks = pieces.select("source", "shard", "place").distinct().groupBy("source", "shard").count().collect()
    starts = {r.source: np.diff(r.starts).tolist() for r in plan.collect()}
    assert {(r.source, r.shard): r["count"] for r in blocks} == {(s, i): n for s, v in starts.items() for i, n in enumerate(v) if n}
    per_shard = np.array(list(starts.values())).sum(axis=0)
    assert per_shard.max() - per_shard.min() <= 1
    first = [r.source for r in mixing.shuffled(pieces).where("shard = 0").limit(60).collect()]
    assert len(set(first)) > 5  # sources lie mixed in a shard


def test_tree_and_permutation():
    rng = np.random.default_rng(3)
    draws = rng.integers(0, 50, 30)
    sizes = (int(draws.sum()) + np.arange(7)) // 7
    dealt = mixing.split(draws, sizes, rng)
    assert (dealt.sum(axis=1) == draws).all() and (dealt.sum(axis=0) == sizes).all()
    for n in (1, 2, 3, 17, 1000):
        for key in (0, -5, 1 << 40):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))
    means = np.mean([mixing.split(np.array([10, 30]), np.array([20, 20]), np.random.default_rng(i))[:, 0] for i in range(400)], axis=0)
    assert means == pytest.approx([5, 15], abs=0.3)


# 12. Source audit


def plain_audit(rows, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    count, holders, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", term.findall((text or "").translate(low))
        groups.add((lang, source))
        count.update((lang, source, t) for t in found)
        holders.update((lang, t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept, sources = [t for (k, t), n in holders.items() if k == lang and n >= 3], [s for k, s in groups if k == lang]
        share = lambda n, total: 1 + 10**9 * (n + 1) // (total + len(kept))  # noqa: E731, B023
        n = {s: [count[lang, s, t] for t in kept] for s in sources}
        p = {s: [share(x, sum(v)) for x in v] for s, v in n.items()}
        everywhere = [sum(x) for x in zip(*n.values())] if kept else []
        q = [share(x, sum(everywhere)) for x in everywhere]
        for s in sources:
            pairs = [(-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o.encode()) for o in sources if o != s]
            terms = [(-((a - b) ** 2 // b), t.encode()) for a, b, t, c in zip(p[s], q, kept, n[s]) if c and a > b]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(items, 1)]
    return sorted(out)


def test_audit_against_plain(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang", "source")
    assert sorted(map(tuple, source_audit.op12_source_audit(spark, DATA).collect())) == plain_audit(map(tuple, docs.collect()))
    rows = odd.select("text", "lang", "source").collect()
    assert sorted(map(tuple, source_audit.source_audit(odd).collect())) == plain_audit(map(tuple, rows))
    assert source_audit.source_audit(odd.where("false")).count() == 0


def test_terms_are_counted_in_stretches():
    text = ("Ab c-d é9É " * 1000 + "x" * 5000 + " Ab").encode()
    assert source_audit.term_counts(text, split_bytes=7) == source_audit.term_counts(text) == collections.Counter({b"ab": 1001, b"c": 1000, b"d": 1000, "é".encode(): 1000, "É".encode(): 1000, b"x" * 5000: 1})


def test_small_counters_of_a_task_give_the_same(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sums = lambda c: sorted(map(tuple, c.groupBy("lang", "source", "term").agg(F.sum("count"), F.sum("docs")).collect()), key=str)
    assert sums(source_audit.counted_terms(docs, held=500)) == sums(source_audit.counted_terms(docs))


# 13. Manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_paths(leaves):
    """The root, and for each leaf its siblings left and right on each level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i - i % 3 : i - i % 3 + 3]
            paths[k].append((run[: i % 3], run[i % 3 + 1 :]))
        level, at = [digest(*level[i : i + 3]) for i in range(0, len(level), 3)], [i // 3 for i in at]
    return level[0], paths


def plain_manifest(rows):
    fields = lambda r, text: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text))
    by = collections.defaultdict(list)
    for r in rows:
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        leaf, other = digest(fields(r, r.text)), digest(fields(r, r.text.replace("\n", "") if changed and r.text else r.text))
        by[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf, other))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_paths([x[2] for x in sorted(by[s])]) for s in order}
    root, over = tree_paths([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, over):
        for (known, doc_id, leaf, folded), path in zip(sorted(by[s]), trees[s][1]):
            for left, right in path + above:
                folded = digest(*left, folded, *right)
            proof = digest(*itertools.chain(*(left + right for left, right in path + above)))
            out.append((doc_id if known else None, leaf, trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_against_plain(spark, odd, height):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source")))
    for frame in (docs, odd):
        changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
        made = manifest.manifest(frame, ["doc_id", "source", "lang", "n_chars", "text"], changed={"text": changed}, height=height)
        assert sorted(map(tuple, made.proofs().collect()), key=str) == plain_manifest(frame.collect())


def test_manifest_of_nothing(spark, odd):
    made = manifest.manifest(odd.where("false"), ["doc_id", "text"])
    assert made.root is None and made.proofs().count() == 0


def test_van_emde_boas_places():
    for levels in range(1, 8):
        layout = manifest.places(levels)
        assert sorted(np.concatenate(layout).tolist()) == list(range((3**levels - 1) // 2))
    # Four levels: the upper two first, then each lower subtree of two in one stretch.
    layout = manifest.places(4)
    assert [p.tolist() for p in layout[:2]] == [[0], [1, 2, 3]]
    assert layout[2].tolist() == list(range(4, 40, 4)) and layout[3][:4].tolist() == [5, 6, 7, 9]
