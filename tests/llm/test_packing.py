"""Tokenising and packing against plain versions."""

import collections
import os
import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packetloom.llm import packing
from packetloom.llm.common import Known

from ..conftest import DATA, ROOT

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Letters, signs, white space of all kinds, marks that compose, capitals without a composed form, other scripts.
SIGNS = "abcsdtremvlHJTWYABZ'’.,-<|>=`~ \t\n\r\x0b\x0c\x1c\x1d\x85\xa0  0123456789éÈßµªıİŉǅσΣς日本👍🏽̸̱̈́̌̊̇ͅ⃣̧"


def plain_ids(texts):
    encoded = Tokenizer.from_file(PATH).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    return [np.array(e.ids, "<u4").tobytes() for e in encoded]


@pytest.mark.parametrize("cached", [300, 10**6])
def test_ids_equal_the_library(cached):
    r = random.Random(5)
    texts = [None, "", " "]
    for _ in range(6000):
        text = "".join(r.choice(SIGNS) for _ in range(r.randint(1, 60)))
        if r.random() < 0.1:
            text += r.choice(["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|"]) + text
        texts.append(text)
    texts += [f"a{chr(c)} H{chr(c)}b {chr(c)}s '{chr(c)}1" for c in range(1, 0x3000)]
    tokenizer = packing.WordTokenizer(PATH, cached)
    assert list(tokenizer.encode(pa.array(texts, pa.string()))) == plain_ids(texts)
    assert list(tokenizer.encode(pa.array([], pa.string()))) == []
    assert list(tokenizer.encode(pa.array([None, ""], pa.string()))) == [b"", b""]


def test_documents_equal_the_library(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text").toArrow()["text"].combine_chunks()
    assert list(packing.WordTokenizer(PATH).encode(docs)) == plain_ids(docs.to_pylist())


def brute_sum_of_squares(sizes, capacity):
    """Every place is tried; of equal ones an open bin with the largest gap comes before a new one, as in the operator a smaller
    gap before a larger one."""
    gaps, placed = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):

        def squares(bins):
            return sum(n * n for g, n in collections.Counter(bins).items() if g)

        options = []
        for k in {g: k for k, g in enumerate(gaps) if g >= sizes[i]}.values():
            options.append((squares([*gaps[:k], gaps[k] - sizes[i], *gaps[k + 1 :]]), gaps[k], k))
        options.append((squares([*gaps, capacity - sizes[i]]), capacity + 1, len(gaps)))
        k = min(options)[2]
        gap = capacity if k == len(gaps) else gaps[k]
        if k == len(gaps):
            gaps.append(capacity)
        gaps[k] -= sizes[i]
        placed[i] = gap
    return [placed[i] for i in range(len(sizes))], len(gaps)


def test_choice_against_all_places():
    r = random.Random(9)
    for _ in range(60):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 40))]
        bins, offsets, n = packing.sum_of_squares(np.array(sizes), 20)
        gaps, want = brute_sum_of_squares(sizes, 20)
        assert n == want and [20 - g for g in gaps] == offsets.tolist()
        assert max(np.bincount(bins, sizes)) <= 20


def test_large_and_null_ids(spark):
    rows = [(2**60 + 1, 0, 5), (None, 0, 7), (2**60 + 3, 0, 9), (None, 0, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, length long").withColumn("note", F.lit(None).cast("long")).withColumn("Group", F.lit(1)).withColumn("offset", F.lit("x"))
    out = packing.pack(frame, capacity=16, group_pieces=2)
    assert out.columns == ["doc_id", "piece", "length", "note", "Group", "sequence_id", "offset"]
    got = out.collect()
    assert collections.Counter((x.doc_id, x.length) for x in got) == collections.Counter((a, c) for a, _, c in rows)
    assert all(x.note is None and x.Group == 1 for x in got)


def test_query(spark):
    """The registered query against the tokenizer's ids, the cut at 4096 and gapless sequences."""
    import zlib

    got = packing.op5_packing(spark, DATA).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = dict(zip(docs, plain_ids(docs.values())))
    want = {(i, k, s // 4, len(x) // 4, zlib.crc32(x)) for i, raw in ids.items() for k, s in enumerate(range(0, len(raw) + 4, 16384)) for x in [(raw + b"\1\0\0\0")[s : s + 16384]]}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 4096) * 1.01 + 1


def test_memory_of_texts_without_spaces():
    """Long unspaced words are encoded and forgotten: 200 MB of them leave a worker's memory where it was, short ones within a bound."""
    code = """
import random, resource, sys
import pyarrow as pa, public_tokenizers
from packetloom.llm.packing import WordTokenizer
from packetloom.llm.sentence_pieces import Pieces
kind, total = sys.argv[1], int(sys.argv[2])
r = random.Random(1)
chars = [chr(c) for c in range(0x4E00, 0x4F00)]
if kind == "word":
    t = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    run = lambda texts: sum(len(x) for x in t.encode(texts))
else:
    t = Pieces(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    run = lambda texts: sum(len(x) for x, _ in t.encode_column(texts))
peaks, done = [], 0
while done < total:
    texts = pa.array(["".join(r.choices(chars, k=6000)) for _ in range(20)], pa.string())
    run(texts)
    done += 20 * 18000
    peaks.append(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
print(peaks[len(peaks) // 4], peaks[-1])
"""
    total = 200_000_000 if os.environ.get("ALL_QUERIES") else 12_000_000
    for kind in ("word", "piece"):
        out = subprocess.run([sys.executable, "-c", code, kind, str(total)], capture_output=True, text=True, cwd=ROOT, check=True).stdout.split()
        assert int(out[1]) - int(out[0]) < 60, (kind, out)


def test_bytes_bound_what_is_known():
    known = Known(lambda words: ([w * 2 for w in words], np.ones(len(words))), limit=1000, size=5000, longest=50)
    for i in range(50):
        keys = pa.array([b"%d-%d" % (i, j) + b"x" * (j * 3) for j in range(30)], pa.large_binary())
        values, numbers = known.of(keys)
        assert values.to_pylist() == [k * 2 for k in keys.to_pylist()] and (numbers == 1).all()
        assert max(map(len, known.keys.to_pylist())) <= 50 and known.keys.nbytes + known.values.nbytes < 15_000


def test_repeated_ids_are_dealt_over_groups(spark):
    rows = [(7, 0, 0, 1000 + i % 9) for i in range(3000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long"), group_pieces=100).collect()
    groups = collections.Counter(r.sequence_id >> 32 for r in out)
    assert len(groups) >= 25 and max(groups.values()) < 200
