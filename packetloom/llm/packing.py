"""Sum-of-squares packing of tokenised documents into sequences of fixed capacity.

A document goes where the sum of squares of the numbers of open bins per residual gap becomes smallest (Csirik et al.,
2006). Pieces are dealt by a hash of their row number over groups of some thousand sequences; each group packs by itself, so
the waste is a fixed number of bins per group whatever the size of the input.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Known, by_bytes, cut, flat, materialise, table, unused

CAPACITY = 4096
END_ID = 1
#: Sequences and pieces that one group packs, about.
GROUP_SEQUENCES, GROUP_PIECES = 4096, 1 << 20
#: Words of which a Python worker keeps the ids at most, bytes of text that it splits into words at once, and
#: bytes of ids that it hands on at once.
CACHED_WORDS, SPLIT_BYTES, YIELDED_BYTES = 600_000, 4 << 20, 4 << 20

#: Lower case of A-Z, and one kind of white space.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b" " * 5)
_kinds = np.zeros(256, np.uint8)  # 0: all other bytes
_kinds[33:127] = 2  # punctuation
_kinds[48:58] = 3  # digits
_kinds[[*range(65, 91), *range(97, 123)]] = 1  # letters
_kinds[32] = 4
KINDS = _kinds
#: Where a part of a text may begin, by the kinds of the byte before and of its first: at white space, between letters and
#: digits, and at a punctuation mark after one of these. Not at a letter after punctuation, which may be one token with it ('s).
BEGINS = np.zeros((5, 5), bool)
BEGINS[:4, 4] = BEGINS[1, 2:4] = BEGINS[3, 1:3] = BEGINS[2, 3] = True


class WordTokenizer:
    """Ids of whole texts by a tokenizer that lower-cases and whose tokens never reach over white space, between letters and
    digits or from these into punctuation: parts of a text are encoded once and remembered. A text's ids are those of its
    parts one after the other, exactly as the tokenizer gives them for the whole text."""

    def __init__(self, path: str, cached: int = CACHED_WORDS, split_bytes: int = SPLIT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known, self.split_bytes = Known(self._learn, cached), split_bytes

    def _learn(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        texts = [w.decode("utf-8", "replace").lstrip(" ") for w in words]
        found: list[bytes] = [b""] * len(texts)
        if texts and len(words[0]) > self.known.longest:  # long words come together; each goes to the tokenizer by itself
            for k, text in enumerate(texts):
                found[k] = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
            return found, np.zeros(len(found))
        plain = [k for k, t in enumerate(texts) if t.isalpha() and t.islower()]
        if plain:  # one run of letters each: it ends where a token ends a word
            lines = [" ".join([texts[k] for k in plain[i : i + 50]]) for i in range(0, len(plain), 50)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(plain):
                _keep(found, plain, ids, ends)
            else:  # the tokenizer knows fewer letters
                plain = []
        known = set(plain)
        other = [k for k, t in enumerate(texts) if t and k not in known]
        for at in range(0, len(other), 1000):
            part = other[at : at + 1000]
            encoded = self.tokenizer.encode(" ".join([texts[k] for k in part]), add_special_tokens=False)
            begins = np.array([o[0] for o in encoded.offsets], np.int64)
            lengths = np.array([len(texts[k]) + 1 for k in part], np.int64)
            _keep(found, part, np.array(encoded.ids, "<u4"), np.searchsorted(begins, np.cumsum(lengths)))
        return found, np.zeros(len(found))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers; nothing for a null."""
        for part in by_bytes(texts, self.split_bytes):
            yield from self._encode(part)

    def _encode(self, texts: pa.Array) -> Iterator[bytes]:
        raw, offsets = flat(texts)
        # A special token is one only as it is written: such texts go to the tokenizer as they are.
        whole = {k for s in self.special if s in raw for k in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist()}
        folded = np.frombuffer(bytearray(raw.translate(FOLD)), np.uint8)
        given = np.frombuffer(raw, np.uint8)
        kinds = KINDS[folded]
        # Before a combining mark, a capital is composed as a capital.
        marked = np.flatnonzero((given[1:] >= 128) & (folded[:-1] != given[:-1]) & (kinds[:-1] == 1))
        folded[marked] = given[marked]
        begins = np.zeros(len(folded), bool)
        begins[1:] = BEGINS.ravel()[kinds[:-1] * np.uint8(5) + kinds[1:]]
        begins[offsets[offsets < len(folded)]] = True
        begin = np.flatnonzero(begins)
        parts = cut(folded, begin).dictionary_encode()
        ids = self.known.of(parts.dictionary)[0].take(parts.indices)
        data, ends = flat(ids)
        ends = ends[np.searchsorted(begin, offsets)].tolist()
        for k, (a, b) in enumerate(pairwise(ends)):
            if k in whole:
                yield np.array(self.tokenizer.encode(texts[k].as_py().decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield data[a:b]


def _keep(found: list[bytes], places: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
    raw, start = ids.tobytes(), 0
    for k, end in zip(places, (4 * ends).tolist(), strict=True):
        found[k] = raw[start:end]
        start = end


@lru_cache(maxsize=1)
def tokenizer_of(path: str, cached: int, split_bytes: int) -> WordTokenizer:
    """The tokenizer of this Python worker, with what it knows from earlier tasks."""
    return WordTokenizer(path, cached, split_bytes)


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED_WORDS, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(id, piece, start, length, ids): ids is binary, little-endian unsigned 32-bit. Each text's ids end with end_id; longer
    ones than capacity are cut into pieces of capacity. A null or empty text is the end id alone. cached and split_bytes bound a
    worker's memory and change no result."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = tokenizer_of(path, cached, split_bytes), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple[int, int, int, int, bytes]] = []
            held = 0

            def flush() -> pa.RecordBatch:
                row, piece, start, length, ids = zip(*rows)
                rows.clear()
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *map(pa.array, (piece, start, length, ids), kinds)], names=names)

            for i, encoded in enumerate(tokenizer.encode(batch.column(1))):
                encoded += end
                for k, first in enumerate(range(0, len(encoded), 4 * capacity)):
                    part = encoded[first : first + 4 * capacity]
                    rows.append((i, k, first // 4, len(part) // 4, part))
                held += len(encoded)
                if held >= YIELDED_BYTES:
                    yield flush()
                    held = 0
            if rows:
                yield flush()
            pa.default_memory_pool().release_unused()

    return docs.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. Items come largest first, equal ones in the given order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins per gap; a full bin (gap 0) is closed and never counted
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    n_bins, far = 0, np.iinfo(np.int64).max
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        # Moving a bin from gap g to g - size changes the sum of squares by 2 (N(g - size) - N(g)) + 2, or 1 - 2 N(g) if it fills.
        best, gap = (2 * int(count[capacity - size]) + 1 if size < capacity else 0), capacity
        source = count[size:capacity]
        if source.any():
            change = 2 * (count[: capacity - size] - source) + 2
            change[0] = 1 - 2 * source[0]
            change[source == 0] = far
            at = int(change.argmin())
            if change[at] <= best:
                best, gap = int(change[at]), size + at
        if gap == capacity:
            number, n_bins = n_bins, n_bins + 1
        else:
            number = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = number, capacity - gap
        if gap > size:
            count[gap - size] += 1
            open_bins[gap - size].append(number)
    return bins, offsets, n_bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", group_sequences: int = GROUP_SEQUENCES, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, length, ...), replacing columns of these names; other columns are carried
    as they are. An empty input gives no rows. Null ids are packed like any other; equal rows are packed once each, in any order."""
    base = pieces.drop("sequence_id", "offset")
    total, rows = base.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, round((total or 0) / (capacity * group_sequences)), -(-rows // group_pieces))
    group = unused(base, "group")

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns([group]).sort_by([(id_col, "ascending"), ("piece", "ascending")])
        bins, offsets, _ = sum_of_squares(rows["length"].to_numpy().astype(np.int64), capacity)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = base.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))  # not by id: one may be on many rows
    schema = StructType([*base.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return dealt.groupBy(group).applyInArrow(place, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = tokenized_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digest = materialise(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(digest)
