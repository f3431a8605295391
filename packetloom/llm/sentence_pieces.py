"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces finds, in one pass over a text, all pieces that
end at each position, along output links; a Viterbi table relaxes the best score of each position over them.

The best sum of scores is a unigram model's segmentation. A BPE model's ids are a path of the same lattice, but not that of the
best sum: of the pieces that end at a position exactly one can follow the last piece of the text before it (two neighbours must be
what merging makes of them). The pass keeps both: best sums for every model, and for BPE models the path that merging makes,
which has the ids that the model's own library gives.

A text falls apart where no piece holds the two characters side by side; the pass runs once over each part that is new to a worker.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Known, by_bytes, cut, flat, long_values, table

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Parts of text of which a worker keeps the ids at most, and bytes of text that it cuts into parts at once.
CACHED_PARTS, SPLIT_BYTES = 600_000, 4 << 20
#: Pairs of pieces of which a task remembers whether they can stand side by side.
KNOWN_PAIRS = 300_000
#: What an unknown character costs below the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0


NO_SUM, NO_PIECE, UNKNOWN_PIECE = array("d", [-math.inf]), array("i", [-2]), array("i", [-1])


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """A model file: its pieces, their scores, the automaton, and how a text is normalised."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        top = dict((k, v) for k, v in _fields(model) if k in (2, 3))
        self.kind = dict(_fields(top.get(2, b""))).get(3, UNIGRAM)
        spec = dict(_fields(top.get(3, b"")))
        self.plain = not spec.get(2) and spec.get(3, 1) and not spec.get(4, 1) and spec.get(5, 1)  # nothing but a space in front
        size = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.byte_ids = [-1] * 256
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.score = [sp.get_score(i) for i in range(size)]
        self.id_of: dict[str, int] = {}
        for i, piece in enumerate(self.text):
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id_of[piece] = i
        self.raw = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)]
        self.lowest = min((self.score[i] for i in self.id_of.values()), default=0.0) - UNKNOWN_PENALTY
        self.lengths = [len(p) for p in self.text]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if self.kind != BPE or len(piece) == 1 or self._merge(piece) == [piece]:  # others never come out of merging
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.begins = self._begins()
        self.joins: dict[int, bool] = {}
        self.known_chars = "".join(re.escape(c) for c in self.id_of if len(c) == 1)
        self.raw_pieces = pa.array(self.raw, pa.large_binary())
        self.known = Known(self._learn, CACHED_PARTS)

    def _begins(self) -> np.ndarray:
        """Whether a part begins between two bytes: ASCII characters that no piece has side by side; a space sign counts as a space."""
        begins = np.zeros((256, 256), bool)
        begins[:128, :128] = True
        for piece in self.id_of:
            plain = piece.replace(SPACE, " ").encode("utf-8", "replace")
            for x, y in zip(plain, plain[1:]):
                begins[x, y] = False
        return begins.ravel()

    def _normal(self, texts: pa.Array) -> pa.Array:
        """Normalised texts, with spaces for space signs."""
        if self.plain:
            front = pc.if_else(pc.greater(pc.binary_length(texts), 0), pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
            return pc.binary_join_element_wise(front, texts, pa.scalar(b"", pa.large_binary()))
        return pa.array([self.processor.normalize(t.as_py().decode("utf-8", "replace")).replace(SPACE, " ").encode() for t in texts], pa.large_binary())

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[bytes, float]]:
        """For each text its ids, as little-endian unsigned 32-bit numbers, and the best sum of scores; a null is as an empty text."""
        for part in by_bytes(texts, SPLIT_BYTES):
            raw, offsets = flat(self._normal(part))
            data = np.frombuffer(raw, np.uint8)
            begins = np.zeros(len(data), bool)
            begins[1:] = self.begins[data[:-1].astype(np.uint16) << 8 | data[1:]]
            begins[offsets[offsets < len(data)]] = True
            begin = np.flatnonzero(begins)
            words = cut(data, begin).dictionary_encode()
            values, numbers = self.known.of(words.dictionary)
            ids, ends = flat(values.take(words.indices))
            of = np.searchsorted(begin, offsets)
            sums = np.concatenate(([0.0], np.cumsum(numbers[words.indices.to_numpy()])))[of]
            ends = ends[of].tolist()
            for k, (a, b) in enumerate(zip(ends, ends[1:])):
                yield ids[a:b], float(sums[k + 1] - sums[k])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.encode_column(pa.array([text], pa.string())))[0], "<u4").tolist()

    def _learn(self, parts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        ids, best = [], np.zeros(len(parts))
        for k, part in enumerate(parts):
            path, best[k] = self.path(part.decode("utf-8", "replace").replace(" ", SPACE))
            ids.append(np.array(path, "<u4").tobytes())
        return ids, best

    def path(self, text: str) -> tuple[array, float]:
        """The model's ids of a normalised text, and the best sum of scores of any path; an unknown character is a piece at a penalty."""
        unknown = {c for c in set(text) if c not in self.id_of}
        if self.kind != UNIGRAM and unknown:  # no piece reaches over an unknown character
            ids, total = array("i"), 0.0
            for part in re.finditer(f"[{self.known_chars}]+|.", text, re.S):
                if part[0][0] in unknown:
                    ids.extend(self._unknown(part[0]))
                    total += self.lowest
                else:
                    more, best = self._relax(part[0])
                    ids.extend(more)
                    total += best
            return ids, total
        return self._relax(text)

    def _relax(self, text: str) -> tuple[array, float]:
        """One pass. For each position are kept, in twelve bytes, the best sum and the piece that ends there (BPE: the one that merging puts
        there, -2 for none; unigram: the one of the best sum, -1 for an unknown character)."""
        n, score, joins, merging, lowest = len(text), self.score, self.joins, self.kind != UNIGRAM, self.lowest
        best, chosen = NO_SUM * (n + 1), (NO_PIECE if merging else UNKNOWN_PIECE) * (n + 1)
        best[0], chosen[0] = 0.0, -1
        if len(joins) > KNOWN_PAIRS:
            joins.clear()
        settled = 0  # up to here an unknown character was tried against the pieces
        for end, (length, i) in self.automaton.iter(text):  # by rising end, longest first, along output links
            while settled < end:
                settled += 1
                total = best[settled - 1] + lowest
                if total > best[settled]:
                    best[settled] = total
                    if not merging:
                        chosen[settled] = -1
            end += 1
            total = best[end - length] + score[i]
            if total > best[end]:
                best[end] = total
                if not merging:
                    chosen[end] = i
            if merging and chosen[end] == -2:
                before = chosen[end - length]
                if before != -2:
                    key = before << 32 | i
                    fits = joins.get(key)
                    if fits is None:
                        fits = joins[key] = before < 0 or self._merge(self.text[before] + self.text[i]) == [self.text[before], self.text[i]]
                    if fits:
                        chosen[end] = i
        while settled < n:
            settled += 1
            total = best[settled - 1] + lowest
            if total > best[settled]:
                best[settled] = total
                if not merging:
                    chosen[settled] = -1
        return self._trace(text, chosen), best[n]

    def _unknown(self, char: str) -> list[int]:
        """The bytes of a character that no piece has, if the model has byte pieces, else the unknown id."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.byte_ids[0] >= 0 else [self.unknown]

    def _trace(self, text: str, chosen: array) -> array:
        """The path from the end back. Where the model has no byte pieces, a run of unknown characters is one unknown id, as in the
        library."""
        out, end = array("i"), len(text)
        while end:
            i = chosen[end]
            if i >= 0:
                out.append(i)
                end -= self.lengths[i]
                continue
            if self.byte_ids[0] >= 0 or not out or out[-1] != self.unknown:
                out.extend(reversed(self._unknown(text[end - 1])))
            end -= 1
        out.reverse()
        return out

    def _merge(self, text: str) -> list[str]:
        """Merges the pair of neighbours of the best score, the leftmost first, as long as there is one."""
        parts = list(text)
        while True:
            top, at = -math.inf, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and self.score[i] > top:
                    top, at = self.score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: space signs become spaces, the one in front goes, runs of byte pieces are read as UTF-8."""
        text = flat(self.raw_pieces.take(pa.array(ids, pa.int64())))[0].decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """The model of this Python worker, with what it knows from earlier tasks."""
    with open(path, "rb") as file:
        return Pieces(file.read())


def _located(path: str) -> str:
    """A file that each executor has under the same name, or that was sent with SparkContext.addFile."""
    import os

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, best double): one row per row of docs, for whole texts; best is the best sum of scores. Null and empty
    texts have no ids and the sum 0. Of equal sums the longer last piece is taken."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(_located(model))
        for whole in batches:
            at = 0
            for rows in _held(pieces.encode_column(whole.column(1))):
                ids = np.frombuffer(b"".join(r[0] for r in rows), "<u4").astype(np.int32)
                ends = np.concatenate(([0], np.cumsum([len(r[0]) // 4 for r in rows]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(at, len(rows)), lists, pa.array([r[1] for r in rows], pa.float64())], names=[id_col, "ids", "best"])
                at += len(rows)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, best double")


def _held(rows: Iterator[tuple[bytes, float]], size: int = 4 << 20) -> Iterator[list[tuple[bytes, float]]]:
    """Rows in lists of about so many bytes."""
    held: list[tuple[bytes, float]] = []
    used = 0
    for row in rows:
        held.append(row)
        used += len(row[0]) + 64
        if used >= size:
            yield held
            held, used = [], 0
    if held:
        yield held


def decode_ids(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each list of ids; null stays null."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(_located(model))
        for batch in batches:
            texts = [None if x.as_py() is None else pieces.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text encoded and decoded again: the number of ids, a digest of the ids and of the text that they decode to, and the best
    sum of scores."""
    long_values(spark)
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(_located(path))
        for whole in batches:
            at = 0
            for rows in _held(pieces.encode_column(whole.column(1))):
                decoded = [pieces.decode(np.frombuffer(ids, "<u4")) for ids, _ in rows]
                columns = (pa.array([len(ids) // 4 for ids, _ in rows], pa.int64()), pa.array([ids for ids, _ in rows], pa.binary()), pa.array(decoded, pa.string()), pa.array([best for _, best in rows], pa.float64()))
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(at, len(rows)), *columns], names=["doc_id", "n_ids", "raw", "decoded", "best"])
                at += len(rows)

    out = docs.mapInArrow(both, f"doc_id {kind}, n_ids long, raw binary, decoded string, best double")
    return out.select("doc_id", "n_ids", F.crc32("raw").alias("ids_crc32"), F.crc32(F.encode("decoded", "UTF-8")).alias("decoded_crc32"), "best")
