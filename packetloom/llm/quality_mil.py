"""Document quality by attention-based multiple-instance learning (Ilse et al., 2018).

Every passage of a text becomes a vector; a gated attention layer, learned from document labels alone, weighs the
passages, and the weighted sum is scored. Training runs on a bounded sample of labelled documents; scoring reads every
whole text once, in tasks that hold one batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, long_values, table

PASSAGE_WORDS = 64
#: Labelled documents that training takes at most, and bytes of their texts; of a document that is taken every passage is encoded.
TRAIN_DOCS, TRAIN_BYTES = 3000, 24 << 20
HIDDEN, GATE, STEPS, BATCH, RATE = 24, 12, 240, 128, 0.01
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Texts are encoded together up to so many bytes.
CHUNK_BYTES = 1 << 20

_CLASSES = [15] * 256
for _number, _chars in enumerate((b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", bytes(range(128, 256)), b".", b",", b"!?", b"'\"", b"#*", b"$%", b"&|", b"<>", b"()[]{}/\\")):
    for _c in _chars:
        _CLASSES[_c] = _number
CLASS_OF = np.array(_CLASSES, np.int64)
WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
BYTE_KEY = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
PLACE_KEY = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
FEATURES = 16 * 16 + 5


def encode_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x FEATURES, document of each passage): a passage is 64 words. Features: root shares of pairs of character
    classes, words that repeat the one before, distinct words, mean word length, words, lines. A text without words is one zero
    passage."""
    # White space in front of the first word counts for nothing, so that no byte belongs to the text before.
    raws = [(t or "").encode("utf-8", "replace").lstrip() for t in texts]
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    white = WHITE[data]
    begins = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    doc_of_word = np.searchsorted(ends, begins, "right")
    n_words = np.bincount(doc_of_word, minlength=len(raws))
    first_word = np.cumsum(n_words) - n_words
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first_passage = np.cumsum(n_passages) - n_passages
    owner = np.repeat(np.arange(len(raws)), n_passages)
    out = np.zeros((len(owner), FEATURES), np.float32)
    if len(begins):
        passage = first_passage[doc_of_word] + (np.arange(len(begins)) - first_word[doc_of_word]) // PASSAGE_WORDS
        word_of_byte = np.maximum(np.cumsum(np.bincount(begins, minlength=len(data))) - 1, 0)
        at = passage[word_of_byte]
        classes = CLASS_OF[data]
        total = len(owner)
        inside = np.append(at[1:] == at[:-1], False)  # no pair reaches out of its passage
        inside[ends - 1] = inside[ends[ends > 1] - 2] = False  # nor to the line end that parts two texts
        inside = np.flatnonzero(inside)
        pairs = np.bincount(at[inside] * 256 + classes[inside] * 16 + classes[inside + 1], minlength=total * 256)[: total * 256].reshape(total, 256)
        size = np.maximum(pairs.sum(1, keepdims=True), 1)
        out[:, :256] = np.sqrt(pairs / size)
        place = (np.arange(len(data)) - begins[word_of_byte]) & 63
        keys = np.add.reduceat(np.where(white, np.uint64(0), BYTE_KEY[data] * PLACE_KEY[place]), begins)
        words = np.maximum(np.bincount(passage, minlength=total), 1)
        same = np.concatenate(([False], (keys[1:] == keys[:-1]) & (passage[1:] == passage[:-1])))
        out[:, 256] = np.bincount(passage, same, total) / words
        _, once = np.unique(keys ^ (passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        out[:, 257] = np.bincount(passage[once], minlength=total) / words
        out[:, 258] = np.bincount(at, ~white, total) / words / 10
        out[:, 259] = np.bincount(passage, minlength=total) / PASSAGE_WORDS
        lines = classes == 1
        lines[ends - 1] = False
        out[:, 260] = np.bincount(at, lines, total) / words
    return out, owner


class Model(NamedTuple):
    """Encoder (w1, b1), attention (v, u, w), classifier (c, b)."""

    w1: np.ndarray
    b1: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray


def attend(m: Model, x: np.ndarray, owner: np.ndarray, docs: int):
    """Owner rises from 0 and every document has a passage."""
    h = np.maximum(x @ m.w1 + m.b1, 0)
    t, s = np.tanh(h @ m.v), 1 / (1 + np.exp(-(h @ m.u)))
    e = (t * s) @ m.w
    first = np.searchsorted(owner, np.arange(docs))
    a = np.exp(e - np.maximum.reduceat(e, first)[owner])
    a /= np.add.reduceat(a, first)[owner]
    z = np.add.reduceat(a[:, None] * h, first)
    return h, t, s, a, z, z @ m.c + m.b


def fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    """Adam on the cross entropy of document labels; owner as in attend()."""
    rng = np.random.default_rng(seed)
    scale = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    m = Model(scale(x.shape[1], HIDDEN), np.zeros(HIDDEN, np.float32), scale(HIDDEN, GATE), scale(HIDDEN, GATE), scale(GATE), scale(HIDDEN), np.zeros(1, np.float32))
    first = np.searchsorted(owner, np.arange(len(y) + 1))
    m1, m2 = [np.zeros_like(p) for p in m], [np.zeros_like(p) for p in m]
    for step in range(1, STEPS + 1):
        docs = rng.choice(len(y), min(BATCH, len(y)), replace=False)
        rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
        own = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
        xb, n = x[rows], len(docs)
        h, t, s, a, z, logit = attend(m, xb, own, n)
        d_logit = (1 / (1 + np.exp(-logit)) - y[docs]) / n
        d_z = np.outer(d_logit, m.c)[own]
        d_a = (h * d_z).sum(1)
        d_e = a * (d_a - np.bincount(own, a * d_a, n)[own])
        d_g = np.outer(d_e, m.w)
        d_t, d_s = d_g * s * (1 - t * t), d_g * t * s * (1 - s)
        d_h = (a[:, None] * d_z + d_t @ m.v.T + d_s @ m.u.T) * (h > 0)
        grads = (xb.T @ d_h, d_h.sum(0), h.T @ d_t, h.T @ d_s, (t * s).T @ d_e, z.T @ d_logit, d_logit.sum(keepdims=True))
        for p, g, p1, p2 in zip(m, grads, m1, m2):
            g = g + 1e-4 * p
            p1 += 0.1 * (g - p1)
            p2 += 0.001 * (g * g - p2)
            p -= (RATE * (p1 / (1 - 0.9**step)) / (np.sqrt(p2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def segments(text: str | None, size: int = CHUNK_BYTES) -> list[str]:
    """The text in parts of whole passages and about `size` bytes: what a long text is read in, so that memory stays bounded."""
    raw = (text or "").encode("utf-8", "replace")
    if len(raw) <= size:
        return [text or ""]
    white = WHITE[np.frombuffer(raw, np.uint8)]
    begins = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))[::PASSAGE_WORDS]
    cuts = [0]
    for at in begins[np.unique(np.searchsorted(begins, np.arange(size, len(raw), size)).clip(max=len(begins) - 1))].tolist() if len(begins) else []:
        if at > cuts[-1]:
            cuts.append(at)
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, [*cuts[1:], len(raw)])]


def score_texts(m: Model, texts: list[str | None]) -> np.ndarray:
    """As attend() has it, in double precision. All texts are read in parts of whole passages; a text's attention is summed from part to
    part against the largest logit so far, so that its score does not depend on where it is cut."""
    m = Model(*(p.astype(np.float64) for p in m))
    top, weight, sums = np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros((len(texts), len(m.c)))

    def add(parts: list[str], owners: list[int]) -> None:
        x, owner = encode_passages(parts)
        h = np.maximum(x @ m.w1 + m.b1, 0)
        e = (np.tanh(h @ m.v) / (1 + np.exp(-(h @ m.u)))) @ m.w
        docs, doc = np.unique(np.array(owners)[owner], return_inverse=True)
        first = np.searchsorted(doc, np.arange(len(docs)))
        high = np.maximum(top[docs], np.maximum.reduceat(e, first))
        a, before = np.exp(e - high[doc]), np.exp(top[docs] - high)
        weight[docs] = weight[docs] * before + np.add.reduceat(a, first)
        sums[docs] = sums[docs] * before[:, None] + np.add.reduceat(a[:, None] * h, first)
        top[docs] = high

    parts: list[str] = []
    owners: list[int] = []
    held = 0
    for k, text in enumerate(texts):
        for part in segments(text):
            if parts and held + len(part) > CHUNK_BYTES:
                add(parts, owners)
                parts, owners, held = [], [], 0
            parts.append(part)
            owners.append(k)
            held += len(part)
    if parts:
        add(parts, owners)
    return np.round(1 / (1 + np.exp(-(sums / weight[:, None] @ m.c + m.b[0]))), 12)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """docs: (id, text); labels: (id, label 0 or 1). A sample of at most train_docs labelled rows and train_bytes of text, chosen by a hash
    of the id; whole texts. None without labels. Conflicting labels of one id count as 0."""
    known = labels.toDF(id_col, "label").where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1)).groupBy(id_col).agg(F.min("label").alias("label"))
    total = known.count()
    if not total:
        return None
    place = F.pmod(F.xxhash64(F.lit("quality sample"), id_col), F.lit(1 << 30))
    share = min(1 << 30, (2 * train_docs << 30) // total)
    chosen = known.where(place < share).orderBy(place, id_col).limit(train_docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.concatenate([encode_passages([part])[0] for part in segments(t)]).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], names=["id", "x", "label"])

    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # train_docs rows at most
    sizes = sample.groupBy(id_col).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0))).alias("size")).orderBy(place, id_col).collect()
    taken, used = [], 0
    for row in sizes:  # documents that do not fit any more are left out whole
        if used + row["size"] <= train_bytes:
            taken.append((row[0],))
            used += row["size"]
    sample = sample.join(F.broadcast(docs.sparkSession.createDataFrame(taken, docs.select(id_col).schema)), id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = sample.select(id_col, text_col, F.col("label").cast("int").alias("label")).mapInArrow(encode, f"id {kind}, x binary, label int").collect()
    rows.sort(key=lambda r: r["id"])
    if not rows:
        return None
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.array([r["label"] for r in rows], np.float32))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per row of docs, from the whole text only; other columns are not carried. Null counts as empty; without a
    model all scores are 0.5."""
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(model, texts) if model else np.full(len(texts), 0.5), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(judge, f"`{id_col}` {kind}, score double")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_values(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    model = train(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
