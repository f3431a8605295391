"""Language by compression: a text belongs to the language whose zstandard raw-content dictionary makes it smallest; where the
runner-up comes close, the decision is rejected."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, long_values, table

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Labelled rows per language that the dictionaries are made of at most, and the bytes of a dictionary.
SAMPLE_ROWS, DICTIONARY_BYTES = 300, 64 << 10
#: A raw-content dictionary has so many bytes at least; shorter ones are filled up with spaces.
LEAST_BYTES = 8
#: A text is compressed in blocks of so many bytes, so that the dictionary counts as much at the end of a long text as at its start.
BLOCK = 2048
#: The runner-up has to be larger by so many bytes, and by this share of the smallest.
MARGIN_BYTES, MARGIN_SHARE = 1, 0.002


class Model(NamedTuple):
    """For each language its dictionary, and the bytes that its rarity costs: -log2 of its share of the labelled rows / 8."""

    dictionaries: dict[str, bytes]
    priors: dict[str, float]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """A dictionary for each language that a row has: texts of up to sample_rows rows, chosen by a hash of the key, joined up to
    dictionary_bytes. Rows without language or text are left out. The driver gets no more texts than fill the dictionaries: less
    than twice dictionary_bytes per language."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(key).alias("key"), F.col(text_col).alias("text"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model({}, {})
    place = F.pmod(F.xxhash64(F.lit("language sample"), "key", F.when(F.col("key").isNull(), F.col("text"))), F.lit(1 << 30))
    shares = labelled.sparkSession.createDataFrame([(lang, min(1 << 30, (2 * sample_rows << 30) // n)) for lang, n in counts.items()], "lang string, share long")  # a row a language
    found = known.withColumn("place", place).join(F.broadcast(shares), "lang").where("place < share")
    found = found.select("lang", "place", "key", F.substring("text", 1, dictionary_bytes).alias("text"))
    order = "partition by lang order by place, key, text"
    before = f"coalesce(sum(octet_length(text)) over ({order} rows between unbounded preceding and 1 preceding), 0) as before"
    rows = found.selectExpr("*", f"row_number() over ({order}) as n", before).where((F.col("n") <= sample_rows) & (F.col("before") < dictionary_bytes)).collect()
    texts: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for r in sorted(rows, key=lambda r: r["n"]):
        left = dictionary_bytes - sum(map(len, texts[r["lang"]]))
        texts[r["lang"]].append(r["text"].lower().encode("utf-8", "replace")[: max(left, 0)])
    # zstandard reaches the end of a dictionary at the lowest cost.
    out = {lang: b"\n".join(reversed(texts[lang])).ljust(LEAST_BYTES) for lang in sorted(texts)}
    return Model(out, {lang: -math.log2(counts[lang] / sum(counts.values())) / 8 for lang in out})


class Compressors:
    """Sizes of whole texts, in lower case, under the dictionary of each language."""

    def __init__(self, model: Model, block: int = BLOCK):
        self.langs, self.block = sorted(model.dictionaries), block
        self.priors = [model.priors[lang] for lang in self.langs]
        # Short matches tell languages apart: four bytes at least, found greedily.
        options = zstandard.ZstdCompressionParameters.from_level(3, dict_size=DICTIONARY_BYTES, source_size=block, strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=3, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.compress = []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(model.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=options)
            self.compress.append(zstandard.ZstdCompressor(dict_data=data, compression_params=options).compress)

    def sizes(self, raw: bytes) -> list[float]:
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return [prior + sum(len(c(b)) for b in blocks) for c, prior in zip(self.compress, self.priors)]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted). The score falls with the bytes by which each other language is worse; without a letter: und, 0.
        Of equally small ones the first by name is taken, and not accepted."""
        if text is None or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, False
        sizes = np.array(self.sizes(text.lower().encode("utf-8", "replace")), float)
        best = int(sizes.argmin())
        worse = sizes - sizes[best]
        margin = np.partition(worse, 1)[1] if len(worse) > 1 else np.inf
        accepted = bool(margin >= max(MARGIN_BYTES, MARGIN_SHARE * sizes[best]))
        return self.langs[best], float(1 / np.exp(-worse / 4).sum()), accepted


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted), one row per row of docs; only the text decides. Null texts and texts without a
    letter are `und` and not accepted; without dictionaries every text is."""
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Compressors(model)
        for batch in batches:
            langs, scores, accepted = [], [], []
            for value in batch.column(1):
                a, b, c = sizes.judge(value.as_py())
                langs.append(a), scores.append(b), accepted.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=[id_col, "lang_pred", "score", "accepted"])

    return docs.select(id_col, text_col).mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean")


def language_filter(docs: DataFrame, model: Model, text_col: str = "text", wanted: set[str] | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is decided with a clear margin (and wanted, if given)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Compressors(model)
        for batch in batches:
            judged = [sizes.judge(x.as_py()) for x in batch.column(batch.schema.get_field_index(text_col))]
            yield batch.filter(pa.array([ok and (wanted is None or lang in wanted) for lang, _, ok in judged], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


#: Rows of this fold of the id's crc32 are held out of training.
FOLDS = 5


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_values(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))  # a row without an id is not held out
    return identify(docs, train(docs.where(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
