"""From raw documents to packed training sequences, in four stages, each of which takes what the one before kept.

1. quality_rules: documents that a rule of the cascade rejects go.
2. language_id: documents whose language is not decided by a clear margin go.
3. near_duplicates: of each group of documents that five-word shingles link (Jaccard 0.8 or more), the smallest id stays.
4. packing: the tokens of what is left, packed into sequences of 4096.

Empty tables pass through as empty ones. Null and empty texts fail the first stage. Columns of documents, known or not, are kept as
they are up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import long_values, materialise, table
from packetloom.llm.lang_id import language_filter, train
from packetloom.llm.packing import pack, tokenized_pieces
from packetloom.llm.quality_rules import quality_filter
from packetloom.llm.shingle_join import drop_similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no rule rejects. A null or empty text has too few words; equal rows stay or go together; an empty table stays empty."""
    long_values(spark)
    return quality_filter(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is decided by a clear margin. Dictionaries come from the labelled rows of the input; without any, nothing
    can be decided and all rows stay. Null texts, texts without a letter and ties between languages go."""
    long_values(spark)
    model = train(docs)
    return language_filter(docs, model) if model.dictionaries else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id. Rows without an id or a word stay; rows with one id are one document."""
    long_values(spark)
    return drop_similar(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces; a null or empty text is its end id alone, and a
    row without an id is packed like any other. No other column is carried."""
    import public_tokenizers

    long_values(spark)
    pieces = tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), cached=200_000, split_bytes=1 << 20)
    return pack(materialise(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: Compression and tokenization have no SQL form; tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
