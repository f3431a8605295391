"""How the word use of sources diverges: a term count over all documents, shares of each term in each source, and the distances between
sources and of each source from its whole language.

One translate table lowers A-Z and turns every separator into a space in a single pass over a text's bytes; split() gives its terms and
a Counter per document their frequencies. A task adds these up by source and hands on sums, never words. Counts stay sparse: terms that a
source does not hold are accounted for by their number, not listed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import long_values, materialise, table

_separators = bytes(b for b in range(128) if not chr(b).isalpha())
#: Lower case of A-Z; a space for every ASCII character that is no letter; all other bytes as they are.
TERMS = bytes.maketrans(bytes(range(65, 91)) + _separators, bytes(range(97, 123)) + b" " * len(_separators))
#: Entries of the counters of a task, and bytes of a text that are split at once, about.
HELD_TERMS, SPLIT_BYTES = 200_000, 1 << 20
#: What a share of 1 is in whole numbers.
SCALE = 1_000_000_000


def term_counts(raw: bytes, split_bytes: int = SPLIT_BYTES) -> Counter[bytes]:
    """How often each term stands in a text. Long texts are cut between terms, so that their list of words is never held whole."""
    words, at, counts = raw.translate(TERMS), 0, Counter()
    while at < len(words):
        end = words.find(b" ", at + split_bytes)
        end = len(words) if end < 0 else end
        counts.update(words[at:end].split())
        at = end
    return counts


def counted_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, count, docs), several rows a term: sums of a task's documents, as large as its memory allows. A null term
    stands for the group itself. Null texts, languages and sources are as ''."""
    known = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        entries = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, holders) in sums.items():
                n = len(counts) + 1
                terms = pa.array([None, *counts], pa.binary()).cast(pa.string())
                numbers = (pa.array([0, *counts.values()], pa.int64()), pa.array([0, *map(holders.__getitem__, counts)], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, n), pa.repeat(source, n), terms, *numbers], names=["lang", "source", "term", "count", "docs"])
            sums.clear()

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                counts, holders = sums[lang, source]
                before, found = len(counts), term_counts(text.as_py())
                counts.update(found)
                holders.update(found.keys())
                entries += len(counts) - before
                if entries >= held:
                    yield from flush()
                    entries = 0
        yield from flush()

    shown = docs.select(known(lang_col).alias("lang"), known(source_col).alias("source"), known(text_col).alias("text"))
    return shown.mapInArrow(count, "lang string, source string, term string, count long, docs long")


def shares(counted: DataFrame, least_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, count, p, rest, q) for each kept term that a source holds, and (lang, source, kept, held, rest) for each
    source. kept: terms of the language in at least so many of its documents; held: those in the source. p is the term's share in the
    source, q in the language, rest the share in the source of each term that it does not hold; null where the language keeps no term."""
    dealt = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    summed = dealt.withColumns({"everywhere": F.sum("count").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1, "docs": F.sum("docs").over(of_term)})
    kept = materialise(summed.where(f"term is null or docs >= {least_docs}").drop("docs"), "terms")
    by_source = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("term").alias("held"), F.count_if(F.col("first") & F.col("term").isNotNull()).alias("new"))
    of_lang = Window.partitionBy("lang")
    sources = by_source.withColumns({"kept": F.sum("new").over(of_lang), "of_lang": F.sum("total").over(of_lang)}).drop("new")
    sources = materialise(sources.withColumn("rest", F.when(F.col("kept") > 0, F.expr(_share("0", "total")))), "sources")
    terms = kept.where("term is not null").join(sources, ["lang", "source"])
    terms = terms.selectExpr("lang", "source", "term", "count", f"{_share('count', 'total')} as p", "rest", f"{_share('everywhere', 'of_lang')} as q")
    return materialise(terms, "shares"), sources.select("lang", "source", "kept", "held", "rest")


def _share(count: str, total: str) -> str:
    """1 + the share of a term, with one count more for every term, in whole numbers; decimals, so that no count overflows."""
    return f"1 + (cast({count} + 1 as decimal(20,0)) * {SCALE}) div cast({total} + kept as decimal(20,0))"


def _distance(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def pair_distances(terms: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language: the sum over all kept terms of (p - q)^2 / q, rounded down by
    term, with p the shares in source and q those in item.

    Three sums give it: over the terms of the one, over those of the other (both by how many terms have a share, a short list), and over
    the terms that both hold, which alone are joined; what the first two count wrongly there, the third takes back."""
    held = terms.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    a = sources.select("lang", "source", F.col("held").alias("held_a"), F.col("rest").alias("p0"), "kept")
    b = sources.select("lang", F.col("source").alias("item"), F.col("held").alias("held_b"), F.col("rest").alias("q0"))
    pairs = a.join(b, "lang").where("source <> item")
    neither = pairs.selectExpr("lang", "source", "item", f"coalesce((kept - held_a - held_b) * ({_distance('p0', 'q0')}), 0) as value")
    ours = pairs.join(held, ["lang", "source"]).selectExpr("lang", "source", "item", f"n * ({_distance('p', 'q0')}) as value")
    theirs = pairs.join(held.withColumnsRenamed({"source": "item", "p": "q"}), ["lang", "item"]).selectExpr("lang", "source", "item", f"n * ({_distance('p0', 'q')}) as value")
    other = terms.selectExpr("lang", "term", "source as item", "p as p_", "rest as q0")
    common = terms.selectExpr("lang", "term", "source", "p", "rest as p0").join(other, ["lang", "term"]).where("source <> item")
    both = common.selectExpr("lang", "source", "item", f"{_distance('p', 'p_')} - {_distance('p', 'q0')} - {_distance('p0', 'p_')} + {_distance('p0', 'q0')} as value")
    return neither.union(ours).union(theirs).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_audit(docs: DataFrame, top: int = 200, least_docs: int = 3, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank). Part pair: the distance of each source of a language from each other one, all ranks. Part
    term: the terms whose share in a source is above that in its language, by what they add to the distance from it, the first `top`.

    Ranks are by falling value, then item in byte order. Null texts, languages and sources are as ''; a source without terms has pairs but
    no terms; a language that keeps no term has the distance 0; equal rows count as often as they stand there; no rows give none. Other
    columns play no part. Long texts are counted in stretches."""
    terms, sources = shares(counted_terms(docs, lang_col, source_col, text_col), least_docs)
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_distances(terms, sources).withColumn("rank", F.row_number().over(ranks)).withColumn("part", F.lit("pair"))
    above = terms.where("p > q").selectExpr("lang", "source", "term as item", f"{_distance('p', 'q')} as value")
    strongest = above.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(strongest).select("lang", "source", "part", "item", "value", "rank")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_values(spark)
    return source_audit(table(spark, sf_dir, "documents"))
