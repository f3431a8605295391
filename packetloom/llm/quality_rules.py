"""Quality rules as a short-circuit cascade: each task measures on its first rows what every rule costs and rejects, then
asks the rules in order of rejections per second and stops at the first that rejects. The order never changes a verdict."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from time import perf_counter_ns
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import long_values, table

SYMBOLS = "#*$%&|<>"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123)) + bytes(range(128, 256))
ASCII_LETTERS = CAPITALS + bytes(range(97, 123))
#: Rows on which a task tries all rules before it fixes their order.
SAMPLE_ROWS = 128


class Text:
    """One whole text; features are computed when a rule first asks for them. None counts as empty."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "replace")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that the text holds twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in self.words], np.int64)
        v = len(seen)
        if v < 2_000_000:
            windows = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:  # the product would not fit: number the pairs first
            windows = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1] * v + ids[2:]
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        marked = np.zeros(n, bool)
        for shift in range(3):
            marked[shift : n - 2 + shift] |= again
        return int(marked.sum())

    def share(self, chars: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, chars))


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


#: What base_failed says.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
#: The method's own rules: symbols, capitals, marks, repeated lines, word length, share of letters.
MORE_RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("capitals", lambda t: 2 * t.share(CAPITALS) > t.share(ASCII_LETTERS)),
    Rule("shouting", lambda t: 3 * t.text.count("!") > t.n_words),
    Rule("dup_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 16 * t.n_words),
    Rule("letters", lambda t: 2 * t.share(LETTERS) < len(t.raw) - t.share(b" \t\n\x0b\x0c\r")),
)


class Cascade:
    """Asks rules until one rejects. The first SAMPLE_ROWS texts try every rule, each on a fresh text so that it pays for
    its own features; then the rules stand by rejections per nanosecond."""

    def __init__(self, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS):
        self.rules, self.left = list(rules), sample_rows
        self.cost = dict.fromkeys((r.name for r in rules), 1)
        self.rejected = dict.fromkeys((r.name for r in rules), 0)

    def rejects(self, text: Text) -> bool:
        if self.left <= 0:
            return any(rule.rejects(text) for rule in self.rules)
        bad = False
        for rule in self.rules:
            fresh, began = Text(text.text), perf_counter_ns()
            no = rule.rejects(fresh)
            self.cost[rule.name] += perf_counter_ns() - began
            self.rejected[rule.name] += no
            bad |= no
        self.left -= 1
        if not self.left:
            self.rules.sort(key=lambda r: (-self.rejected[r.name] / self.cost[r.name], self.cost[r.name]))
        return bad


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: one row per row of docs.

    Null and empty texts have zeros and fail. Whole texts are read; other columns are left out."""
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(MORE_RULES)
        for batch in batches:
            out: list[list] = [[] for _ in range(len(STATS) + 2)]
            for value in batch.column(1):
                t = Text(value.as_py())
                failed = any(r.rejects(t) for r in BASE_RULES)
                for column, x in zip(out, (*(getattr(t, s) for s in STATS), failed, not failed and not cascade.rejects(t))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:-2]), *(pa.array(c, pa.bool_()) for c in out[-2:])], names=[id_col, *STATS, "base_failed", "kept"])

    schema = f"`{id_col}` {kind}, {', '.join(f'{s} long' for s in STATS)}, base_failed boolean, kept boolean"
    return docs.select(id_col, text_col).mapInArrow(judge, schema)


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """The rows of docs, all columns as they are, whose text no rule rejects."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([not cascade.rejects(Text(x.as_py())) for x in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_values(spark)
    return quality_stats(table(spark, sf_dir, "documents"))
