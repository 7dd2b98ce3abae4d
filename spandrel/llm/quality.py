"""Quality rules as a short-circuit cascade.

Each rule rejects a text by figures that are worked out only when a rule asks for them. On a bounded sample
(`SAMPLE_ROWS` rows, a parameter) every rule's cost and rejections are measured on the executors; rules then
run in order of rejections per cost, and a text leaves the cascade at its first rejection. The order changes
cost only: a text is kept exactly if no rule rejects it.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows on which the cost and selectivity of rules are estimated.
SAMPLE_ROWS = 256
SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_SPACE = " \t\n\x0b\x0c\r"


class Figures:
    """Figures of one text, each worked out once and on demand; a null text is empty."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_upper(self) -> int:
        raw = self.text.encode()
        return len(raw) - len(raw.translate(None, _UPPER))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that the text holds twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, n)
        windows = ids[:-1] * len(seen) + ids[1:]
        if len(seen) > 2_000_000:
            windows = np.unique(windows, return_inverse=True)[1]
        windows = windows[:-1] * len(seen) + ids[2:]
        ordered = np.sort(windows)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        found = np.isin(windows, twice)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= found
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Figures], bool]


#: The first two are the base rules; the rest are the further rules of the cascade.
RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("duplicate_lines", lambda t: 100 * t.n_dup_lines > 40 * len(t.lines)),
    Rule("capitals", lambda t: 100 * t.n_upper > 30 * t.word_chars),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 12 * t.n_words),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: int


def ordered(rules: Iterable[Rule], estimates: Iterable[Estimate]) -> list[Rule]:
    """Rules by rejections per second, most first; ties and rules without an estimate stay in their order."""
    gain = {e.name: e.rejected / max(e.seconds, 1e-9) for e in estimates}
    return sorted(rules, key=lambda r: -gain.get(r.name, 0.0))


def kept(text: str | None, rules: Iterable[Rule]) -> bool:
    """Runs the cascade: stops at the first rule that rejects."""
    figures = Figures(text)
    return not any(r.rejects(figures) for r in rules)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, text: str = "text") -> list[Estimate]:
    """Cost and rejections of each rule by itself on the first `rows` rows of the first partition that has any.

    The limit lets Spark stop after that partition; only a row for each rule reaches the driver.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, hits, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            values = batch.column(0).slice(0, rows - seen).to_pylist() if seen < rows else []
            seen += len(values)
            for value, (i, rule) in itertools.product(values, enumerate(rules)):
                start = time.perf_counter()
                hits[i] += rule.rejects(Figures(value))
                took[i] += time.perf_counter() - start
        if seen:
            yield pa.RecordBatch.from_pydict({"name": [r.name for r in rules], "seconds": took, "rejected": hits})

    common.small_batches(docs.sparkSession)
    measured = docs.select(F.col(text).alias("t")).mapInArrow(measure, "name string, seconds double, rejected long")
    return [Estimate(r["name"], r["seconds"], r["rejected"]) for r in measured.limit(len(rules)).collect()]


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows whose text no rule rejects, columns unchanged. A null text is empty; no row is merged or split."""
    common.require(docs, text)
    chain = ordered(rules, estimate(docs, rules, sample_rows, text))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([kept(t, chain) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


FIGURE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row: doc_id, the base figures, base_failed, kept.

    Null and empty texts have figures of 0 and fail. Repeated rows and ties get a row each; extra columns
    are ignored; an empty table gives an empty result.
    """
    common.require(docs, key, text)
    chain = ordered(rules, estimate(docs, rules, sample_rows, text))
    base = [r for r in rules if r.name in ("few_words", "repeated_words")]
    types = [pa.int64()] * len(FIGURE_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures = [Figures(t) for t in batch.column(1).to_pylist()]
            failed = [any(r.rejects(f) for r in base) for f in figures]
            good = [not bad and not any(r.rejects(f) for r in chain) for f, bad in zip(figures, failed, strict=True)]
            columns = [pa.array([getattr(f, c) for f in figures], t) for c, t in zip(FIGURE_COLUMNS, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(failed, pa.bool_()), pa.array(good, pa.bool_())],
                ["doc_id", *FIGURE_COLUMNS, "base_failed", "kept"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in FIGURE_COLUMNS) + ", base_failed boolean, kept boolean"
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures and the verdict for all documents."""
    return judge(common.read_table(spark, sf_dir, "documents"))


#: The verdict is the conjunction of all rules, whatever their order.
OP8_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (
  select rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
l as (
  select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select rid, unnest(string_split(t, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
p as (
  select rid, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
g as (
  select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) as c from p),
r as (
  select rid, count(distinct i + k) as n_repeat_words
  from g cross join (select unnest([0, 1, 2]) as k) where c > 1 group by rid),
f as (
  select w.doc_id, cast(len(ws) as bigint) as n_words,
    cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    coalesce(n_lines, 0) as n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper
  from w left join l on w.rid = l.rid left join r on w.rid = r.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words
    or 100 * n_dup_lines > 40 * n_lines or 100 * n_upper > 30 * word_chars
    or word_chars < 2 * n_words or word_chars > 12 * n_words) as kept
from f
"""
