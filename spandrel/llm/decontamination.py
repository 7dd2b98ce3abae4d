"""Benchmark decontamination by size-partitioned MinHash containment search, in built-in functions only.

Items are partitioned by size (powers of two of their distinct five-word shingles). An item's signature is the
`k` least hashes of its shingles, k set by its partition: of an item of which a document holds a share t, at
most (1 - t) * n shingles are missing, so (1 - t) * n + 1 signature hashes cannot all be missing; for large
partitions k is cut where the chance of missing them all, (1 - t)^k, falls below `MISS`. A document of any
length is probed by all its shingle hashes, so a short item is found inside a long text. Candidate pairs are
verified by the exact share of the item's distinct shingles, compared as strings.

Signatures and verified hits are broadcast only if they are counted first and small (`BROADCAST_ROWS`);
beyond that the same joins run as shuffles. Words are runs without ASCII white space, in lower case.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = 5
THRESHOLD = 0.8
MISS = 1e-9
#: Rows up to which a counted table is broadcast: 24 bytes each, about 5 MB.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingled(rows: DataFrame, text: str = "text", n: int = WORDS, whole: bool = False) -> DataFrame:
    """A row for each window of n words, in columns w0..w{n-1}; the text goes, other columns stay. `whole`: texts of n words only."""
    words = rows.withColumn("ws", words_of(F.col(text))).filter(F.size("ws") == n if whole else F.size("ws") >= n)
    shifted = [F.slice("ws", k + 1, F.size("ws") - (n - 1)).alias(f"w{k}") for k in range(n)]
    keep = [c for c in rows.columns if c != text]
    return words.select(*keep, F.inline(F.arrays_zip(*shifted)).alias(*[f"w{k}" for k in range(n)]))


def _hash(n: int = WORDS) -> Column:
    return F.xxhash64(*[f"w{k}" for k in range(n)])


def _shingle(n: int = WORDS) -> Column:
    return F.concat_ws(" ", *[f"w{k}" for k in range(n)])


def widths_of(items: DataFrame, text: str = "text") -> list[int]:
    """The windows that items need: five words, and fewer for each count of words that a shorter item has."""
    short = items.select(F.size(words_of(F.col(text))).alias("n")).filter(F.col("n").between(1, WORDS - 1)).distinct().collect()
    return sorted({WORDS, *(r["n"] for r in short)})


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def item_shingles(items: DataFrame, widths: list[int], key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct shingles of each item with their count; items of equal key and different text stay apart.

    An item of fewer than five words is one shingle of all its words."""
    rows = items.select(F.col(key).alias("item_id"), F.xxhash64(text).alias("item_text"), F.col(text).alias("text"))
    each = [shingled(rows, n=n, whole=n < WORDS).select("item_id", "item_text", _hash(n).alias("h"), _shingle(n).alias("shingle")) for n in widths]
    shingles = _union(each).distinct()
    sizes = shingles.groupBy("item_id", "item_text").agg(F.count("*").alias("n_item"))
    return shingles.join(sizes.withColumnRenamed("item_id", "i").withColumnRenamed("item_text", "t"), F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_text") == F.col("t"))).drop("i", "t")


def signatures(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The least hashes of each item, as many as its size partition needs."""
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_item") + 0.5)))
    enough = math.ceil(math.log(MISS) / math.log(1 - threshold)) if threshold < 1 else 1
    k = F.least(F.floor(upper * (1 - threshold) + 1e-9) + 1, F.lit(enough)).cast("int")
    least = shingles.groupBy("item_id", "item_text", "n_item").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    return least.select("item_id", "item_text", F.explode(F.slice("hs", F.lit(1), k)).alias("h"))


def _bounded(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """`df` with a broadcast hint if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document text and item it holds at `threshold` or more.

    Columns: doc_id, doc_text (hash of the text), item_id, n_shared, n_item, containment. An item of fewer than five
    words is held by a text in which these words stand in a row. Nulls and empties have no shingle and match nothing;
    equal rows give one row.
    """
    common.require(docs, key, "text")
    common.require(items, "item_id", "text")
    widths = widths_of(items)
    shingles = common.checkpointed(item_shingles(items, widths))
    signed = common.checkpointed(signatures(shingles, threshold))
    n_signed, n_shingles = signed.count(), shingles.count()
    texts = docs.select(F.col(key).alias("doc_id"), F.xxhash64("text").alias("doc_text"), "text")
    probes = _union([shingled(texts, n=n).select("doc_id", "doc_text", _hash(n).alias("h")) for n in widths])
    candidates = common.checkpointed(
        probes.join(_bounded(signed, n_signed, broadcast_rows), "h").select("doc_id", "doc_text", "item_id", "item_text").distinct()
    )
    n_candidates = candidates.count()
    named = candidates.toDF("d", "t", "item_id", "item_text")
    asked = named.select("d", "t").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_text") == F.col("t"))
    held = texts.join(_bounded(asked, n_candidates, broadcast_rows), same, "left_semi")
    held = _union([shingled(held, n=n).select("doc_id", "doc_text", _shingle(n).alias("shingle")) for n in widths])
    shared = held.join(_bounded(shingles.drop("h"), n_shingles, broadcast_rows), "shingle")
    found = shared.groupBy("doc_id", "doc_text", "item_id", "item_text", "n_item").agg(F.countDistinct("shingle").alias("n_shared"))
    return found.filter(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9).select(
        "doc_id", "doc_text", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that hold no item, columns unchanged; null and empty texts stay."""
    hits = common.checkpointed(contaminated(docs, items, threshold, key, broadcast_rows).select(F.col("doc_id").alias("_d"), F.col("doc_text").alias("_t")).distinct())
    same = F.col(key).eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t"))
    return docs.join(_bounded(hits, hits.count(), broadcast_rows), same, "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    docs, items = (common.read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = contaminated(docs, items)
    best = F.max(F.struct("containment", "n_shared", "n_item")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_shared", "b.n_item", "b.containment")


OP9_SQL = r"""
with words as (
  select 'd' as kind, doc_id as id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
  union all
  select 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') from benchmark),
widths as (select distinct least(len(ws), 5) as n from words where kind = 'i' and len(ws) > 0),
p as (select kind, id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from words, widths
  where len(ws) >= n and (kind = 'd' or n = least(len(ws), 5))),
s as (select distinct kind, id, array_to_string(ws[i:i + n - 1], ' ') as shingle from p),
n as (select id, count(*) as n_item from s where kind = 'i' group by id),
c as (
  select d.id as doc_id, i.id as item_id, count(*) as n_shared
  from s d join s i on d.shingle = i.shingle where d.kind = 'd' and i.kind = 'i' group by d.id, i.id)
select doc_id, item_id, cast(n_shared as bigint) as n_shared, cast(n_item as bigint) as n_item,
  cast(n_shared as double) / n_item as containment
from c join n on c.item_id = n.id where n_shared >= n_item * 0.8 - 1e-9
"""
