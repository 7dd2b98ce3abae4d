"""How filters interact: for every order of five filters, what each removes, misses and costs.

A relational word pipeline: texts are moved by document once, words exploded, counted by (document, word) and
then by document for totals and distincts, both without a further shuffle. The other flags (capitals, symbols,
repeated text, labels) are outer-joined, and one aggregation counts documents by the 32 sets of filters that they
can fail. All orders and steps follow from these counts, so nothing is read once an order.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
MIN_WORDS = 200
MASKS = 2 ** len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SPACE = r"[\x20\x09-\x0D]+"


def word_totals(rows: DataFrame) -> DataFrame:
    """(k, tid, n_words, n_distinct) for the documents (k, tid, t); equal rows share one result.

    Rows are hashed by `k`, which spreads them evenly; both aggregations then find their groups in place. An empty
    word closes each text, so that texts without words stay and equal rows can be told by their number.
    """
    words = F.array_append(F.array_remove(F.split("t", SPACE), ""), F.lit(""))
    exploded = rows.repartition("k").select("k", "tid", F.explode(words).alias("word"))
    by_word = exploded.groupBy("k", "tid", "word").agg(F.count("*").alias("n"))
    is_word = F.col("word") != ""
    by_doc = by_word.groupBy("k", "tid").agg(
        F.sum(F.when(is_word, F.col("n")).otherwise(0)).alias("words"), F.count_if(is_word).alias("n_distinct"), F.sum(F.when(~is_word, F.col("n"))).alias("copies")
    )
    return by_doc.select("k", "tid", F.expr("words div copies").alias("n_words"), "n_distinct")


def fails_once(rows: DataFrame) -> DataFrame:
    """`rows` (k, same, ...) with `e`: whether a lesser k has the same text. Texts that occur once need no join."""
    first = rows.groupBy("same").agg(F.min("k").alias("first"), F.count("*").alias("n")).filter("n > 1")
    marked = rows.join(first.select("same", "first"), "same", "left")
    return marked.withColumn("e", F.coalesce(F.col("k") > F.col("first"), F.lit(False))).drop("first")


def flagged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(k, part, mask, good, toxic), a row for each document; bit i of `mask` is set if filter i fails it."""
    common.require(docs, key, text, part)
    common.require(labels, key, "quality", "toxic")
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("tid", F.xxhash64("t"))
    capitals = F.octet_length(F.regexp_replace("t", "[^A-Z]+", ""))
    others = rows.select(
        "k",
        "tid",
        "part",
        F.unhex(F.md5("t")).alias("same"),
        (100 * capitals > 3 * F.length("t")).alias("c"),
        F.col("t").rlike("[#$%&*|]").alias("d"),
    )
    others = fails_once(others)
    totals = word_totals(rows.select("k", "tid", "t")).select(F.col("k").alias("wk"), F.col("tid").alias("wt"), "n_words", "n_distinct")
    judged = labels.groupBy(F.col(key).alias("lk")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = others.join(totals, F.col("k").eqNullSafe(F.col("wk")) & (F.col("tid") == F.col("wt")), "left").join(judged, F.col("k") == F.col("lk"), "left")
    fails = (F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < 50 * F.col("n_words"), F.col("c"), F.col("d"), F.col("e"))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    no = F.lit(False)
    return joined.select("k", "part", mask.alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def counted(flags: DataFrame) -> DataFrame:
    """(part, n, g, x): numbers of all, good and toxic documents of each part, by mask: arrays of 32 counts."""
    kinds = {"n": F.lit(True), "g": F.col("good"), "x": F.col("toxic")}
    sums = [F.count_if((F.col("mask") == m) & is_kind).alias(f"{kind}{m}") for kind, is_kind in kinds.items() for m in range(MASKS)]
    wide = flags.groupBy("part").agg(*sums)
    return wide.select("part", *[F.array(*[F.col(f"{kind}{m}") for m in range(MASKS)]).alias(kind) for kind in kinds])


def _bits(letters: Column) -> Column:
    return sum((F.when(F.instr(letters, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))


def report(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step; see `audit`."""
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    steps = counts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    steps = steps.withColumn("before", _bits(F.expr("left(filter_order, step - 1)"))).withColumn("bit", _bits(F.expr("substr(filter_order, step, 1)")))

    def total(kind: str, which: str) -> Column:
        return F.expr(f"aggregate(filter(sequence(0, {MASKS - 1}), m -> {which}), 0L, (s, m) -> s + {kind}[m])")

    here = "(m & before) = 0 and (m & bit) <> 0"
    out = steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        "bit",
        total("n", "(m & (before | bit)) = 0").alias("kept"),
        total("n", here).alias("removed"),
        total("n", "(m & before) <> 0 and (m & bit) <> 0").alias("redundant"),
        F.expr("n[bit]").alias("unique_fails"),
        total("g", here).alias("good_lost"),
        total("x", here).alias("toxic_lost"),
    )
    shares = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "bit"]).select("part", "filter_order", "step", *COUNTS)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row, zeros included, for each part, each of the 120 orders of the filters A to E, and each step.

    Counts of documents: kept after the step; removed by it; redundant (failing its filter, removed before);
    unique_fails (failing that filter only); good_lost and toxic_lost (removed here with quality or toxic 1);
    shapley (what its filter removes, summed over all orders).

    Null texts are empty (they fail A alone, and E with an empty text of lesser id), null parts are the part "".
    Repeated rows are documents of their own: equal ids fail E for neither. A null id is neither less nor more than
    any, so it never fails E and has no label. Of several labels of one id, any that is 1 counts. Further columns
    are ignored; an empty table gives an empty result.
    """
    return report(counted(flagged(docs, labels, key, text, part)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the five filters over all documents, by language."""
    return audit(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
w as (
  select rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
first as (select t, min(doc_id) as first from d group by t),
l as (select doc_id, max(quality) filter (quality = 1) as good, max(toxic) filter (toxic = 1) as toxic from labels group by doc_id),
f as (
  select d.part, coalesce(good, 0) as good, coalesce(l.toxic, 0) as toxic,
    len(ws) < 200 as a, 100 * len(list_distinct(ws)) < 50 * len(ws) as b,
    100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 3 * length(d.t) as c,
    regexp_matches(d.t, '[#$%&*|]') as d, coalesce(d.doc_id > first.first, false) as e
  from d join w using (rid) join first on d.t = first.t left join l on l.doc_id = d.doc_id),
g as (
  select part, concat(case when a then 'A' else '' end, case when b then 'B' else '' end, case when c then 'C' else '' end,
    case when d then 'D' else '' end, case when e then 'E' else '' end) as fails, good, toxic, count(*) as n
  from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (
  select concat(p.x, q.x, r.x, s.x, t.x) as filter_order from x p, x q, x r, x s, x t
  where p.x not in (q.x, r.x, s.x, t.x) and q.x not in (r.x, s.x, t.x) and r.x not in (s.x, t.x) and s.x <> t.x),
st as (select filter_order, step, filter_order[step] as letter, left(filter_order, step - 1) as earlier from o, (select unnest([1, 2, 3, 4, 5]) as step)),
h as (
  select g.*, st.*, contains(fails, letter) as bad, translate(fails, earlier, '') <> fails as gone from g, st),
r as (
  select part, filter_order, step, letter, cast(sum(n) filter (not bad and not gone) as bigint) as kept, cast(sum(n) filter (bad and not gone) as bigint) as removed,
    cast(sum(n) filter (bad and gone) as bigint) as redundant, cast(sum(n) filter (fails = letter) as bigint) as unique_fails,
    cast(sum(n) filter (bad and not gone and good = 1) as bigint) as good_lost, cast(sum(n) filter (bad and not gone and toxic = 1) as bigint) as toxic_lost
  from h group by part, filter_order, step, letter)
select part, filter_order, cast(step as integer) as step, coalesce(kept, 0) as kept, coalesce(removed, 0) as removed, coalesce(redundant, 0) as redundant,
  coalesce(unique_fails, 0) as unique_fails, coalesce(good_lost, 0) as good_lost, coalesce(toxic_lost, 0) as toxic_lost,
  cast(sum(coalesce(removed, 0)) over (partition by part, letter) as bigint) as shapley
from r
"""
