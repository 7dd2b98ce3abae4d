"""Spelling variants: words that differ by one code point, grouped under their most frequent form.

The vocabulary joins itself in tries, partitioned by prefix. Two words of lengths m and m or m + 1 that differ by one
code point share their first m // 2 code points or their last m - m // 2. So a word goes to a trie of the words that
share its first half (read forwards) and to one of those that share its last half (read backwards), as the shorter
and as the longer word of a pair. Inside a trie, active-node sets are propagated downwards: of each node, the nodes
whose path is one edit away, worked out from those of its parent. Words that end on active nodes are near.

A trie of more than `BLOCK` words is cut again by the halves of what is left of its words, the same law holding for
the rest as for the word; after log2(length) cuts a trie holds at most the words of two code points, so no
task takes more than a bounded trie, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_LENGTH = 5
MIN_COUNT = 3
#: One run in so many loses a code point.
DAMAGED = 97
#: Words of a trie that one task builds at once.
BLOCK = 20_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(word: Column) -> Column:
    """`word` with A-Z alone lower-cased; `lower` does so, faster, where all code points are ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """(word), a row for each run of letters of at least `least` code points after its damage, if any.

    Shorter runs cannot grow, so the pattern leaves them out. A null id counts as an empty one.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.expr(f"explode(regexp_extract_all({text}, '[A-Za-z\\\\u00C0-\\\\u00FF]{{{least},}}', 0))").alias("run"))
    lowered = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    hashed = lowered.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    cut = F.expr("concat(left(run, cast(h % length(run) as int)), substr(run, cast(h % length(run) as int) + 2))")
    return hashed.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LENGTH, count: int = MIN_COUNT) -> DataFrame:
    """(word, n) for words of at least `least` code points that occur `count` times or more."""
    return occurrences(docs, key, text, least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def halved(rows: DataFrame) -> DataFrame:
    """`rows` (word, n, block, rest, m), each in its two tries: those that share the first or the last half of `rest`.

    `m` is the length of the shorter word of the pairs looked for; rests are m or m + 1 long. Of rests read
    backwards, the shared half is still the one read first.
    """
    head = F.expr("cast(m div 2 as int)")
    tail = F.expr("cast(m - m div 2 as int)")
    forwards = F.struct(F.concat("block", F.lit("/"), "m", F.lit("<"), F.expr("left(rest, cast(m div 2 as int))")).alias("block"), F.expr("substr(rest, cast(m div 2 as int) + 1)").alias("rest"), tail.alias("m"))
    backwards = F.struct(
        F.concat("block", F.lit("/"), "m", F.lit(">"), F.expr("right(rest, cast(m - m div 2 as int))")).alias("block"),
        F.expr("reverse(left(rest, length(rest) - cast(m - m div 2 as int)))").alias("rest"),
        head.alias("m"),
    )
    return rows.select("word", "n", F.explode(F.array(forwards, backwards)).alias("at")).select("word", "n", "at.*")


def neighbours(rests: list[str], m: int) -> Iterator[tuple[int, int]]:
    """(i, j) for all rests i and j at distance one of which the shorter has m code points, both ways round.

    Builds the trie of the rests and goes down it with the active-node set of each node: itself, and those at
    distance one: its parent (one deleted), siblings (one replaced), children (one inserted), and the equally
    labelled children of the nodes active for its parent.
    """
    children: list[dict[str, int]] = [{}]
    ends: list[list[int]] = [[]]
    for i, rest in enumerate(rests):
        at = 0
        for x in rest:
            below = children[at].get(x)
            if below is None:
                below = children[at][x] = len(children)
                children.append({})
                ends.append([])
            at = below
        ends[at].append(i)
    todo: list[tuple[int, set[int]]] = [(0, set(children[0].values()))]
    while todo:
        node, active = todo.pop()
        for i in ends[node]:
            for near in active:
                for j in ends[near]:
                    if min(len(rests[i]), len(rests[j])) == m:
                        yield i, j
        below = children[node]
        if not below:
            continue
        siblings = set(below.values())
        for x, child in below.items():
            reached = {children[v].get(x) for v in active}
            todo.append((child, (reached | siblings | {node, *children[child].values()}) - {None, child}))


def joined_tries(rows: DataFrame) -> DataFrame:
    """(word, near, near_n): pairs at distance one inside each block of `rows` (word, n, block, rest, m).

    Rows are brought together by block and sorted; a task holds one block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list[str], list[str], list[int]] = ([], [], [])
        block, level, rests, words, counts = None, 0, [], [], []

        def close() -> None:
            if len(rests) > 1:
                for i, j in neighbours(rests, level):
                    out[0].append(words[i])
                    out[1].append(words[j])
                    out[2].append(counts[j])

        def batch_out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])
            for column in out:
                column.clear()
            return done

        for batch in batches:
            for word, n, at, rest, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != block:
                    close()
                    block, level, rests, words, counts = at, m, [], [], []
                    if len(out[0]) > 10_000:
                        yield batch_out()
                rests.append(rest)
                words.append(word)
                counts.append(n)
        close()
        yield batch_out()

    together = rows.select("word", "n", "block", "rest", "m").repartition("block").sortWithinPartitions("block")
    return together.mapInArrow(run, "word string, near string, near_n long")


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) for all words of (word, n) that differ by one code point, both ways round; pairs may repeat.

    Sizes of all tries are counted first (partial counts before the shuffle); those above `block` are cut again.
    """
    length = F.length("word")
    level = words.select("word", "n", F.lit("").alias("block"), F.col("word").alias("rest"), F.explode(F.array(length, length - 1)).alias("m")).filter("m > 0")
    found = None
    while True:
        level = halved(level)
        large = common.stored(level.groupBy("block").agg(F.count("*").alias("size"), F.first("m").alias("m")).filter((F.col("size") > block) & (F.col("m") > 1)).select("block"), "large-tries")
        none = large.isEmpty()
        pairs = joined_tries(level if none else level.join(large, "block", "left_anti"))
        found = pairs if found is None else found.union(pairs)
        if none:
            return found
        level = common.stored(level.join(large, "block", "left_semi"), "cut-tries")


def roots(forms: DataFrame, most: int = 50) -> DataFrame:
    """(word, root) for (word, form): the end of the chain of forms, by doubling. A form at least doubles the count, so chains are short and have no cycle."""
    ties = forms.select("word", F.col("form").alias("root"))
    for _ in range(most):
        further = ties.select(F.col("word").alias("at"), F.col("root").alias("next"))
        ties = common.stored(ties.join(further, ties["root"] == further["at"], "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        done = ties.filter("next is not null").isEmpty()
        ties = ties.select("word", "root")
        if done:
            return ties
    raise RuntimeError(f"chains of forms did not end in {most} rounds")


def variants(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary (word, n) of distinct words.

    `form` is the most frequent word at distance one (ties: least in code-point order) if it is at least twice as
    frequent, else null; `root` is where the forms end. Words near none have n_near 0. An empty vocabulary
    gives an empty result.
    """
    pairs = near_pairs(words, block).repartition("word").dropDuplicates(["word", "near"])
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near_n = -F.col("best.less")
    strong = near_n >= 2 * F.col("n")
    listed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, near_n).alias("form_n")
    )
    listed = common.stored(listed, "forms")
    ends = roots(listed.filter("form is not null").select("word", "form"))
    return listed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The variants of all words of `docs`; see `variants`, `vocabulary` and `occurrences`.

    Null and empty texts have no words; repeated rows count as often as they stand; a word of any length is read whole.
    Further columns are ignored; an empty table gives an empty result.
    """
    common.require(docs, key, text)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return variants(common.stored(vocabulary(rows), "vocabulary"), block)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants of all words of the documents."""
    return group_spellings(common.read_table(spark, sf_dir, "documents"))
