"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

A text's set holds its distinct windows of five words; texts with equal sets are one class from the start. Each set
has a path of `MAX_DEPTH` labels in each of `TREES` tries, a label being one byte of a MinHash. All paths are stored
and sorted by tree and path, which is the trie written out: a node is a run of paths with a common prefix, and the
longest prefix that a set shares with any other stands beside it. Matched prefixes are shortened, level by level from
the full depth, until a pair of the asked similarity shares one in some tree with the target recall (`shortest`); one
scan in sorted order ties each run of paths whose common prefix is that long to the least set of the run. That last level follows from similarity and
recall and so is the same for all sets.

The components of the ties are the groups to verify. A group of up to `BLOCK` sets is verified at once. A larger
one is sorted by its first path and cut into blocks, and two blocks meet only if some node has sets in both; so a
group that chance matches have chained costs in proportion to its size. All intersections of two blocks come from
one product of 0/1 matrices, exactly. A task emits a row for each set (its links) and a spanning forest of the
links, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, RECALL = 32, 8, 0.9999
#: Sets that one side of a verification task holds, about.
BLOCK = 448
#: Rows up to which a counted table is broadcast, 16 bytes each.
BROADCAST_ROWS = 200_000
#: Words whose hashes a task keeps.
CACHE_WORDS = 400_000


def shortest(threshold: float, recall: float = RECALL, trees: int = TREES, deepest: int = MAX_DEPTH) -> int:
    """How far prefixes are shortened: the first depth, from the full one, at which a pair of the asked similarity
    shares a prefix in some tree with the target recall."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError(f"{trees} trees cannot reach recall {recall} at similarity {threshold}, even with one hash each")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < CACHE_WORDS:
            self[word] = out
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows of n words; a shorter text is one window, an empty one has none."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


class Forest:
    """The paths of a set, one for each tree: `MAX_DEPTH` labels of a byte, the first one highest."""

    def __init__(self, trees: int = TREES, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.trees = trees
        self.mul = rng.integers(0, 1 << 63, trees * MAX_DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, trees * MAX_DEPTH, np.uint64)

    def paths(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.trees * MAX_DEPTH, np.iinfo(np.uint64).max)
        for k in range(0, len(shingles), 1024):
            np.minimum(least, (shingles[k : k + 1024, None] * self.mul + self.add).min(axis=0), out=least)
        labels = (_mixed(least) >> np.uint64(56)).astype(np.uint8)
        return labels.reshape(self.trees, MAX_DEPTH).copy().view(">i8")[:, 0].astype(np.int64)


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits, so that different sets stay apart however many there are."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def row_key(docs: DataFrame, key: str, text: str) -> Column:
    """128 bits of a row's key and text."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    return F.concat(F.hex(F.xxhash64(name, F.col(text))), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), F.col(text), name)))


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, row_key, set_id (null: no words) and the paths of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, forest = WordHashes(), Forest()
        for batch in batches:
            ids, paths = [], []
            for t in batch.column(2).to_pylist():
                s = shingle_set(t, hashes)
                ids.append(set_id(s) if len(s) else None)
                paths.append(forest.paths(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(paths, pa.list_(pa.int64()))], ["doc_id", "row_key", "set_id", "paths"])

    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), row_key(docs, key, text).alias("row_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, row_key string, set_id binary, paths array<long>")


def _shared_depth(tree_a: np.ndarray, path_a: np.ndarray, tree_b: np.ndarray, path_b: np.ndarray) -> np.ndarray:
    """Labels that two paths have in common from the start; -1 in different trees."""
    differ = (path_a ^ path_b).view(np.uint64)
    depth = sum((differ >> np.uint64(8 * (MAX_DEPTH - d)) == 0).astype(np.int64) for d in range(1, MAX_DEPTH + 1))
    return np.where(tree_a == tree_b, depth, -1)


def ties(paths: DataFrame, depth: int) -> DataFrame:
    """(a, b): sets of `paths` (tree, path, node) in one node of `depth` labels of the sorted tries; b is the least of its run.

    A run ends with the node or with the Arrow batch, whose runs of one node are tied to each other. The sort is by range, so a node of any size is spread over tasks; each task hands its first and last path to
    the driver, where neighbours on two sides of a cut are tied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, TaskContext.get().partitionId()

        def out(a: np.ndarray, b: np.ndarray, edge: int, tree: int, path: int) -> pa.RecordBatch:
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.array(np.full(len(a), v), pa.int64()) for v in (edge, tree, path))]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "edge", "tree", "path"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, path, node = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            if last is None:
                yield out(node[:1], node[:1], 2 * part, tree[0], path[0])
            else:  # the run before this batch stands in front, as its least set
                tree, path, node = (np.concatenate(([v], c)) for v, c in zip(last, (tree, path, node), strict=True))
            starts = np.flatnonzero(np.concatenate(([True], _shared_depth(tree[:-1], path[:-1], tree[1:], path[1:]) < depth)))
            least = np.minimum.reduceat(node, starts)
            hub = np.repeat(least, np.diff(np.append(starts, len(node))))
            yield out(node[node != hub], hub[node != hub], -1, 0, 0)
            last = (tree[-1], path[-1], least[-1])
        if last is not None:
            yield out(np.array([last[2]]), np.array([last[2]]), 2 * part + 1, last[0], last[1])

    common.small_batches(paths.sparkSession, 1 << 16)  # a row is 20 bytes
    ordered = paths.select("tree", "path", "node").repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    found = common.stored(ordered.mapInArrow(run, "a long, b long, edge long, tree long, path long"), "ties")
    common.small_batches(paths.sparkSession)
    ends = found.filter("edge >= 0").orderBy("edge").collect()
    across = [(x["a"], y["a"]) for x, y in zip(ends, ends[1:], strict=False) if x["edge"] % 2 and x["tree"] == y["tree"] and _common_labels(x["path"], y["path"]) >= depth]
    tied = found.filter("edge < 0").select("a", "b").distinct()
    return tied.union(paths.sparkSession.createDataFrame(across, "a long, b long")) if across else tied


def _common_labels(a: int, b: int) -> int:
    one = np.zeros(1, np.int64)
    return int(_shared_depth(one, np.array([a], np.int64), one, np.array([b], np.int64))[0])


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections of the left sets with the right ones (or each other), by 0/1 matrix products."""
    sets = left + (right or [])
    values, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = shared[where]
    owner, column = owner[keep], column[where[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, width = len(left), int(shared.sum())
    out = np.zeros((n, len(sets) - n if right is not None else n), np.float64)
    step = max(64, (16 << 20) // (4 * max(len(sets), 1)))
    for a in range(0, width, step):
        i, j = np.searchsorted(column, (a, a + step))
        dense = np.zeros((len(sets), min(step, width - a)), np.float32)
        dense[owner[i:j], column[i:j] - a] = 1
        out += dense[:n] @ (dense[n:].T if right is not None else dense.T)
    return out


def _linked(left: list[tuple], right: list[tuple] | None, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """Rows (node, links to sets, links to texts, least set in its tree) of a block, or of two."""
    a, b = left, left if right is None else right
    sizes_a, sizes_b = (np.array([len(x[2]) for x in side], float) for side in (a, b))
    common_ = intersections([x[2] for x in a], None if right is None else [x[2] for x in b])
    hit = common_ * (1 + threshold) >= threshold * (sizes_a[:, None] + sizes_b[None, :]) - 1e-9
    if right is None:
        np.fill_diagonal(hit, False)
    weights_a, weights_b = (np.array([x[1] for x in side], np.int64) for side in (a, b))
    ids = [x[0] for x in a] + ([] if right is None else [x[0] for x in b])
    offset = 0 if right is None else len(a)
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.flatnonzero(hit.any(axis=1)):
        for j in np.flatnonzero(hit[i]):
            x, y = find(int(i)), find(int(j) + offset)
            if x != y:
                root[max(x, y, key=ids.__getitem__)] = min(x, y, key=ids.__getitem__)
    rows = [(hit.sum(axis=1), hit @ weights_b)] + ([] if right is None else [(hit.sum(axis=0), weights_a @ hit)])
    links, texts = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    for i in np.flatnonzero(links):
        yield ids[i], int(links[i]), int(texts[i]), ids[find(int(i))]


def _verified(threshold: float):
    names = ["node", "links", "texts", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, group, sides = WordHashes(), None, ({}, {})

        def done() -> list[tuple]:
            left, right = ([(k, *v) for k, v in side.items()] for side in sides)
            if group is None or len(left) + len(right) < 2:
                return []
            return list(_linked(left, right if group[1] != group[2] else None, threshold)) if left and (right or group[1] == group[2]) else []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            rows = []
            columns = [c.to_pylist() for c in batch.columns]
            for whole, i, j, block, one, copies, text in zip(*columns, strict=True):
                if (whole, i, j) != group:
                    rows += done()
                    group, sides = (whole, i, j), ({}, {})
                side = sides[0 if block == i else 1]
                if one not in side:
                    side[one] = (copies, shingle_set(text, hashes))
            if rows:
                yield batch_of(rows)
        if rows := done():
            yield batch_of(rows)

    return run


def _bounded(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text", block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row: doc_id, row_key, class_id, keeper, n_links, n_copies.

    Rows whose sets have a Jaccard similarity of `threshold` or more are linked; class_id is the least doc_id of
    a component of links, keeper the row_key of that row, n_links the number of other rows linked to this one,
    n_copies that of rows with an equal set. A text of fewer than five words is one window; null and empty texts
    have none, are linked to nothing and stand for themselves. Repeated rows are linked to each other. Extra
    columns are ignored, an empty table gives an empty result.
    """
    common.require(docs, key, text)
    depth = shortest(threshold, recall)
    rows = common.stored(signed(docs, key, text), "signatures")
    distinct = rows.filter("set_id is not null").groupBy("set_id").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "row_key")).alias("least"), F.min("row_key").alias("row_key"), F.first("paths").alias("paths"))
    sets = common.stored(distinct.withColumn("node", F.monotonically_increasing_id()), "sets")
    paths = sets.select("node", F.posexplode("paths").alias("tree", "path"))
    groups = components(ties(paths, depth))
    links = common.checkpointed(_links(docs, sets, groups, threshold, depth, key, text, block, broadcast_rows))
    tied = links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"), F.min("root").alias("root"), F.max("root").alias("other"))
    if tied.filter("root <> other").limit(1).count():  # some group took several tasks: its trees are joined
        labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    else:
        labels = tied.select("node", F.col("root").alias("label"))
    joined = (
        sets.join(tied.select("node", "texts"), "node", "left")
        .join(labels, "node", "left")
        .select("set_id", "copies", "least", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("label", "node").alias("label"))
        .filter("copies > 1 or texts > 0")
    )
    joined = common.checkpointed(joined)
    classes = common.checkpointed(joined.groupBy("label").agg(F.min("least").alias("first")))
    known = joined.join(_bounded(classes, broadcast_rows), "label").select("set_id", "copies", "texts", F.col("first.doc_id").alias("class_id"), F.col("first.row_key").alias("keeper"))
    return rows.select("doc_id", "row_key", "set_id").join(_bounded(common.checkpointed(known), broadcast_rows), "set_id", "left").select(
        "doc_id",
        "row_key",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("keeper", "row_key").alias("keeper"),
        F.coalesce(F.col("copies") - 1 + F.col("texts"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"),
    )


def blocked(rows: DataFrame, order: list[str], block: int) -> DataFrame:
    """`rows` with their block: each `block` rows in sequence, sorted by range, whatever the number of partitions.

    A row's place is its place in its partition plus the rows of those before, whose counts are all that the driver gets.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    held = common.stored(ordered, "ordered")
    part = F.call_function("shiftright", F.col("_id"), F.lit(33))
    counts = sorted((r["part"], r["n"]) for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for k, n in counts:
        offsets.append((k, before - (k << 33)))
        before += n
    shifts = rows.sparkSession.createDataFrame(offsets, "part long, shift long")
    return held.join(F.broadcast(shifts), part == F.col("part")).withColumn("block", F.call_function("div", F.col("_id") + F.col("shift"), F.lit(block))).drop("_id", "part", "shift")


def block_pairs(large: DataFrame, depth: int) -> DataFrame:
    """(i, j), i <= j: blocks of `large` (block, paths) of which some node of that depth has sets in both."""
    prefix = F.call_function("shiftright", F.col("path"), F.lit(8 * (MAX_DEPTH - depth)))
    held = large.select("block", F.posexplode("paths").alias("tree", "path")).select("tree", prefix.alias("prefix"), "block").distinct()
    many = held.groupBy("tree", "prefix").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    meet = many.select(F.explode("blocks").alias("i"), "blocks").select("i", F.explode(F.filter("blocks", lambda b: b >= F.col("i"))).alias("j"))
    return meet.distinct()


def _links(docs: DataFrame, sets: DataFrame, groups: DataFrame, threshold: float, depth: int, key: str, text: str, block: int, broadcast_rows: int) -> DataFrame:
    """Verified links of each set: (node, links, texts, root), a row for each task that found some."""
    sized = common.checkpointed(groups.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > block))
    members = common.checkpointed(groups.join(_bounded(sized, broadcast_rows), "label", "left").join(sets.drop("set_id", "least"), "node"))
    small = members.filter("n is null").select(F.lit(True).alias("whole"), F.col("label").alias("i"), F.col("label").alias("j"), F.col("label").alias("block"), "node", "copies", "row_key")
    large = members.filter("n is not null")
    if large.limit(1).count():
        large = blocked(large.withColumn("first", F.col("paths")[0]), ["label", "first", "node"], block)
        pairs = common.checkpointed(block_pairs(large, depth))
        sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        small = small.unionByName(sides.join(large, "block").select(F.lit(False).alias("whole"), "i", "j", "block", "node", "copies", "row_key"))
    texts = docs.select(row_key(docs, key, text).alias("row_key"), F.col(text).alias("text"))
    dealt = texts.join(_bounded(common.checkpointed(small), broadcast_rows), "row_key").select("whole", "i", "j", "block", "node", "copies", "text")
    dealt = dealt.repartition("whole", "i", "j").sortWithinPartitions("whole", "i", "j")
    return dealt.mapInArrow(_verified(threshold), "node long, links long, texts long, root long")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`docs`, columns unchanged, with one row of each class: the one of least doc_id. Texts without words all stay."""
    found = common.checkpointed(similar(docs, threshold, recall, key, text, broadcast_rows=broadcast_rows).select("row_key", "keeper", "n_links"))
    dropped = found.filter("row_key <> keeper").select(F.col("row_key").alias("_k")).distinct()
    again = found.filter("row_key = keeper and n_links > 0").groupBy("row_key").count().filter("count > 1").select(F.col("row_key").alias("_k"))
    left = docs.join(_bounded(dropped, broadcast_rows), row_key(docs, key, text) == F.col("_k"), "left_anti")
    again = common.checkpointed(again)
    if not again.limit(1).count():
        return left
    twice = _bounded(again, broadcast_rows)
    once = left.join(twice, row_key(left, key, text) == F.col("_k"), "left_anti")
    repeated = left.join(twice, row_key(left, key, text) == F.col("_k"))
    return once.unionByName(repeated.dropDuplicates(["_k"]).drop("_k"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links for all documents."""
    return similar(common.read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")
