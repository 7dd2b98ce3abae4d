"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through region and rack to a shard. At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the key, the level and the child, and the least draw wins. A
child's chance is its share of the weight, and its draw depends on nothing but itself: when a weight
changes, rows move into or out of the changed child only, so movement stays in subtrees whose weights
change. `Topology.grown` adds a shard in a region and rack of its own; then the one subtree that changes
is the new shard itself and it takes rows only into itself (law ``key``).

The draws are built-in column functions inside the scan's stage; only narrow rows are shuffled, to number
the rows of each shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows that one numbering chunk holds at most.
CHUNK_ROWS = 4096


@dataclass(frozen=True)
class Topology:
    """Shard weights by place: ``{(region, rack, shard): weight}``; a weight of 0 takes no rows."""

    weights: dict[tuple[int, int, int], float]

    @staticmethod
    def balanced(shards: int, per_rack: int = 2, racks: int = 2) -> "Topology":
        """Equal weights; shards fill racks and racks fill regions in order."""
        return Topology({(s // (per_rack * racks), s // per_rack % racks, s): 1.0 for s in range(shards)})

    def shards(self) -> list[int]:
        return sorted(s for _, _, s in self.weights)

    def grown(self, weight: float = 1.0) -> "Topology":
        """With one more shard, in a new region and rack, so that no other subtree's weight changes."""
        region = max((r for r, _, _ in self.weights), default=-1) + 1
        return Topology({**self.weights, (region, 0, max(self.shards(), default=-1) + 1): weight})

    def children(self, *path: int) -> dict[int, float]:
        """Weights of a node's children: the sums over the shards below them."""
        out: dict[int, float] = {}
        for place, w in self.weights.items():
            if place[: len(path)] == path and w > 0:
                out[place[len(path)]] = out.get(place[len(path)], 0.0) + w
        return out


def _draw(key: Column, path: tuple[int, ...], weight: float) -> Column:
    h = F.xxhash64(key, F.lit("/".join(map(str, path))))
    u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(float(weight))


def _winner(key: Column, path: tuple[int, ...], weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct(_draw(key, (*path, c), w).alias("d"), F.lit(c).alias("c")) for c, w in sorted(weights.items())]
    return F.least(*draws)["c"]


def shard_of(key: Column, tree: Topology, path: tuple[int, ...] = ()) -> Column:
    """The shard that `key` descends to. A null key is a key of its own."""
    key = F.coalesce(key.cast("string"), F.lit("\0null")) if not path else key
    weights = tree.children(*path)
    if not weights:
        raise ValueError("the topology has no shard of positive weight")
    chosen = _winner(key, path, weights)
    if len(path) == 2:
        return chosen
    out = None
    for child in sorted(weights):
        below = shard_of(key, tree, (*path, child))
        out = F.when(chosen == child, below) if out is None else out.when(chosen == child, below)
    return out


def place(docs: DataFrame, tree: Topology, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, size, text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes: size 1, checksum of nothing (0). Rows with equal keys share a shard. Extra
    columns are ignored, an empty table gives an empty result. Slots count from 0 without gaps in the
    order of the input's partitions; rows are numbered in chunks of `CHUNK_ROWS`, so no task holds a shard.
    """
    common.require(docs, key, text)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), tree).cast("int").alias("shard"),
        shard_of(F.col(key), tree.grown()).cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("at"),
    )
    rows = common.checkpointed(rows).withColumn("chunk", F.floor(F.col("at") / CHUNK_ROWS))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    return _numbered(rows, counts).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _numbered(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """`slot` from the rank in a chunk and the rows of the shard's earlier chunks.

    Chunk counts are 1/4096 of the rows; their running sum is taken by blocks of chunks, in two steps.
    """
    block = F.floor(F.col("chunk") / 1024)
    inner = Window.partitionBy("shard", "block").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("block", block)
    blocks = counts.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("shard", "block", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    starts = (
        counts.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0)))
        .join(blocks, ["shard", "block"])
        .select("shard", "chunk", (F.col("before") + F.col("within")).alias("start"))
    )
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("at"))
    return rows.withColumn("rank", rank).join(starts, ["shard", "chunk"]).withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, by the law ``key``."""
    return place(common.read_table(spark, sf_dir, "documents"), Topology.balanced(8))
