"""Change requests as a stream: state for each table, member and scenario, and one micro-batch written to four tables.

State is the last assignment and the open review items of a key. A micro-batch writes each table to a folder named by its batch id,
and overwrites it: a run that ends between two tables repeats the batch from the same state and writes the same rows, so all
tables agree however often it was killed. Needs the RocksDB state store (`STATE_STORE`).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import changes

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = "supersedes_id string, before string, closes string"
_OUT = f"{changes.REQUEST}, {_STATE}"


class LastRows(StatefulProcessor):
    """For each request: the assignment it supersedes, and the review items that it closes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "id string, shown string, opened string, seen string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, shown, opened, seen = self.state.get() if self.state.exists() else (None, None, "[]", "[]")
        opened, seen = json.loads(opened), set(json.loads(seen))
        asked = pd.concat(list(rows)).sort_values(["created_at", "request_id"])
        asked_for = [c.split()[0] for c in changes.REQUEST.split(", ")]
        out = []
        for r in asked.itertuples():
            if r.request_id in seen:
                continue
            seen.add(r.request_id)
            closes = sorted(opened) if r.chosen else []
            out.append((*(getattr(r, c) for c in asked_for), last, shown, json.dumps(closes)))
            opened = [] if r.chosen else opened + [r.item_id] * (not r.settled)
            last, shown = r.id, r.shown
        self.state.update((last, shown, json.dumps(opened), json.dumps(sorted(seen))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def followed(requests: DataFrame) -> DataFrame:
    """The requests of a stream with what state adds to each."""
    names = [c.split()[0] for c in changes.REQUEST.split(", ")]
    both = requests.select(*names, F.struct(*[F.col(c) for c in names]).alias("asked"))
    rows = changes.prepared(both).select(*[F.col(f"asked.{c}").alias(c) for c in names], "id", "shown", "item_id", "settled", "chosen")
    return rows.groupBy(*changes.KEY).transformWithStateInPandas(LastRows(), _OUT, "append", "none")


def rows_of(batch: DataFrame) -> DataFrame:
    """The rows that the requests of a micro-batch append, as `changes.rows_for` gives them."""
    closes = F.from_json("closes", "array<string>")
    return changes.appended(changes.prepared(batch).withColumn("opened", closes))


def write_batches(requests: DataFrame, path: str, checkpoint: str, between: Callable[[str, int], None] | None = None) -> StreamingQuery:
    """Works off what is there and stops. `between` is called after each table is written, with its name and the batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = rows_of(batch).persist()
        try:
            for name, table in changes.tables_of(rows).items():
                table.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
                if between:
                    between(name, batch_id)
        finally:
            rows.unpersist()

    query = followed(requests).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def written(spark: SparkSession, path: str, table: str) -> DataFrame:
    """All rows of a table, whatever batch wrote them."""
    return spark.read.parquet(f"{path}/{table}").drop("batch")
