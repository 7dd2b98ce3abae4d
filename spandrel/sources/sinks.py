"""Writers: CSV and JSON exports, append-only tables, text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays and structs are written as JSON text."""
    flat = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in a folder for each value of `by` where one is named."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to an append-only Parquet table; nothing written before is changed."""
    df.write.mode("append").parquet(path)


def markdown(df: DataFrame, columns: list[str], limit: int = 1000) -> str:
    """A report table as markdown text; `limit` bounds what the driver holds."""
    rows = df.select(*columns).limit(limit).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
