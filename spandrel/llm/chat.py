"""Chat formatting by columnar byte assembly.

Turns are sorted by conversation and turn over range partitions, so a long conversation spreads over several
tasks. In each Arrow batch numpy works out segment lengths, their cumulative offsets and the scatter indices,
and copies headers, texts and trailers into one preallocated buffer that becomes the Arrow output column.
Pieces of a conversation from different batches or tasks are joined in order by a second, much smaller pass.

Each turn reads ``<s>[INST] text [/INST]`` (user), ``<s>[SYS] text [/SYS]`` (system), ``<s>[ASST] text
[/ASST]</s>`` (assistant) or ``<s>[ROLE] role [TEXT] text [/ROLE]`` (any other role). Inside texts and roles a
backslash is doubled and a backslash is put before every control string; `parse` undoes both.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

OPEN = {"user": "<s>[INST] ", "system": "<s>[SYS] ", "assistant": "<s>[ASST] "}
CLOSE = {"user": " [/INST]", "system": " [/SYS]", "assistant": " [/ASST]</s>"}
OTHER_OPEN, OTHER_TEXT, OTHER_CLOSE = "<s>[ROLE] ", " [TEXT] ", " [/ROLE]"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ASST]", "[/ASST]", "[ROLE]", "[/ROLE]", "[TEXT]")
_CONTROL = "|".join(map(re.escape, CONTROLS))
_TO_ESCAPE = re.compile(rf"\\|{_CONTROL}")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_MARK = re.compile(rf"\\.|({_CONTROL})", re.DOTALL)
PIECE_SCHEMA = "conv_id long, task int, seq long, formatted string, n_turns long, loss_start array<long>, loss_end array<long>"


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _escaped(column: pa.Array) -> pa.Array:
    """Texts with nulls as empty and control strings escaped; only rows that hold one leave Arrow."""
    column = pc.fill_null(column, "")
    odd = pc.match_substring_regex(column, rf"\\|{_CONTROL}")
    if not pc.any(odd).as_py():
        return column
    return pc.replace_with_mask(column, odd, pa.array([escape(x) for x in column.filter(odd).to_pylist()], column.type))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts (one more than rows) and bytes of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data else np.empty(0, np.uint8)
    return starts - starts[0], raw


def _scatter(out: np.ndarray, at: np.ndarray, starts: np.ndarray, raw: np.ndarray) -> None:
    """Copies row i of `raw` to out[at[i]:]; one index for each byte."""
    lengths = np.diff(starts)
    out[np.arange(len(raw)) + np.repeat(at - starts[:-1], lengths)] = raw


def _repeated(parts: list[str], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen part of each row, as starts and bytes."""
    starts, raw = _bytes_of(pa.array(parts, pa.string()))
    lengths = np.diff(starts)[which]
    to = np.concatenate(([0], np.cumsum(lengths)))
    return to, raw[np.arange(to[-1]) + np.repeat(starts[:-1][which] - to[:-1], lengths)]


def assemble(role: pa.Array, text: pa.Array, breaks: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Formats turns into one buffer; `breaks` holds the first row of each conversation, then the row count.

    Returns the formatted conversations, and for each turn its loss span (bytes within the conversation) and
    whether it counts for the loss.
    """
    role = pc.fill_null(role, "")
    known = list(OPEN)
    kind = pc.fill_null(pc.index_in(role, pa.array(known, role.type)), len(known)).to_numpy(zero_copy_only=False)
    body_at, body = _bytes_of(_escaped(text))
    if (kind == len(known)).any():
        heads = [OPEN.get(r, OTHER_OPEN + escape(r) + OTHER_TEXT) for r in role.to_pylist()]
        head_at, head = _bytes_of(pa.array(heads, pa.string()))
    else:
        head_at, head = _repeated(list(OPEN.values()), kind)
    tail_at, tail = _repeated([*CLOSE.values(), OTHER_CLOSE], kind)
    lengths = np.diff(head_at) + np.diff(body_at) + np.diff(tail_at)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    text_at = begins + np.diff(head_at)
    tail_begin = text_at + np.diff(body_at)
    _scatter(out, begins, head_at, head)
    _scatter(out, text_at, body_at, body)
    _scatter(out, tail_begin, tail_at, tail)
    edges = np.concatenate((begins, [len(out)]))[breaks]
    formatted = pa.Array.from_buffers(pa.large_string(), len(breaks) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out)])
    base = np.repeat(edges[:-1], np.diff(breaks))
    return formatted.cast(pa.string()), text_at - base, tail_begin - base, kind == known.index("assistant")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(0)
        code = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        breaks = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1, [n]))
        formatted, start, end, loss = assemble(batch.column(2), batch.column(3), breaks)
        taken = np.concatenate(([0], np.cumsum(loss)))[breaks].astype(np.int32)
        spans = [pa.ListArray.from_arrays(pa.array(taken), pa.array(x[loss].astype(np.int64))) for x in (start, end)]
        k = len(breaks) - 1
        yield pa.RecordBatch.from_arrays(
            [conv.take(pa.array(breaks[:-1])), pa.array([task] * k, pa.int32()), pa.array(range(seq, seq + k), pa.int64()), formatted, pa.array(np.diff(breaks).astype(np.int64)), *spans],
            [c.strip().split(" ")[0] for c in PIECE_SCHEMA.split(",")],
        )
        seq += k


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins consecutive pieces of a conversation; a piece is held until the next conversation begins."""
    held: list[dict] = []
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if held and held[-1]["conv_id"] != row["conv_id"]:
                done.append(_whole(held))
                held = []
            held.append(row)
        if done:
            yield pa.RecordBatch.from_pylist(done, _OUT)
    if held:
        yield pa.RecordBatch.from_pylist([_whole(held)], _OUT)


def _whole(pieces: list[dict]) -> dict:
    at, start, end = 0, [], []
    for p in pieces:
        start += [x + at for x in p["loss_start"]]
        end += [x + at for x in p["loss_end"]]
        at += len(p["formatted"].encode()) if len(pieces) > 1 else 0
    return {"conv_id": pieces[0]["conv_id"], "formatted": "".join(p["formatted"] for p in pieces), "n_turns": sum(p["n_turns"] for p in pieces), "loss_start": start, "loss_end": end}


_OUT = pa.schema({"conv_id": pa.int64(), "formatted": pa.string(), "n_turns": pa.int64(), "loss_start": pa.list_(pa.int64()), "loss_end": pa.list_(pa.int64())})
OUT_SCHEMA = "conv_id long, formatted string, n_turns long, loss_start array<long>, loss_end array<long>"


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: formatted, n_turns, and the loss mask as byte spans of assistant texts.

    Turns go by turn, ties by role and then text; a null turn comes first. A null text or role is empty, a
    null conv_id is a conversation of its own, repeated rows are turns of their own. Extra columns are
    ignored, an empty table gives an empty result.
    """
    common.require(turns, "conv_id", "turn", "role", "text")
    common.small_batches(turns.sparkSession, 4096)
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    pieces = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, PIECE_SCHEMA)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq").mapInArrow(_joined, OUT_SCHEMA)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn, read from the formatted text alone."""
    opened = {v.split("]")[0][3:] + "]": k for k, v in OPEN.items()}
    role, at, head = "", 0, False
    for m in _MARK.finditer(formatted):
        mark = m[1]
        if mark is None or mark in ("<s>", "</s>"):
            continue
        if mark in opened:
            role, at = opened[mark], m.end() + 1
        elif mark == "[ROLE]":
            at = m.end() + 1
        elif mark == "[TEXT]":
            role, at = unescape(formatted[at : m.start() - 1]), m.end() + 1
        else:
            yield role, unescape(formatted[at : m.start() - 1])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, text in parse(row["formatted"]):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            raw = row["formatted"].encode()
            for a, b in zip(row["loss_start"], row["loss_end"], strict=True):
                text = unescape(raw[a:b].decode())
                loss.update(text.encode())
                chars += len(text)
            out.append({"conv_id": row["conv_id"], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": len(row["formatted"])})
        if out:
            yield pa.RecordBatch.from_pylist(out, _DIGESTS)


_DIGESTS = pa.schema({"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()})


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -7, read back from the formatted text."""
    turns = common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], T.StructType.fromDDL("conv_id long, turn long, role string, text string"))
    return format_chats(turns.unionByName(extra)).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
