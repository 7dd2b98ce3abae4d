"""Byte-level BPE encoding and decoding.

A text is cut at added tokens, then into words by the pre-tokenizer's pattern. A short word is merged in a
contiguous rank array: the parts between its boundaries lie in one list and the ranks of adjacent parts in
another; the least rank is found by scanning, its boundary is deleted and the two neighbouring ranks are
refreshed. Words over `SHORT_WORD` bytes, where scanning would be quadratic, take a heap over linked parts
with the same order (least rank, then leftmost). Encoded words are cached up to `CACHE_WORDS` in a task.

The vocabulary is a file named by a parameter. The driver reads it and broadcasts its text, about 1 MB
(`MAX_VOCABULARY_BYTES` at most).
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHORT_WORD = 256
CACHE_WORDS = 250_000
MAX_VOCABULARY_BYTES = 64 << 20
#: The pre-tokenizer's pattern, a fixed value of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 60


def byte_characters() -> dict[str, int]:
    """Byte-level BPE writes a byte as a character: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary, from the text of its JSON file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, chars = spec["model"], byte_characters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        as_bytes = lambda token: bytes(chars[c] for c in token)
        vocab = model["vocab"]
        self.token = {i: as_bytes(t) for t, i in vocab.items()}
        self.byte_id = {b: vocab[c] for c, b in chars.items()}
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = n
            self.merged.append(vocab[a + b])
        self.added = {}
        for t in spec.get("added_tokens", []):
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens that take in their surroundings are not supported")
            self.added[t["content"]] = t["id"]
            self.token[t["id"]] = t["content"].encode()
        longest_first = sorted(self.added, key=lambda x: (-len(x), x))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.words = regex.compile(PATTERN)
        self.cache = _Cache(self)

    def word_ids(self, word: bytes) -> list[int]:
        parts = [self.byte_id[b] for b in word]
        return self._short(parts) if len(parts) <= SHORT_WORD else self._long(parts)

    def _short(self, parts: list[int]) -> list[int]:
        rank, merged = self.rank.get, self.merged
        ranks = [rank(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            parts[i : i + 2] = [merged[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], _NONE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        rank, n = self.rank.get, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if parts[i] >= 0 else -1
            if j < 0 or rank(parts[i] << 32 | parts[j], _NONE) != r:
                continue
            parts[i], parts[j], right[i] = self.merged[r], -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (q := rank(parts[a] << 32 | parts[b], _NONE)) != _NONE:
                    heapq.heappush(heap, (q, a))
        return [p for p in parts if p >= 0]

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers; none for a null text."""
        out = []
        for k, piece in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if k % 2:
                out.append(_packed([self.added[piece]]))
            elif piece:
                out.append(b"".join(map(self.cache.__getitem__, self.words.findall(piece))))
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        numbers = array("I")
        numbers.frombytes(ids)
        if _SWAP:
            numbers.byteswap()
        return b"".join(map(self.token.__getitem__, numbers)).decode("utf-8", "replace")


_SWAP = array("I", [1]).tobytes()[0] != 1


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if _SWAP:
        out.byteswap()
    return out.tobytes()


class _Cache(dict):
    """Packed ids by word; long words are not kept."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        out = _packed(self.codec.word_ids(word.encode()))
        if len(word) <= 64:
            self[word] = out
        return out


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))



def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """`docs` with token_ids (binary, little-endian unsigned 32-bit) and decoded_text for every row.

    A null or empty text has no tokens and decodes to an empty text. Texts are encoded whole, rows are
    neither merged nor split, and columns of these two names are replaced.
    """
    common.require(docs, text)
    source = Path(vocabulary).read_text(encoding="utf-8")
    if len(source) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary is larger than {MAX_VOCABULARY_BYTES} bytes and cannot be broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(source)
    common.small_batches(docs.sparkSession)
    docs = docs.drop("token_ids", "decoded_text")
    at = docs.columns.index(text)
    names = [*docs.columns, "token_ids", "decoded_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column(at).to_pylist()]
            back = [codec.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(back, pa.string())], names)

    added = [T.StructField("token_ids", T.BinaryType()), T.StructField("decoded_text", T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text for all documents."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, vocabulary_path()).select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"),
    )
