"""Language-model scoring by online logistic context mixing.

A text is its words, each spelled in bytes and closed by a space, then an end mark; letters A-Z are lower-cased.
Every byte is predicted bit by bit. Predictors are tables of counts under hashed contexts (the last 0 to 4 bytes
of the word so far, and the whole word so far), each with the bits already known of the byte. Their stretched
probabilities are combined by weights that a gate chooses (the longest context known, and the bit), learned
online; an adaptive probability map then refines the mixture. The bits' code lengths add up to the text's.

These contexts stay inside a word, so each distinct word is spelled once. Above the words stands a context across
them: a text is cut into phrases after every word whose hash ends in `ANCHOR_BITS` zeros and at its end, and the counts
of all training phrases, kept by 64-bit hash in a table that grows with the corpus, predict the next phrase beside
its spelling. A gate (the text's begin, or whether the phrase before was known, and long) chooses the weight of
the two, learned on the training texts. A training text's own phrases are never evidence for it.
The stages, all sized by the corpus:

1. words with their counts (training and all), summed by a shuffle;
2. predictor tables from all training words, sorted so that alike beginnings are worked once, built in a few tasks and added up by blocks of slots;
3. mixing weights and the map, online over all training tokens, in streams of about `STREAM` distinct words whose
   results are averaged; a coded bit is never evidence for itself: its own count is left out of the tables;
4. the cost of every distinct word; words over a count that at most `FREQUENT` words reach are broadcast;
5. texts as phrases: sums over frequent words in place, the rest by a join on the word;
6. phrases counted and joined with the texts by hash, hot ones (each over 1/`HOT` of all) by a broadcast;
7. the gate's weights, then the mixture of both costs, phrase by phrase.

Broadcast are the tables (fixed size, `TABLE_BITS`), the frequent words (at most `FREQUENT`) and the hot phrases (at
most `HOT`).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of context of each predictor (-1: the whole word so far) and the bits of its table's size.
ORDERS = (0, 1, 2, 3, 4, -1)
TABLE_BITS = (10, 16, 20, 22, 22, 22)
BLOCK_BITS = 14
#: Weights and map learn from all training tokens, in steps of `MIX_SHARE` of a stream each, and of `MIX_TOKENS` tokens at least;
#: distinct words of one such stream, about; parts of a step that one piece of a word weighs at most, unless it is in every step.
MIX_TOKENS, MIX_SHARE, STREAM, PIECE = 256, 1 / 128, 250_000, 16
#: Counts of slots are kept exactly up to this; one more or less of it changes no chance that is told apart.
MOST_COUNT = 65_535
#: Distinct words that one table task takes; frequent words at most.
WORDS_A_TASK, FREQUENT = 600_000, 200_000
#: Distinct words that a counting task holds before it hands them on; words worked at a time.
HELD_WORDS, CHUNK = 200_000, 32_768
SPACE, END, SCALE, UNKNOWN = 0x20, 0x09, 2500.0, -32768
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
GATES, BUCKETS = (len(ORDERS) + 1) * 8, 33
#: Zero bits of an anchor word's hash (a phrase is 32 words on average); words of a long phrase; hot phrases at most.
ANCHOR_BITS, LONG_PHRASE, HOT = 5, 8, 10_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Spelling:
    """A batch of words as bytes by position; steps over bytes and bits and gives each predictor's slots."""

    def __init__(self, words: list[bytes]):
        spelled = [w + b" " if w else b"\t" for w in words]  # no word: the end mark
        self.lengths = np.array([len(w) for w in spelled])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def steps(self) -> Iterator[tuple[np.ndarray, list[np.ndarray], int, np.ndarray, np.ndarray]]:
        """(rows, slots by predictor, bit index, node, bit) for each byte position and bit."""
        for rows, _, slots, bit, node, b in self.shared_steps(False):
            yield rows, slots, bit, node, b

    def shared_steps(self, shared: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], int, np.ndarray, np.ndarray]]:
        """As `steps`, with the rows at a position, and where among them each run of words that are alike up to there begins.

        Slots, nodes and bits are given once for a run; words in order have the longest runs.
        """
        rows = np.arange(len(self.lengths))
        history = np.zeros((len(rows), 4), np.uint64)
        prefix = np.full(len(rows), 7, np.uint64)
        alike = np.arange(len(rows)) > 0  # up to here, with the row before
        position = 0
        while len(rows := rows[self.lengths[rows] > position]):
            all_bytes = self.flat[self.starts[rows] + position].astype(np.uint64)
            if shared:
                same = np.concatenate(([False], (np.diff(rows) == 1) & (all_bytes[1:] == all_bytes[:-1])))
                alike[rows] &= same
                begins = np.flatnonzero(~alike[rows])
            else:
                begins = np.arange(len(rows))
            byte, past, whole = all_bytes[begins], history[rows[begins]], prefix[rows[begins]]
            contexts, h = [], np.full(len(begins), 1, np.uint64)
            for k in range(5):
                contexts.append(_mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
                if k < 4:
                    h = _mix(h * np.uint64(0x2545F4914F6CDD1D) + past[:, k] + np.uint64(1))
            contexts.append(whole)
            node = np.ones(len(begins), np.uint64)
            for bit in range(8):
                b = (byte >> np.uint64(7 - bit)) & np.uint64(1)
                slots = [
                    (node if n == 0 else ((c ^ (node * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - size)).astype(np.int64)
                    for n, c, size in zip(ORDERS, contexts, TABLE_BITS, strict=True)
                ]
                yield rows, begins, slots, bit, node.astype(np.int64), b.astype(np.int64)
                node = node * np.uint64(2) + b
            history[rows, 1:] = history[rows, :3]
            history[rows, 0] = all_bytes + np.uint64(1)
            prefix[rows] = _mix(prefix[rows] * np.uint64(0x2545F4914F6CDD1D) + all_bytes + np.uint64(1))
            position += 1


@dataclass
class Occurrences:
    """Distinct words of one online step, in order, and the share of it that each weighs."""

    words: list[bytes]
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.words)


@dataclass
class Model:
    """Quantized predictor tables, gated weights, and the refining map; where it learns from the tables' own words, their slots' counts."""

    tables: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray
    counts: list[np.ndarray] | None = None

    @staticmethod
    def blank(tables: list[np.ndarray], counts: list[np.ndarray] | None = None) -> "Model":
        weights = np.full((GATES, len(ORDERS) + 1), 0.3)
        weights[:, -1] = 0
        centres = 1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS)))
        return Model(tables, weights, np.repeat(centres[None, :], 256, axis=0), counts)

    def inputs(self, slots: list[np.ndarray], bit: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions (0 where a context is unknown), a constant, and the gate; without one count of the bits `own`, where given."""
        raw = np.stack([t[s] for t, s in zip(self.tables, slots, strict=True)], axis=1)
        known = raw != UNKNOWN
        stretched = np.where(known, raw, 0) / SCALE
        if own is not None and self.counts is not None:
            n = np.stack([c[s] for c, s in zip(self.counts, slots, strict=True)], axis=1).astype(float)
            odds = np.exp(stretched)
            ones = np.rint((odds * (n + 0.1) - 0.1) / (1 + odds)) - own[:, None]
            n -= 1
            known &= n > 0
            ones = np.clip(ones, 0, np.maximum(n, 0))
            stretched = np.where(known, np.clip(np.log((ones + 0.1) / (np.maximum(n, 0) - ones + 0.1)), -12, 12), 0)
        x = np.concatenate((stretched, np.ones((len(raw), 1))), axis=1)
        longest = np.where(known.any(axis=1), known.shape[1] - np.argmax(known[:, ::-1], axis=1), 0)
        return x, longest * 8 + bit

    def predict(self, x: np.ndarray, gate: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chance of a 1: mixed and refined; with the map's lower bucket and its share."""
        dot = np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -12, 12)
        mixed = 1 / (1 + np.exp(-dot))
        at = (np.clip(dot, -7.999, 7.999) + 8) * ((BUCKETS - 1) / 16)
        low = at.astype(np.int64)
        share = at - low
        map_p = self.refined[node, low] * (1 - share) + self.refined[node, low + 1] * share
        return mixed, np.clip(0.5 * (mixed + map_p), 1e-6, 1 - 1e-6), low, share

    def learn(self, words: list[bytes] | Occurrences, rate: float) -> None:
        """One online step over some words: weights along the coding error's gradient, the map towards the bits."""
        if not isinstance(words, Occurrences):
            words = Occurrences(words, np.ones(len(words)))
        refined = self.refined.reshape(-1)
        for rows, begins, slots, bit, node, b in Spelling(words.words).shared_steps():
            if bit == 0:
                weight = np.add.reduceat(words.weights[rows], begins)
            x, gate = self.inputs(slots, bit, b)
            mixed, _, low, share = self.predict(x, gate, node)
            error = rate * weight * (b - mixed)
            for k in range(x.shape[1]):
                self.weights[:, k] += np.bincount(gate, error * x[:, k], GATES)
            for bucket, part in ((low, 1 - share), (low + 1, share)):
                at = node * BUCKETS + bucket
                refined += np.bincount(at, 0.02 * weight * part * (b - refined.take(at)), len(refined))
        np.clip(self.refined, 1e-5, 1 - 1e-5, out=self.refined)

    def chances(self, slots: list[np.ndarray], bit: int, node: np.ndarray) -> np.ndarray:
        """The refined chance of a 1, as `inputs` and `predict` give it, without their intermediate tables."""
        longest, raw = np.zeros(len(node), np.int64), []
        for k, (table, s) in enumerate(zip(self.tables, slots, strict=True)):
            r = table.take(s)
            known = r != UNKNOWN
            longest[known] = k + 1
            raw.append(np.where(known, r, 0))
        gate = longest * 8 + bit
        dot = self.weights[:, -1].take(gate)
        for k, r in enumerate(raw):
            dot += (self.weights[:, k] / SCALE).take(gate) * r
        np.clip(dot, -12, 12, out=dot)
        at = (np.clip(dot, -7.999, 7.999) + 8) * ((BUCKETS - 1) / 16)
        low = at.astype(np.int64)
        at -= low
        low += node * BUCKETS
        refined = self.refined.reshape(-1)
        map_p = refined.take(low) * (1 - at) + refined.take(low + 1) * at
        return np.clip(0.5 * (1 / (1 + np.exp(-dot)) + map_p), 1e-6, 1 - 1e-6)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability; the empty word is the end of a text."""
        out = np.zeros(len(words))
        for a in range(0, len(words), CHUNK):
            part = np.zeros(len(words[a : a + CHUNK]))
            for rows, begins, slots, bit, node, b in Spelling(words[a : a + CHUNK]).shared_steps():
                p = self.chances(slots, bit, node)
                part[rows] += np.repeat(np.log10(np.where(b == 1, p, 1 - p)), np.diff(np.append(begins, len(rows))))
            out[a : a + CHUNK] = part
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, n): training and all occurrences of each word of `docs` (held, text); the empty word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()

        def hand_on() -> pa.RecordBatch:
            words = [*train, *(w for w in other if w not in train)]
            c = np.fromiter((train[w] for w in words), np.int64, len(words))
            n = c + np.fromiter((other[w] for w in words), np.int64, len(words))
            train.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(n)], ["word", "c", "n"])

        for batch in batches:
            for held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen = other if held else train
                seen.update(words_of(text))
                seen[b""] += 1
                if len(train) + len(other) > HELD_WORDS:
                    yield hand_on()
        yield hand_on()

    counted = docs.select("held", "text").mapInArrow(run, "word binary, c long, n long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _table_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of zeros and ones by slot of this task's words, side by side, in blocks of slots."""
    counts = [np.zeros(2 << size, np.int64) for size in TABLE_BITS]
    some = False
    for batch in batches:
        words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        for a in range(0, len(words), CHUNK):
            some = True
            weight = c[a : a + CHUNK]
            for rows, begins, slots, bit, _, b in Spelling(words[a : a + CHUNK]).shared_steps():
                if bit == 0:
                    w = np.add.reduceat(weight[rows], begins)
                for table, s in zip(counts, slots, strict=True):
                    np.add.at(table, 2 * s + b, w)
    for k, table in enumerate(counts if some else []):
        width = 2 * min(1 << BLOCK_BITS, len(table) // 2)
        for block in range(len(table) // width):
            part = table[block * width : (block + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], ["predictor", "block", "counts"])


def _quantized(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    stretch = np.clip(np.log((ones + 0.1) / (zeros + 0.1)), -12, 12) * SCALE
    return np.where(zeros + ones > 0, np.rint(stretch), UNKNOWN).astype("<i2")


def _summed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up sorted blocks: the quantized stretched chance of each slot, and its count."""
    at, total = None, None

    def done() -> pa.RecordBatch:
        zeros, ones = total.reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([_quantized(zeros, ones).tobytes()], pa.binary()), pa.array([np.minimum(zeros + ones, MOST_COUNT).astype("<u2").tobytes()], pa.binary())], ["predictor", "block", "stretch", "n"])

    for batch in batches:
        for k, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k, block) != at:
                if at is not None:
                    yield done()
                at, total = (k, block), np.zeros(len(raw) // 8, np.int64)
            total += np.frombuffer(raw, "<i8")
    if at is not None:
        yield done()


def mix_share(tokens: int) -> float:
    """The share of the training tokens that weights and map learn from: all, whatever their number."""
    return 1.0


def train(words: DataFrame, tokens: int, types: int) -> Model:
    """Tables over all training words; weights and map online over all of them too."""
    taught = words.filter("c > 0").select("word", "c")
    tasks = max(1, math.ceil(types / WORDS_A_TASK))
    partial = taught.coalesce(tasks).sortWithinPartitions("word").mapInArrow(_table_blocks, "predictor int, block int, counts binary")
    summed = partial.repartition("predictor", "block").sortWithinPartitions("predictor", "block").mapInArrow(_summed_blocks, "predictor int, block int, stretch binary, n binary")
    tables = [np.full(1 << size, UNKNOWN, "<i2") for size in TABLE_BITS]
    counts = [np.zeros(1 << size, "<u2") for size in TABLE_BITS]
    for row in summed.toLocalIterator():
        for table, part in ((tables, np.frombuffer(row["stretch"], "<i2")), (counts, np.frombuffer(row["n"], "<u2"))):
            table[row["predictor"]][row["block"] * len(part) : (row["block"] + 1) * len(part)] = part
    return mixed(taught, tokens, tables, counts, max(1, math.ceil(types / STREAM)))


def dealt(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, word, weight): a stream's words (`c` tokens of each) in pieces, dealt to online steps of about equal weight, 256 on average.

    A word is cut into pieces of at most 1/`PIECE` of a step, at even distances, so a frequent word is learned all along the
    stream as its tokens would be; the pieces of a word weigh what its tokens do.
    """
    steps = max(1, min(round(1 / MIX_SHARE), int(c.sum() // MIX_TOKENS)))
    pieces = np.clip(np.ceil(c * (PIECE * steps / c.sum())), 1, steps).astype(np.int64)
    word = np.repeat(np.arange(len(c)), pieces)
    place = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    step = (word * steps // len(c) + place * steps // pieces[word]) % steps
    order = np.argsort(step, kind="stable")
    return step[order], word[order], (c * (256 * steps / c.sum()) / pieces)[word[order]]


def mixed(words: DataFrame, tokens: int, tables: list[np.ndarray], counts: list[np.ndarray], streams: int) -> Model:
    """A model of these tables whose weights and map are learned from all of `words` (word, c tokens).

    Words are dealt to `streams` streams by a hash, those with more tokens than a stream has to all of them in equal parts; each
    stream is learned online, and the results are averaged by their tokens.
    """
    shared = words.sparkSession.sparkContext.broadcast((tables, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, weighed = [], []
        for batch in batches:
            listed += batch.column(0).to_pylist()
            weighed.append(batch.column(1).to_numpy(zero_copy_only=False))
        if not listed:
            return
        c, model = np.concatenate(weighed), Model.blank(*shared.value)
        rank = np.empty(len(listed), np.int64)
        rank[sorted(range(len(listed)), key=listed.__getitem__)] = np.arange(len(listed))
        step, word, weight = dealt(c)
        ends = np.append(np.flatnonzero(np.diff(step)) + 1, len(step))
        for begin, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            at = begin + np.argsort(rank[word[begin:end]], kind="stable")
            model.learn(Occurrences([listed[i] for i in word[at]], weight[at]), 0.02 / (1 + step[begin] / 32) / 16)
        yield pa.RecordBatch.from_arrays([pa.array([c.sum()], pa.float64()), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.refined.tobytes()], pa.binary())], ["seen", "weights", "refined"])

    often = F.col("c") * streams > tokens
    all_streams = F.sequence(F.lit(0), F.lit(streams - 1))
    one = F.array(F.pmod(F.xxhash64("word"), F.lit(streams)).cast("int"))
    each = words.select("word", (F.col("c") / F.when(often, F.lit(streams)).otherwise(1)).cast("double").alias("c"), F.explode(F.when(often, all_streams).otherwise(one)).alias("stream"))
    streamed = each.repartition(streams, "stream").sortWithinPartitions(F.xxhash64("word", F.lit(1)), "word").select("word", "c")
    model, total = Model.blank(tables), 0.0
    weights, refined = np.zeros_like(model.weights), np.zeros_like(model.refined)
    for r in streamed.mapInArrow(run, "seen double, weights binary, refined binary").collect():
        total += r["seen"]
        weights += r["seen"] * np.frombuffer(r["weights"]).reshape(weights.shape)
        refined += r["seen"] * np.frombuffer(r["refined"]).reshape(refined.shape)
    if total:
        model.weights, model.refined = weights / total, refined / total
    return model


def _threshold(words: DataFrame, most: int) -> int:
    """The least count that at most `most` words reach."""
    bins = words.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("bin")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect()
    total, out = 0, 1 << 62
    for row in sorted(bins, key=lambda r: -r["bin"]):
        total += row["k"]
        if total > most:
            break
        out = row["n"]
    return out


@dataclass
class Phrases:
    """The words of a batch of texts cut into phrases: first token of each text, token and text of each phrase, hashes."""

    firsts: np.ndarray
    starts: np.ndarray
    text: np.ndarray
    hashes: np.ndarray

    @staticmethod
    def of(words: list[bytes], firsts: np.ndarray) -> "Phrases":
        """Every text must close with the end mark, whose hash is an anchor."""
        crc = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        ends = np.flatnonzero(crc & np.uint64((1 << ANCHOR_BITS) - 1) == 0) + 1
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        place = np.arange(len(words)) - np.repeat(starts, ends - starts)
        # 64 bits of each word: words of equal crc32 are different phrases
        name = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        mixed = _mix(_mix((name + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))
        return Phrases(firsts, starts, np.searchsorted(firsts, starts, "right") - 1, np.add.reduceat(mixed, starts).view(np.int64))

    def own(self) -> np.ndarray:
        """How often each phrase stands in its text."""
        order = np.lexsort((self.hashes, self.text))
        h, t = self.hashes[order], self.text[order]
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])))
        out = np.empty(len(order), np.int32)
        out[order] = np.repeat(np.diff(np.append(np.flatnonzero(fresh), len(order))), np.diff(np.append(np.flatnonzero(fresh), len(order))))
        return out


def phrase_hits(texts: DataFrame) -> tuple[DataFrame, int]:
    """(row, hits as pos and c) of `texts` (row, held, phrases, own), and the count of training phrases.

    c counts a phrase in all training texts but its own, where it is not 0. A phrase with more than 1/`HOT` of all is
    joined by a broadcast, so that no key of the shuffled join is large.
    """
    each = texts.select("row", "held", F.posexplode(F.arrays_zip("phrases", "own")).alias("pos", "p")).select("row", "held", "pos", F.col("p.phrases").alias("phrase"), F.col("p.own").alias("own"))
    total = texts.agg(F.sum(F.size("phrases")).alias("m"), F.sum(F.when(~F.col("held"), F.size("phrases"))).alias("n")).first()
    counted = common.stored(each.groupBy("phrase").agg(F.count_if(~F.col("held")).alias("n"), F.count("*").alias("m")).filter("n > 0 and m > 1"), "phrases")
    hot = F.col("m") * HOT > F.lit(total["m"] or 0)
    first = each.join(F.broadcast(counted.filter(hot).select("phrase", F.col("n").alias("hot_n"))), "phrase", "left")
    by_hot = first.filter("hot_n is not null").select("row", "held", "pos", "own", F.col("hot_n").alias("n"))
    by_key = first.filter("hot_n is null").join(counted.filter(~hot).select("phrase", "n"), "phrase").select("row", "held", "pos", "own", "n")
    c = F.col("n") - F.when(F.col("held"), 0).otherwise(F.col("own"))
    hits = by_hot.unionByName(by_key).select("row", F.struct("pos", c.cast("double").alias("c")).alias("hit")).filter("hit.c > 0")
    return hits.groupBy(F.col("row").alias("hit_row")).agg(F.collect_list("hit").alias("hits")), total["n"] or 0


def _phrase_costs(batch: pa.RecordBatch, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, gate, log10 by spelling and log10 by count (-inf where unknown) of each phrase of a batch."""
    sums, lengths = batch["sums"], batch["lengths"]
    sizes = pc.list_value_length(sums).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    spelled = sums.flatten().to_numpy(zero_copy_only=False).copy()

    def placed(column: pa.Array, field: str) -> tuple[np.ndarray, np.ndarray]:
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        return np.repeat(begin, n) + flat.field("pos").to_numpy(zero_copy_only=False), flat.field(field).to_numpy(zero_copy_only=False)

    np.add.at(spelled, *placed(batch["rare"], "s"))
    count = np.zeros(len(spelled))
    at, c = placed(batch["hits"], "c")
    count[at] = c
    long = lengths.flatten().to_numpy(zero_copy_only=False) >= LONG_PHRASE
    gate = np.concatenate(([0], np.where(count[:-1] == 0, 1, np.where(long[:-1], 3, 2)))).astype(np.int64)[: len(count)]
    gate[begin] = 0
    with np.errstate(divide="ignore"):
        counted = np.log10(count / max(total, 1))
    return np.repeat(np.arange(len(sizes)), sizes), gate, spelled, counted


def mixed_log10(spelled: np.ndarray, counted: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """log10 of weight * 10^counted + (1 - weight) * 10^spelled."""
    ln10 = math.log(10)
    return np.logaddexp((counted + np.log10(weight)) * ln10, (spelled + np.log10(1 - weight)) * ln10) / ln10


def gate_weights(texts: DataFrame, total: int) -> np.ndarray:
    """The weight of the phrase counts behind each gate: their mean share in training phrases, if both weigh alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, n = np.zeros(4), np.zeros(4)
        for batch in batches:
            if batch.num_rows:
                _, gate, spelled, counted = _phrase_costs(batch, total)
                share += np.bincount(gate, 1 / (1 + 10 ** np.clip(spelled - counted, -300, 300)), 4)
                n += np.bincount(gate, minlength=4)
        yield pa.RecordBatch.from_arrays([pa.array(range(4), pa.int32()), pa.array(share), pa.array(n)], ["gate", "share", "n"])

    rows = texts.filter(~F.col("held")).select("sums", "lengths", "rare", "hits").mapInArrow(run, "gate int, share double, n double").groupBy("gate").agg(F.sum("share").alias("share"), F.sum("n").alias("n")).collect()
    out = np.full(4, 0.5)
    for r in rows:
        out[r["gate"]] = (r["share"] + 0.5) / (r["n"] + 1)
    return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    A null text is empty: one token, the end. `score` holds spelling and phrase counts mixed; `base_score` the unigram law. A null doc_id counts as an empty one. Repeated rows are counted
    and scored each; extra columns are ignored; an empty table gives an empty result.
    """
    common.require(docs, key, text)
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held"), F.col(text).alias("text"))
    words = common.stored(count_words(rows), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count_if(F.col("c") > 0).alias("types")).first()
    tokens, types = total["tokens"], total["types"]
    common.small_batches(spark, CHUNK)  # words are short
    model = train(words, tokens, types)
    # plain arrays: a broadcast value travels without its class, and workers need no copy of this package
    shared = spark.sparkContext.broadcast((model.tables, model.weights, model.refined))
    scale = math.log10(tokens + 0.5 * (types + 1))

    def word_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            c = batch.column(1).to_numpy(zero_copy_only=False)
            base = np.log10(c + 0.5) - scale
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base), pa.array(model.log10(batch.column(0).to_pylist()))], ["word", "c", "n", "base", "score"])

    scored = common.stored(words.sortWithinPartitions("word").mapInArrow(word_scores, "word binary, c long, n long, base double, score double"), "scores")
    common.small_batches(spark)
    least = _threshold(scored, frequent)
    top = scored.filter(F.col("n") >= least).select("word", "c", "base", "score").toArrow()
    known = spark.sparkContext.broadcast((top["word"].to_pylist(), np.stack([(top["c"].to_numpy() > 0).astype(float), top["base"].to_numpy(), top["score"].to_numpy()])))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, values = known.value
        index = {w: i for i, w in enumerate(listed)}
        values = np.concatenate((values, np.zeros((3, 1))), axis=1)  # the last: a word that the join adds
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            words, firsts, n_bytes = [], [], []
            for t in batch.column(2).to_pylist():
                firsts.append(len(words))
                words += words_of(t)
                words.append(b"")
                n_bytes.append(len((t or "").encode()))
            phrases = Phrases.of(words, np.array(firsts))
            at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
            known_sum, base_sum = np.add.reduceat(values[:2, at], phrases.firsts, axis=1)
            offsets = np.append(np.searchsorted(phrases.text, np.arange(len(firsts))), len(phrases.text)).astype(np.int32)
            lengths = np.diff(np.append(phrases.starts, len(words)))
            rest = np.flatnonzero(at < 0)
            phrase = np.searchsorted(phrases.starts, rest, "right") - 1
            rest_offsets = pa.array(np.searchsorted(rest, np.append(phrases.firsts, len(words))).astype(np.int32))
            listed_by = lambda values, kind, offsets=pa.array(offsets): pa.ListArray.from_arrays(offsets, pa.array(values, kind))
            ids = pa.array(np.arange(row, row + batch.num_rows, dtype=np.int64))
            row += batch.num_rows
            columns = [
                ids, batch.column(0), batch.column(1), pa.array(np.diff(np.append(phrases.firsts, len(words)))), pa.array(n_bytes, pa.int64()), pa.array(known_sum), pa.array(base_sum),
                listed_by(phrases.hashes, pa.int64()), listed_by(phrases.own(), pa.int32()), listed_by(np.add.reduceat(values[2, at], phrases.starts), pa.float64()), listed_by(lengths.astype(np.int32), pa.int32()),
                listed_by([words[i] for i in rest], pa.binary(), rest_offsets), listed_by((phrase - offsets[phrases.text[phrase]]).astype(np.int32), pa.int32(), rest_offsets),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held", "n_tokens", "n_bytes", "known", "base", "phrases", "own", "sums", "lengths", "rest", "rest_pos"])

    kind = docs.schema[key].dataType.simpleString()
    lists = "phrases array<long>, own array<int>, sums array<double>, lengths array<int>, rest array<binary>, rest_pos array<int>"
    part = common.stored(rows.mapInArrow(texts, f"row long, doc_id {kind}, held boolean, n_tokens long, n_bytes long, known double, base double, {lists}"), "texts")
    each = part.select("row", F.explode(F.arrays_zip("rest", "rest_pos")).alias("r")).select("row", F.col("r.rest").alias("word"), F.col("r.rest_pos").alias("pos"))
    rare = each.join(scored.filter(F.col("n") < least).select("word", "c", "base", "score"), "word")
    added = rare.groupBy(F.col("row").alias("at")).agg(F.count_if(F.col("c") > 0).alias("k"), F.sum("base").alias("b"), F.collect_list(F.struct("pos", F.col("score").alias("s"))).alias("rare"))
    hits, phrases = phrase_hits(part)
    joined = part.drop("rest", "rest_pos", "phrases", "own").join(added, F.col("row") == F.col("at"), "left").join(hits, F.col("row") == F.col("hit_row"), "left").drop("at", "hit_row")
    joined = common.stored(joined, "costs")
    weights = gate_weights(joined, phrases)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, gate, spelled, counted = _phrase_costs(batch, phrases)
                total = np.bincount(text, mixed_log10(spelled, counted, weights[gate]), batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(total)], [*batch.schema.names[:6], "score"])

    plain = joined.select("doc_id", "held", "n_tokens", "n_bytes", (F.col("known").cast("long") + F.coalesce("k", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), "sums", "lengths", "rare", "hits")
    done = plain.mapInArrow(costs, f"doc_id {kind}, held boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double")
    return done.select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores of all documents."""
    return score(common.read_table(spark, sf_dir, "documents"))
