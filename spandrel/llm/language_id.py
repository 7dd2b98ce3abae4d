"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Texts are read as letters and gaps (all else), lower-cased, in n-grams of one to three code points hashed to `BINS`
features. Document frequencies are counted over all training texts. Vectors are (1 + log tf) * idf, of length one.
Each language gets up to `CLUSTERS` centroids by spherical k-means, fitted on at most about `SAMPLE` training texts
of it, picked by a hash of the id (the bound of the fit; all else covers all rows). A text is given the language of
the centroid of greatest cosine; it is marked rejected if it lies further from that centroid than the language's own
texts lie from theirs (all but a few of them, `OUTSIDE`), by a margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BINS = 1 << 14
CLUSTERS = 4
ROUNDS = 12
#: Training texts of a language on which its centroids are fitted, at most (in expectation).
SAMPLE = 1_500
#: A text is rejected beyond this quantile of its language's distances, times MARGIN.
OUTSIDE = 0.995
MARGIN = 1.25
#: Languages that a model may hold; more are an error, none is dropped.
MOST_LANGUAGES = 512
#: Code points worked on at once, whatever a text's length.
PIECE = 1 << 20
UNKNOWN = "und"
#: Rows of a batch of texts.
ROWS = 256
_MIX = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


def held_out(key: Column) -> Column:
    """Whether the crc32 of the id as text is divisible by 5. A null id counts as an empty one."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def _letter(point: int) -> int:
    """The code point of the lower case of a letter, a blank for all else."""
    x = chr(point)
    return ord(x.lower()[0]) if x.isalpha() else 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([_letter(c) for c in range(1 << 16)], np.uint32)


def letters_of(text: str) -> np.ndarray:
    """The code points of `text`, each as its lower-cased letter or a blank."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    out = table[np.minimum(points, len(table) - 1)]
    for c in np.unique(points[points >= len(table)]):
        out[points == c] = _letter(int(c))
    return out


def term_counts(text: str | None) -> np.ndarray | None:
    """How often each of the BINS hashed n-grams stands in the whole text; None if it has no letter.

    A gap has one blank however long it is; n-grams of gaps alone are left out. Long texts go in pieces that
    overlap by two code points.
    """
    total, tail, seen = None, np.array([32], np.uint32), False
    text = text or ""
    for start in range(0, len(text), PIECE):
        points = letters_of(text[start : start + PIECE])
        last = start + PIECE >= len(text)
        points = np.concatenate([tail, points, np.array([32] * last, np.uint32)])
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
        points = points[keep]
        letters = points != 32
        fresh = len(tail) if start else 0
        seen |= bool(letters.any())
        one = points * _MIX[0]
        two = (one[:-1] ^ (points[1:] * _MIX[1])) * _MIX[2] if len(points) > 1 else one[:0]
        three = (two[:-1] ^ (points[2:] * _MIX[0])) * _MIX[1] if len(points) > 2 else one[:0]
        # an n-gram counts in the piece in which its last code point is new
        grams = [one[fresh:][letters[fresh:]], two[max(fresh - 1, 0) :], three[max(fresh - 2, 0) :][letters[1:-1][max(fresh - 2, 0) :]]]
        bins = np.concatenate([(g + np.uint32(k * 40503)) * _MIX[0] >> np.uint32(18) for k, g in enumerate(grams)])
        counts = np.bincount(bins, minlength=BINS)
        total = counts if total is None else total + counts
        tail = points[-2:]
    return total if seen else None


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Number of the texts (column `t`) that hold each n-gram, and of those with a letter; each task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts = term_counts(text.as_py())
                if counts is not None:
                    df += counts > 0
                    n += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(df[found], n))], ["bin", "n"])

    common.small_batches(texts.sparkSession, ROWS)
    summed = texts.select("t").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    df, total = np.zeros(BINS, np.int64), int(summed.loc[summed["bin"] < 0, "n"].sum())
    summed = summed[summed["bin"] >= 0]
    df[summed["bin"].to_numpy()] = summed["n"].to_numpy()
    return df, total


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of rows of counts."""
    vectors = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def clustered(vectors: np.ndarray, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Centroids of unit vectors by spherical k-means, with the cosine below which a text is rejected.

    Starts from the mean and then the vector furthest from all chosen, so it depends on the vectors alone. Clusters
    without a vector go.
    """
    chosen = [vectors.mean(axis=0)]
    while len(chosen) < min(clusters, len(vectors)):
        nearest = np.max(vectors @ np.array(chosen).T / np.linalg.norm(chosen, axis=1), axis=1)
        chosen.append(vectors[np.argmin(nearest)])
    centres = np.array(chosen)
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        own = np.argmax(vectors @ centres.T, axis=1)
        moved = np.array([vectors[own == c].mean(axis=0) for c in range(len(centres)) if (own == c).any()])
        done = moved.shape == centres.shape and np.allclose(moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12), centres, atol=1e-5)
        centres = moved
        if done:
            break
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    distance = 1 - np.max(vectors @ centres.T, axis=1)
    least = float(1 - min(1.0, MARGIN * np.quantile(distance, OUTSIDE)))
    return [(c.astype(np.float32), least) for c in centres]


@dataclass(frozen=True)
class Model:
    """Inverse document frequencies, and centroids with their languages and least cosines."""

    idf: np.ndarray
    languages: tuple[str, ...]
    centroids: np.ndarray
    least: np.ndarray

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = weighted(counts, self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)


def sampled(train: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, t): about `sample` texts of each language, all where there are no more. A row's hash of its id decides, so a repeated run takes the same ones."""
    sizes = train.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in the training rows")
    if not sizes:
        return train.select("lang", "t").limit(0)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample / r["n"]))])
    drawn = F.pmod(F.xxhash64(F.lit("centroids"), F.col("k")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return train.filter(drawn < F.element_at(share, F.col("lang"))).select("lang", "t")


def fit(train: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """A model of the training rows (k, lang, t); lang is not null."""
    df, total = document_frequencies(train)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, bins, counts = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = term_counts(text.as_py())
                if found is not None:
                    langs.append(lang)
                    bins.append(np.flatnonzero(found).astype(np.int32))
                    counts.append(found[bins[-1]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(bins, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["lang", "bins", "counts"])

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((len(rows), BINS), np.float32)
        for i, (b, c) in enumerate(zip(rows["bins"], rows["counts"], strict=True)):
            dense[i, b] = c
        found = clustered(weighted(dense[np.lexsort((dense.sum(axis=1), dense @ np.arange(BINS, dtype=np.float32)))], idf), clusters)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "least": [f for _, f in found], "centre": [c for c, _ in found]})

    common.small_batches(train.sparkSession, ROWS)
    sparse = sampled(train, sample).mapInArrow(vectors, "lang string, bins array<int>, counts array<int>")
    found = sparse.groupBy("lang").applyInPandas(cluster, "lang string, least double, centre array<float>").collect()
    found.sort(key=lambda r: (r["lang"], -r["least"]))
    centres = np.array([r["centre"] for r in found], np.float32).reshape(len(found), BINS)
    return Model(idf, tuple(r["lang"] for r in found), centres, np.array([r["least"] for r in found]))


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """The rows (doc_id, held_out, t) with lang_pred, score and rejected in place of t; reads the text alone."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))  # BINS * 4 bytes a centroid, CLUSTERS a language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            n = batch.num_rows
            names, scores, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            counts = [term_counts(t.as_py()) if len(m.languages) else None for t in batch.column(2)]
            at = [i for i, c in enumerate(counts) if c is not None]
            if at:
                best, cosine = m.nearest(np.array([counts[i] for i in at]))
                scores[at], rejected[at] = cosine, cosine < m.least[best]
                for i, b in zip(at, best, strict=True):
                    names[i] = m.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(scores), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    common.small_batches(rows.sparkSession, ROWS)
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, clusters: int = CLUSTERS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), a row for each row of `docs`.

    Learns from the text and language of rows that are not held out and have a language. lang_pred is `und`, score 0
    and rejected true for texts that are null or hold no letter (and for all texts if nothing can be learned);
    otherwise the nearest centroid's language and the cosine. `rejected` marks texts too far from it. Repeated rows
    get a row each; ties go to the language of least name; further columns are ignored; an empty table gives an
    empty result.
    """
    common.require(docs, key, text, lang)
    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("t"), F.col(lang).cast("string").alias("lang"))
    train = rows.filter(~F.col("held_out") & F.col("lang").isNotNull()).select(F.col("doc_id").alias("k"), "lang", "t")
    return predict(rows.select("doc_id", "held_out", "t"), fit(train, sample, clusters))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return identify(common.read_table(spark, sf_dir, "documents"))
