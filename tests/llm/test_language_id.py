"""Language identification: features and centroids against plain versions, held-out accuracy, hard rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.llm import common, language_id

DOCS = "doc_id long, text string, lang string, score string, source string"


def plain_grams(text):
    """Counts of the n-grams of one to three letters or gaps of a text, by definition."""
    s = "".join(x.lower()[0] if x.isalpha() else " " for x in text)
    s = " ".join(s.split()).join("  ")
    grams = [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)]
    return Counter(g for g in grams if g.strip() and (len(g) < 3 or g[1] != " "))


def plain_bin(gram):
    mask, mix = 0xFFFFFFFF, [int(x) for x in language_id._MIX]
    p = [ord(x) for x in gram]
    h = p[0] * mix[0] & mask
    if len(p) > 1:
        h = (h ^ (p[1] * mix[1] & mask)) * mix[2] & mask
    if len(p) > 2:
        h = (h ^ (p[2] * mix[0] & mask)) * mix[1] & mask
    return ((h + (len(p) - 1) * 40503 & mask) * mix[0] & mask) >> 18


def plain_counts(text):
    out = np.zeros(language_id.BINS, int)
    for g, n in plain_grams(text).items():
        out[plain_bin(g)] += n
    return out


TEXTS = ["a", "Ab c", "  Straße,  ÉÀ 12 x", "\U00010400\U00010428 z", "it's\n\nnot\tone", "x" * 50, "日本語 テキスト", "a1b2c3"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_counts_are_those_of_the_whole_text(monkeypatch, text, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    assert (language_id.term_counts(text) == plain_counts(text)).all()


@pytest.mark.parametrize("text", [None, "", "  ", "123 !? \n", "_-_"])
def test_texts_without_letters_have_no_counts(text):
    assert language_id.term_counts(text) is None


def test_clusters_are_unit_means_of_their_texts():
    rng = np.random.default_rng(1)
    groups = [np.abs(rng.normal(0, 0.05, (30, 40))) + np.eye(40)[k] for k in (3, 9, 20)]
    vectors = np.concatenate(groups).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    found = language_id.clustered(vectors, 3)
    assert sorted(int(np.argmax(c)) for c, _ in found) == [3, 9, 20]
    own = np.argmax(vectors @ np.array([c for c, _ in found]).T, axis=1)
    for k, (centre, least) in enumerate(found):
        mean = vectors[own == k].mean(axis=0)
        assert np.allclose(centre, mean / np.linalg.norm(mean), atol=1e-4) and least < (vectors[own == k] @ centre).min()
    assert len(language_id.clustered(vectors[:1], 4)) == 1 and len(language_id.clustered(np.repeat(vectors[:1], 9, axis=0), 4)) >= 1


def invented(n=160, seed=3):
    rng = random.Random(seed)
    parts = {"aa": "th er on an re", "bb": "sch ung ein der ü", "cc": "eau oi què è ou"}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        words = ["".join(rng.choices(parts[lang].split(), k=rng.randint(1, 4))) for _ in range(rng.randint(15, 60))]
        rows.append((i, " ".join(words), lang, "s", "src"))
    return rows


@pytest.fixture(scope="module")
def model_rows(spark):
    rows = invented()
    rows += [(500, None, "aa", "s", "x"), (501, "", "bb", "s", "x"), (502, "12 34 %", "cc", "s", "x"), (503, "ung sch ein der", None, "s", "x"), (504, "ü" * 300_000, "bb", "s", "x"), (None, "eau oi eau", "cc", None, None), (None, None, None, None, None)]
    rows += [rows[7], rows[7], (505, "漢字仮名交じり文", None, None, None)]
    return rows


def test_against_a_plain_model(spark, model_rows):
    """Frequencies, vectors and nearest centroids worked out text by text; the centroids are those fitted."""
    docs = spark.createDataFrame(model_rows, DOCS)
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 0
    train = [(i, lang, t) for i, t, lang, *_ in model_rows if not out(i) and lang is not None]
    df, n = Counter(), 0
    for _, _, t in train:
        held = set(map(plain_bin, plain_grams(t or "")))
        df.update(held)
        n += bool(held)
    rows = docs.select(F.col("doc_id").alias("k"), "lang", F.col("text").alias("t")).filter(~language_id.held_out(F.col("k")) & F.col("lang").isNotNull())
    model = language_id.fit(rows)
    idf = [math.log((1 + n) / (1 + df[b])) + 1 for b in range(language_id.BINS)]
    assert np.allclose(model.idf, idf, atol=1e-5)
    got = language_id.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    want = []
    for i, t, *_ in model_rows:
        tf = Counter()
        for g, c in plain_grams(t or "").items():
            tf[plain_bin(g)] += c
        v = {b: (1 + math.log(c)) * idf[b] for b, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[b]) for b, x in v.items()) / norm if norm else 0.0 for c in model.centroids]
        best = int(np.argmax(cosines)) if norm else None
        want.append((str(i), out(i), "und" if best is None else model.languages[best], round(cosines[best], 4) if norm else 0.0))
    rows = sorted((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in got.collect())
    assert [r[:3] for r in rows] == [w[:3] for w in sorted(want)]
    assert np.allclose([r[3] for r in rows], [w[3] for w in sorted(want)], atol=2e-4)
    found = {r.doc_id: r for r in got.collect()}
    assert all(found[i].lang_pred == "und" and found[i].rejected and found[i].score == 0 for i in (500, 501, 502))
    assert found[503].lang_pred == "bb" and found[505].rejected
    assert all(found[i].lang_pred == lang for i, _, lang, *_ in invented())


def test_nothing_to_learn_and_empty_tables(spark, model_rows):
    docs = spark.createDataFrame(model_rows, DOCS)
    assert language_id.identify(docs.limit(0)).count() == 0
    blank = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score, r.rejected) for r in blank.collect()} == {("und", 0.0, True)} and blank.count() == len(model_rows)


def test_predictions_do_not_read_labels(spark, model_rows):
    docs = spark.createDataFrame(model_rows, DOCS)
    changed = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    pick = lambda d: sorted((str(r.doc_id), r.lang_pred, round(r.score, 5)) for r in language_id.identify(d).collect())
    assert pick(docs) == pick(changed)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        language_id.identify(spark.createDataFrame(invented(), DOCS))


def test_held_out_accuracy(spark):
    docs = common.read_table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.op12_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n, kept = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*"), F.count_if(~F.col("rejected"))).first()
    assert n > 150 and right / n >= 0.97 and kept / n >= 0.9
