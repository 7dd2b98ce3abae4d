"""Spelling variants against brute force, with hard vocabularies."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spandrel.llm import common, spelling

WORDS = "word string, n long"


def edits(word, alphabet):
    cut = {word[:i] + word[i + 1 :] for i in range(len(word))}
    changed = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    longer = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return (cut | changed | longer) - {word}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) < 2 and a != b and a[same + (len(a) == len(b)) :] == b[same + 1 :]


def plain(counts):
    """{word: (form, root, n, n_near, form_n)} by trying all edits of every word, or all pairs of long words."""
    alphabet = sorted(set("".join(counts)))
    form, near_of, long = {}, {}, [w for w in counts if len(w) > 30]
    for w, n in counts.items():
        near = [x for x in edits(w, alphabet) if x in counts] if len(w) < 30 else [x for x in long if one_apart(w, x)]
        near_of[w] = len(near)
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, near_of[w], counts[form[w]] if form[w] is not None else None)
    return out


def plain_counts(rows):
    counts = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_trie_pairs_are_all_pairs(seed):
    rng = random.Random(seed)
    m = rng.randint(1, 5)
    words = list({"".join(rng.choices("abé"[: rng.randint(1, 3)], k=rng.choice([m, m + 1]))) for _ in range(rng.randint(0, 60))})
    want = {(a, b) for a, b in itertools.permutations(words, 2) if b in edits(a, "abé") and min(len(a), len(b)) == m}
    got = [(words[i], words[j]) for i, j in spelling.neighbours(words, m)]
    assert set(got) == want and len(got) == len(set(got))


@pytest.mark.parametrize("block", [2, 7, spelling.BLOCK])
def test_variants_whatever_the_block(spark, block):
    rng = random.Random(5)
    counts = {}
    for _ in range(500):
        w = "".join(rng.choices("abc", k=rng.randint(5, 8)))
        counts[w] = rng.choice([3, 3, 4, 6, 8, 16, 50])
    long = "ab" * 3000
    counts |= {long: 3, long + "a": 9, long[:3000] + "x" + long[3000:]: 3, "x" + long[1:]: 70, "aaaaa": 5, "aaaaaa": 10, "aaaaaaa": 20, "aaaaaaaa": 40, "Àbcde": 3, "àbcde": 6, "ÿyÿyÿ": 4}
    words = spark.createDataFrame(list(counts.items()), WORDS)
    assert found(spelling.variants(words, block)) == plain(counts)


def test_documents_with_hard_rows(spark):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdÉé", k=rng.randint(3, 9))) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(base, k=200)).title() if i % 3 else "\n".join(rng.choices(base, k=300))) for i in range(60)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, None), (70, None), (71, ""), (72, "1 2 _ ×÷"), (73, ("q" * 100_000 + " ") * 3), (74, "x1Words2wordsÀwords-WORDS words words Words")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = found(spelling.group_spellings(docs))
    assert got == plain(plain_counts(rows))
    assert "q" * 100_000 in got or "q" * 99_999 in got
    assert found(spelling.group_spellings(docs.limit(0))) == {}
    assert found(spelling.group_spellings(docs.filter("text is null"))) == {}


def test_query_against_brute_force(spark, sf_dir):
    docs = common.read_table(spark, sf_dir, "documents")
    want = plain(plain_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    got = spelling.op13_spelling_variants(spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(got) == want and any(v[0] for v in want.values())


def test_a_hot_half_is_cut_into_bounded_tries(spark):
    rng = random.Random(9)
    words = {"prefixes" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(900)}
    rows = spark.createDataFrame([(w, 3) for w in words], WORDS)
    level = spelling.halved(rows.select("word", "n", F.lit("").alias("block"), F.col("word").alias("rest"), F.lit(14).alias("m")))
    assert level.groupBy("block").count().agg(F.max("count")).first()[0] == len(words)
    again = spelling.halved(level)
    assert again.groupBy("block").count().agg(F.max("count")).first()[0] < len(words)
    assert found(spelling.variants(rows, 100)) == plain(dict.fromkeys(words, 3))
