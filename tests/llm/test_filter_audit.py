"""The filter audit against brute force and against its SQL, with hard rows."""

import itertools
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spandrel.llm import common, filter_audit

DOCS = "doc_id long, text string, lang string, mask string, k int"
LABELS = "doc_id long, quality int, toxic int, note string"


def plain(rows, labels):
    """The contract, order by order and document by document."""
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x, _ in labels if x == 1 and i is not None}
    docs = []
    for i, t, part, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {x for x, bad in zip("ABCDE", [
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t) is not None,
            i is not None and any((u or "") == t and j is not None and j < i for j, u, *_ in rows)], strict=True) if bad}
        docs.append((part or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine, share = [d for d in docs if d[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, x in enumerate(order, 1):
                before = set(order[: s - 1])
                here = [d for d in mine if x in d[1] and not d[1] & before]
                share[x] += len(here)
                out[part, order, s] = [sum(not d[1] & (before | {x}) for d in mine), len(here), sum(x in d[1] and bool(d[1] & before) for d in mine),
                                       sum(d[1] == {x} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here), x]
        for key, v in out.items():
            if key[0] == part:
                v[6] = share[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    many = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", " \t\n", "short", many, many, many + " A" * 40, "same " * 400, many.upper(), many + " #", "A|B " * 300, "x" * 300_000, many + "\x0bé\x0c" + many, "short", "a b"]
    out = [(i, t, ["en", "de", None, ""][i % 4], "m", i) for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, "short", "en", None, None), (None, many, None, None, None), (None, None, "fr", None, None), (40, many, "fr", None, None)]


LABEL_ROWS = [(i, i % 2, (i + 1) % 3, "n") for i in range(16)] + [(4, 1, 1, None), (5, None, None, None), (None, 1, 1, None), (99, 1, 1, None)]


def test_audit_against_brute_force(spark, rows):
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(LABEL_ROWS, LABELS))
    assert found(got) == plain(rows, LABEL_ROWS)
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS]
    assert got.count() == 600 * 4


def test_empty_tables(spark, rows):
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert found(filter_audit.audit(docs, labels)) == plain(rows, [])


def test_missing_column_is_named(spark, rows):
    with pytest.raises(ValueError, match="lang"):
        filter_audit.audit(spark.createDataFrame(rows, DOCS).drop("lang"), spark.createDataFrame([], LABELS))


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = filter_audit.op11_filter_audit(spark, sf_dir)
    want = con.execute(filter_audit.OP11_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_words_are_counted_after_one_shuffle_of_texts(spark, sf_dir):
    rows = common.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("tid"), F.col("text").alias("t"))
    plan = filter_audit.word_totals(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
