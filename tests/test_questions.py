"""Queries that ask the same cost the library one search."""

import re

import pytest
from pyspark.sql import functions as F

from spandrel.operators import checks, resolve

QUERY = "query_id int, design string, member string, rating_hours double, restraint string, product string, submitted_in double"


@pytest.fixture(scope="module")
def library(spark):
    charts = spark.createDataFrame(
        [("S1", "c1", 1, "W8X10", "MK-6", "Beam", None, 1.0, 0.5, 16.0, "R1"), ("S1", "c1", 2, "W8X10", "MK-6", "Beam", None, 1.0, 0.75, 16.0, "R2"), ("S1", "c1", 3, "W8X12", "MK-6", "Beam", None, 1.0, 0.75, 16.0, "R3")],
        "design string, chart_id string, seq int, canonical string, products string, condition string, section string, hours double, thickness_in double, depth_in double, row_label string",
    )
    listing = spark.createDataFrame([("S1", 1, "W8X12", None, 1.0, 0.75)], "design string, seq int, canonical string, condition string, hours double, thickness_in double")
    return listing, charts


@pytest.fixture
def queries(spark):
    rows = [(k, "S1", ("W8X10", "W8X12", "W9")[k % 3], 1.0, None, "MK-6" if k % 2 else None, (0.5, 0.75, 0.6)[k // 3 % 3]) for k in range(90)]
    return spark.createDataFrame(rows, QUERY)


def asked_by(monkeypatch):
    asked, find = [], resolve.candidates
    monkeypatch.setattr(resolve, "candidates", lambda q, *a, **k: (asked.append(q.count()), find(q, *a, **k))[1])
    return asked


def test_resolve_asks_once(spark, library, queries, monkeypatch):
    alone = {k: resolve.resolve(queries.filter(F.col("query_id") == k), *library).first() for k in range(6)}
    asked = asked_by(monkeypatch)
    found = {r.query_id: r for r in resolve.resolve(queries, *library).collect()}
    assert asked == [6] and len(found) == 90
    assert all(found[k][1:] == alone[k % 6][1:] for k in found)


def test_verdicts_are_of_each_query(library, queries, monkeypatch):
    asked = asked_by(monkeypatch)
    got = {r.query_id: r.verdict for r in checks.judged(queries, *library).collect()}
    assert asked == [6] and len(got) == 90
    assert [got[k] for k in (0, 3, 6, 1, 4)] == ["match-one-route", "match-one-route", "differs", "differs", "match"]


def test_reasons_join_cells_once_a_question(library, queries, monkeypatch):
    rows, why = [], resolve._why_not
    monkeypatch.setattr(resolve, "_why_not", lambda hits, *a: (rows.append(hits.count()), why(hits, *a))[1])
    got = resolve.reasons(queries, *library)
    assert got.count() == 180 and rows == [2, 6]
    assert got.filter("query_id % 3 = 0 and route = 'chart_table' and reason = 'found' and n_rows = 2").count() == 30


def test_rows_of_a_route_reach_every_query(library, queries):
    listing, charts = library
    depth = queries.drop("product").withColumn("joist_depth_in", F.lit(16.0))
    once = resolve.by_question(depth, lambda asked: resolve.collapse_joists(resolve.chart_route(asked, charts)))
    each = resolve.collapse_joists(resolve.chart_route(depth, charts))
    plain = lambda df: sorted((r.query_id, r.thickness_in, r.seq, r.row_label) for r in df.collect())
    assert plain(once) == plain(each) and len(plain(once)) == 180
    asked, named = resolve.asked_once(depth)
    assert asked.count() == 3 and named.count() == 90


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_questions_are_broadcast(spark, library, queries, monkeypatch):
    monkeypatch.setattr(resolve, "few", lambda df, counted=None: df, raising=False)
    merged = sorted(resolve.resolve(queries, *library).collect())
    monkeypatch.undo()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked, named = resolve.asked_once(queries)
        assert "BroadcastHashJoin" in plan_of(named) and asked.agg(F.sum("times")).first()[0] == 90
        assert sorted(resolve.resolve(queries, *library).collect()) == merged
        monkeypatch.setattr(resolve, "FEW", 0)
        many = resolve.resolve(queries, *library)
        assert "BroadcastHashJoin" not in plan_of(many) and sorted(many.collect()) == merged
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def stored_by(monkeypatch):
    stored, keep = [], checks.checkpointed
    monkeypatch.setattr(checks, "checkpointed", lambda df: (lambda kept: (stored.append(kept.count()), kept)[1])(keep(df)))
    return stored


def test_verdicts_store_a_value_once(library, queries, monkeypatch):
    listing, charts = library
    twice = charts.unionByName(charts.withColumn("seq", F.col("seq") + 10))
    want = sorted(checks.judged(queries, listing, charts).collect())
    stored = stored_by(monkeypatch)
    assert sorted(checks.judged(queries, listing, twice).collect()) == want
    assert stored == [8]  # the method and value of each of four answered questions, not 14 cells


def test_reasons_are_counted_by_hash_first(library, queries):
    plan = plan_of(resolve._reasons(queries, *library, None))
    assert re.search(r"(?<!Object)HashAggregate\(keys=\[query_id#\w+, fell#", plan)


def test_reports_store_no_rows_of_their_own(spark, library, monkeypatch):
    listing, charts = library
    sheets = spark.createDataFrame([(1, "MK-6 Inc", [("S1", 1.0)]), (2, None, [])], "sheet_no int, product_name string, designs array<struct<design:string,rating_hr:double>>")
    items = spark.createDataFrame([(k, 1 + k % 2, "W8X12", "l", "beam", 3, 0.75) for k in range(20)], "item_id int, sheet_no int, canonical_section string, member_label string, role string, sides int, thickness_in double")
    stored = stored_by(monkeypatch)
    got = checks.bid_report(sheets, items, listing, charts).groupBy("verdict").count().collect()
    assert sorted(tuple(r) for r in got) == [("match", 10), ("no-design", 10)] and stored == [2]
    legend = spark.createDataFrame([(k, "MK-6 Inc", "W8X12", "joist" if k % 2 else "beam", None, "S1", None, None, 1.0, 0.75, 3) for k in range(20)], "row_id int, product_hint string, canonical string, role string, joist_depth_in double, design string, design_suffix string, design_tokens array<string>, hours double, thickness_in double, sides int")
    legend = legend.withColumn("thickness_in", F.when(F.col("row_id") < 12, F.col("thickness_in")))
    del stored[:]
    got = checks.drawing_report(legend, listing, charts).groupBy("verdict", "status").count().collect()
    assert sorted((r["verdict"], r["status"] or "", r["count"]) for r in got) == [("match", "resolved", 12), ("skipped", "", 8)] and stored == [4]


def test_counted_resolutions_are_of_questions(library, queries):
    counted = resolve.resolve_counted(queries, *library)
    each = {r["status"]: r["count"] for r in resolve.resolve(queries, *library).groupBy("status").count().collect()}
    assert counted.count() == 6 and {r["status"]: r["n"] for r in counted.groupBy("status").agg(F.sum("times").alias("n")).collect()} == each


def test_assignments_are_read_from_their_own_row(spark, sf_dir):
    from spandrel.plans.catalogue import QUERIES

    plan = plan_of(QUERIES["assign_resolved"](spark, sf_dir))
    assert not any("Join" in line and "assertion_id" in line for line in plan.splitlines())


def test_chains_of_several_cells_are_cut_once(spark):
    from spandrel.operators import takeoff

    rows = [(1, 5.0, False, 0.0, 600.0), (1, 5.0, False, 0.0, 600.0), (1, 5.0, None, 10.0, 90.0), (2, 5.0, True, 0.0, 300.0)]
    chains = spark.createDataFrame(rows, "page int, y double, dashed boolean, x0 double, x1 double")
    cuts = spark.createDataFrame([(1, 5.0, 50.0), (1, 5.0, 52.0), (1, 5.0, 512.0), (1, 5.0, 50.0), (1, 5.0, 597.0)], "page int, y double, x double")
    found = takeoff.split_at_cuts(chains, cuts)
    got = sorted((r.page, r.x1, r.piece, r.p0, r.p1) for r in found.collect())
    assert got == sorted([(1, 600.0, p, a, b) for p, a, b in ((0, 0.0, 50.0), (1, 50.0, 512.0), (2, 512.0, 600.0)) for _ in range(2)] + [(1, 90.0, 0, 10.0, 50.0), (1, 90.0, 1, 50.0, 90.0), (2, 300.0, 0, 0.0, 300.0)])


def test_charts_are_not_shuffled_for_their_own_facts(spark, library, queries, monkeypatch):
    listing, charts = library
    more = charts.withColumns({"chart_id": F.lit("c2"), "section": F.lit("Restrained Beam")})
    asked = queries.withColumn("restraint", F.lit("restrained"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cells = lambda: resolve._chart_cells(charts.unionByName(more))
        assert "BroadcastHashJoin" in plan_of(cells()) and "Exchange hashpartitioning" not in plan_of(cells())
        got = sorted(cells().select("chart_id", "seq", "groups", "restraints").collect())
        found = sorted(resolve.resolve(asked, listing, charts.unionByName(more)).collect())
        assert {(r.chart_id, tuple(r.restraints)) for r in got} == {("c1", ()), ("c2", ("restrained",))} and len(got) == 6
        monkeypatch.setattr(resolve, "FEW", 0)
        assert "BroadcastHashJoin" not in plan_of(cells())
        assert sorted(cells().select("chart_id", "seq", "groups", "restraints").collect()) == got and sorted(resolve.resolve(asked, listing, charts.unionByName(more)).collect()) == found
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_ratios_are_read_for_designs_with_an_equation(spark, library, queries, monkeypatch):
    listing, charts = (d.withColumns({"ratio": F.lit(0.5), "ratio_kind": F.lit("W/D")}) for d in library)
    other = lambda d: d.unionByName(d.withColumn("design", F.lit("S2")))
    equations = spark.createDataFrame([("S2", 1, "W/D", "T = k / (X)", 1.0, 0.5, 0.25, 0.5)], "design string, seq int, factor string, form string, a double, b double, k double, c double")
    asked = queries.withColumn("design", F.when(F.col("query_id") < 45, "S1").otherwise("S2"))
    seen, look_up = [], resolve.printed_ratio
    monkeypatch.setattr(resolve, "printed_ratio", lambda *d: (seen.append([{r.design for r in x.select("design").collect()} for x in d]), look_up(*d))[1])
    found = resolve.candidates(asked, other(listing), other(charts), equations)
    assert seen == [[{"S2"}] * 3]
    whole = resolve.equation_route(asked, equations, look_up(asked, other(listing), other(charts)))
    plain = lambda df: sorted((r.query_id, r.thickness_in, r.seq) for r in df.collect())
    assert plain(found.filter("method = 'ul_equation'")) == plain(whole) and len(plain(whole)) == 30
    monkeypatch.setattr(resolve, "FEW", 0)
    assert plain(resolve.candidates(asked, other(listing), other(charts), equations).filter("method = 'ul_equation'")) == plain(whole)


def test_chart_cells_are_tested_by_rating_first(library, queries):
    plan = plan_of(resolve.chart_route(queries, library[1]))
    join = next(line for line in plan.splitlines() if "Join" in line and "rating_hours" in line)
    assert join.index("abs((hours") < join.index("p_products")


def test_many_answers_go_through_dealt_queries(library, queries, monkeypatch):
    depth = queries.drop("product").withColumn("joist_depth_in", F.lit(16.0))
    answer = lambda asked: resolve.collapse_joists(resolve.chart_route(asked, library[1]))
    plain = lambda df: sorted((r.query_id, r.thickness_in, r.seq, r.row_label) for r in df.collect())
    monkeypatch.setattr(resolve, "DEAL", 7)
    many = resolve.by_question(depth, answer, many=True)
    assert plain(many) == plain(resolve.by_question(depth, answer)) and len(plain(many)) == 180
    assert re.search(r"SortMergeJoin \[question#\w+L?, part#\w+L?\]", plan_of(many))


def test_joists_ask_no_member(spark, sf_dir, monkeypatch):
    from spandrel.plans.catalogue import QUERIES
    from spandrel.sources.bridge import bridge

    asked, route = [], resolve.chart_route
    monkeypatch.setattr(resolve, "chart_route", lambda q, *a: (asked.append(q.count()), route(q, *a))[1])
    got = QUERIES["joist_collapse"](spark, sf_dir)
    q = bridge(spark, sf_dir, "query_set").select("design", "rating_hours", "restraint", F.col("query_id") % 6).distinct().count()
    assert got.count() > 0 and asked == [q]


def test_depths_within_the_tolerance_meet_once(spark, library):
    charts = library[1].withColumn("depth_in", F.lit(16.0))
    q = spark.createDataFrame([(1, 16.0 - 5e-7), (2, 16.0 + 5e-7), (3, 16.0 + 3e-6), (4, None)], "query_id int, joist_depth_in double").selectExpr("*", "'S1' as design", "'none' as member", "1.0D as rating_hours")
    n = charts.filter("design = 'S1' and hours = 1.0").count()
    got = resolve.chart_route(q, charts).groupBy("query_id").count().collect()
    assert n > 0 and sorted(tuple(r) for r in got) == [(1, n), (2, n)]
