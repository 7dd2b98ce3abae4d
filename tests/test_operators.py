"""Operators on small fixtures with exact expectations."""

import pytest
from pyspark.sql import functions as F

from spandrel.operators import catalog, checks, model, quantities, resolve, takeoff

CELL = "design string, chart_id string, seq int, canonical string, products string, condition string, section string, grp string, hours double, thickness_in double, depth_in double, row_label string, ratio double"
QUERY = "query_id int, design string, member string, rating_hours double, restraint string, product string, application string, condition string, joist_depth_in double"


@pytest.fixture(scope="module")
def library(spark):
    charts = spark.createDataFrame(
        [
            ("S721", "c1", 1, "W12X26", "SHIELD 300 and SHIELD 400", "Beam", "Unrestrained", None, 1.0, 0.5, None, "W12x26", 0.62),
            ("S721", "c1", 2, "W12X26", "SHIELD 300 and SHIELD 400", "Beam", "Restrained", None, 1.5, 0.5, None, "W12x26", 0.62),
            ("S721", "c2", 3, "W12X26", "SHIELD 400", "Beam, half flange tip", "Unrestrained", None, 1.0, 0.5625, None, "W12x26", 0.62),
            ("S740", "c3", 4, "W8X10", "SHIELD 400", "Beam", None, None, 1.0, None, None, "W8x10", 0.4),
            ("S740", "c3", 5, "W8X10", "SHIELD 400", "Beam", None, None, 1.0, 0.75, None, "W8x10", 0.4),
            ("S750", "c4", 6, None, "MK-6", "Joist", None, None, 1.0, 0.875, 16.0, "16K2", None),
            ("S750", "c4", 7, None, "MK-6", "Joist", None, None, 1.0, 0.875, 16.0, "16K4", None),
        ],
        CELL,
    )
    listing = spark.createDataFrame([("N782", 1, "W12X26", None, 1.0, 0.4375, 0.62), ("N790", 2, "W10X12", "Restrained", 2.0, 1.0, 0.5)], "design string, seq int, canonical string, condition string, hours double, thickness_in double, ratio double")
    xrefs = spark.createDataFrame([("P723", "SHIELD 300 and SHIELD 400", None, "S721"), ("S721", "SHIELD 400", None, "P723")], "design string, products string, condition string, target string")
    return listing, charts, xrefs


def ask(spark, *rows):
    return spark.createDataFrame([tuple(r) + (None,) * (9 - len(r)) for r in rows], QUERY)


def test_resolution_by_cross_reference(spark, library):
    listing, charts, xrefs = library
    q = ask(
        spark,
        (1, "P723", "W12X26", 1.0, "unrestrained", "SHIELD 400"),
        (2, "P723", "W12X26", 1.5, "restrained", "SHIELD 400"),
        (3, "P723", "W12X26", 1.0, "unrestrained", "SHIELD 400", "half_flange_tip"),
        (4, "P723", "W12X26", 1.0, "unrestrained", None),
        (5, "P723", "W12X26", 1.0, "unrestrained", "MK-6"),
        (6, "X999", "W12X26", 1.0),
        (7, "S740", "W8X10", 1.0, None, "SHIELD 400"),
        (8, "N782", "W12X26", 1.0),
    )
    got = {r.query_id: (r.status, r.thickness_in) for r in resolve.resolve(q, listing, charts, xrefs=xrefs).collect()}
    assert got == {1: ("resolved", 0.5), 2: ("resolved", 0.5), 3: ("resolved", 0.5625), 4: ("review", None), 5: ("unknown", None), 6: ("unknown", None), 7: ("conflict", None), 8: ("resolved", 0.4375)}
    via = resolve.chart_route(q, charts, xrefs).filter("query_id = 1").first()["via"]
    assert via == "P723 → S721"


def test_equations_round_up_and_keep_their_range(spark, library):
    listing, charts, _ = library
    e = spark.createDataFrame([("N782", 1, "W/D", "h = R / (a*X + b)", 1.0, 1.2268, None, None, 0.3, 1.0), ("N790", 2, "W/D", "T = k / (X)", None, None, 1.0, None, 0.6, 1.0)], "design string, seq int, factor string, form string, a double, b double, k double, c double, ratio_lo double, ratio_hi double")
    q = ask(spark, (1, "N782", "W12X26", 1.0), (2, "N790", "W10X12", 1.0))
    found = resolve.equation_route(q, e, resolve.printed_ratio(q, listing, charts)).collect()
    assert [(r.query_id, r.thickness_in) for r in found] == [(1, 0.5625)]
    assert resolve.resolve(q, listing, charts, e).filter("query_id = 1").first()["status"] == "conflict"


def test_joists_collapse(spark, library):
    _, charts, _ = library
    q = ask(spark, (1, "S750", "JOIST 16", 1.0, None, "MK-6", None, None, 16.0))
    rows = resolve.collapse_joists(resolve.chart_route(q, charts)).collect()
    assert [(r.thickness_in, r.row_label) for r in rows] == [(0.875, "2 designations: 16K2, 16K4")]


def test_shape_charts_only_for_review(spark, library):
    listing, charts, _ = library
    shapes = spark.createDataFrame([("s1", 1, "L4X4X1/4", "SHIELD 400", 1.0, 0.9375)], "chart_id string, seq int, canonical string, products string, hours double, thickness_in double").withColumn("design", F.lit(None).cast("string"))
    q = ask(spark, (1, "S721", "L4X4X1/4", 1.0, None, "SHIELD 400"), (2, "S721", "L4X4X1/4", 1.0))
    got = {r.query_id: r.status for r in resolve.resolve(q, listing, charts, shapes=shapes).collect()}
    assert got == {1: "review", 2: "unknown"}


def test_deduplication_keeps_provenance(spark, library):
    listing, charts, _ = library
    copy = charts.withColumn("chart_id", F.concat("chart_id", F.lit("-copy"))).withColumn("seq", F.col("seq") + 100)
    q = ask(spark, (1, "S721", "W12X26", 1.0, "unrestrained", "SHIELD 300"))
    rows = resolve.deduplicated(resolve.chart_route(q, charts.unionByName(copy))).collect()
    assert [(r.chart_id, r.also_in) for r in rows] == [("c1", ["c1-copy"])]


def test_surface_and_quantities(spark):
    shapes = spark.createDataFrame([("W12X26", 12.2, 6.49, 0.23)], "label string, d double, bf double, tw double")
    rows = [("a", "W12X26", 3, None, 120.0, 0.5), ("b", "W10X12", 4, 0.5, 120.0, 0.5), ("c", "HSS6X4X1/4", 4, None, 120.0, 0.5), ("d", "HSS6X0.250", 3, None, 120.0, 0.5), ("e", "L4X2X1/4", 3, None, None, 0.5), ("f", "2L4X4X1/4", 3, None, 12.0, 0.5), ("g", "W12X26", 3, None, 12.0, None)]
    m = spark.createDataFrame(rows, "id string, canonical_section string, sides int, ratio double, length_in double, thickness_in double").withColumn("ratio_kind", F.lit("W/D"))
    q = {r.id: r for r in quantities.member_quantity(quantities.surface_basis(m, shapes)).collect()}
    assert q["a"].perimeter_in == pytest.approx(2 * 12.2 + 3 * 6.49 - 2 * 0.23) and q["a"].method == "aisc_dimensions"
    assert (q["b"].perimeter_in, q["b"].method) == (24, "chart_wd")
    assert (q["c"].perimeter_in, round(q["d"].perimeter_in, 2), q["e"].perimeter_in) == (20, 18.85, 11.5)
    assert [q[k].status for k in "abcdefg"] == ["ok", "ok", "ok", "ok", "no_length", "no_surface_basis", "no_thickness"]
    assert q["b"].sq_ft == 20 and q["b"].bd_ft == 10
    t = quantities.totals(quantities.member_quantity(quantities.surface_basis(m, shapes)), waste_pct=10.0, yield_bdft=3.0).first()
    assert (t.members, t.members_quantified) == (7, 4) and t.bd_ft_adjusted == pytest.approx(t.bd_ft * 1.1)
    assert quantities.totals(quantities.member_quantity(quantities.surface_basis(m, shapes))).first().bd_ft_adjusted is None


def test_summary_keeps_unknown_lengths_apart(spark):
    rows = [("L1", "W12X26", 120.0, "accepted"), ("L1", "W12X26", None, "unreviewed"), ("L1", "W12X26", 12.0, "excluded")]
    m = takeoff.status_color(spark.createDataFrame(rows, "level string, canonical_section string, length_in double, review_state string").withColumns({c: F.lit(0.5) for c in ("confidence_id", "confidence_geom", "confidence_length")}))
    r = takeoff.summary(m).first()
    assert (r.n, r.n_with_length, r.total_lf, r.unknown_lengths, r.needs_review) == (2, 1, 10, 1, 1)


def test_chains_and_cuts(spark):
    s = spark.createDataFrame([(1, 5.0, 0.0, 10.0, False), (1, 5.0, 11.0, 20.0, False), (1, 5.0, 30.0, 60.0, False), (1, 5.0, 2.0, 4.0, False), (1, 5.0, 0.0, 9.0, True)], "page int, y double, x0 double, x1 double, dashed boolean")
    chains = takeoff.merge_chains(s)
    assert sorted((r.dashed, r.x0, r.x1, r.pieces) for r in chains.collect()) == [(False, 0, 20, 3), (False, 30, 60, 1), (True, 0, 9, 1)]
    cuts = spark.createDataFrame([(1, 5.0, 40.0), (1, 5.0, 43.0), (1, 5.0, 58.0)], "page int, y double, x double")
    pieces = takeoff.split_at_cuts(chains.filter("x0 = 30").select("page", "y", "dashed", "x0", "x1"), cuts)
    assert [(r.p0, r.p1) for r in pieces.orderBy("piece").collect()] == [(30, 40), (40, 60)]


def test_rows_from_first_and_from_last(spark):
    s = spark.createDataFrame([(1, i, float(y), 0.0) for i, y in enumerate((0, 1.5, 3, 4.5, 20))], "page int, span_id int, y double, x double")
    assert [r.row_no for r in takeoff.cluster_rows(s, 2.0).orderBy("y").collect()] == [1, 1, 1, 1, 2]
    assert [r.row_no for r in takeoff.cluster_rows_from_first(s, 2.0).orderBy("y").collect()] == [1, 1, 2, 2, 3]


def test_same_members_merge_in_order(spark):
    m = spark.createDataFrame([(1, "W", i, x, 0.0, x + 9, 0.0) for i, x in enumerate((0.0, 1.5, 3.0, 0.5))], "page long, section string, seq long, x0 double, y0 double, x1 double, y1 double")
    assert [(r.seq, r.n_merged) for r in takeoff.merge_same_members(m).orderBy("seq").collect()] == [(0, 2), (2, 0)]


def test_sheet_facts(spark):
    s = spark.createDataFrame([(1, 1, "LEVEL 02", 10.0, 10.0, 8.0), (1, 2, "Level 03", 90.0, 10.0, 8.0), (1, 3, "S-101", 90.0, 95.0, 20.0), (1, 4, "S-102", 90.0, 95.0, 9.0)], "page int, span_id int, text string, x double, y double, size double").withColumns({"width": F.lit(100.0), "height": F.lit(100.0)})
    assert tuple(takeoff.sheet_level(s).first()) == (1, "LEVEL 03", 0.85)
    assert takeoff.sheet_number(s).first()["sheet"] == "S-101"
    assert takeoff.synthetic_members(spark).count() == 4 * 4 + 5 * 3


def test_current_rows_and_supersession(spark):
    a = spark.createDataFrame([(1, 7, "base", 10, 0.5, None), (2, 7, "base", 20, 0.75, 1), (3, 7, "alt", 30, 1.0, None), (4, 8, "base", 10, None, None)], "id long, member_id long, scenario_id string, created_at long, thickness_in double, supersedes_id long")
    assert sorted((r.member_id, r.scenario_id, r.id) for r in model.current(a).collect()) == [(7, "alt", 3), (7, "base", 2), (8, "base", 4)]
    new = spark.createDataFrame([(9, 7, "base", 40, 0.9)], "id long, member_id long, scenario_id string, created_at long, thickness_in double")
    added = model.assign(a, new)
    assert added.first()["supersedes_id"] == 2
    assert model.current(a.unionByName(added)).filter("member_id = 7 and scenario_id = 'base'").first()["id"] == 9


def test_review_events_and_choices(spark):
    e = spark.createDataFrame([(1, 5, 10, "open", "conflict"), (2, 5, 20, "resolved", "conflict"), (3, 6, 10, "open", "unknown")], "event_id long, item_id long, ts long, status string, category string")
    assert [r.item_id for r in model.open_items(e).collect()] == [6]
    closing = model.choose(e, spark.createDataFrame([(6, 30), (5, 30)], "item_id long, ts long"))
    assert [(r.item_id, r.status) for r in closing.collect()] == [(6, "resolved")]


def test_members_without_evidence_are_refused(spark):
    m = spark.createDataFrame([("a", [("label", "W12")]), ("b", []), ("c", None)], "member_id string, evidence array<struct<kind:string,raw_text:string>>")
    out = model.save_members(m)
    assert [r.member_id for r in out["member"].collect()] == ["a"] and out["evidence"].count() == 1
    assert sorted(r.member_id for r in out["refused"].collect()) == ["b", "c"]


def test_integrity_and_base_scenario(spark):
    a = spark.createDataFrame([("FACT", 1.2, "s", None), ("FACT", 0.9, None, None), ("CALCULATION", 0.9, "s", None), ("FACT", 0.9, "s", None)], "kind string, confidence double, source_ref string, method string")
    assert sorted(r.rule for r in model.violations(a).collect()) == ["calculation_without_method", "confidence_range", "fact_without_source"]
    none = spark.createDataFrame([], "project_id string, kind string")
    base = model.ensure_base(none, spark.createDataFrame([("p",)], "project_id string"))
    assert base.count() == 1 and model.ensure_base(base, spark.createDataFrame([("p",)], "project_id string")).count() == 0


def test_verdicts(spark):
    s = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.75), (4, 0.9), (5, None), (6, 0.5), (7, 0.5)], "query_id int, submitted_in double")
    r = spark.createDataFrame([(1, "resolved", 0.5), (2, "resolved", 0.75), (3, "conflict", None), (4, "conflict", None), (5, "resolved", 0.5), (6, "unknown", None), (7, "resolved", None)], "query_id int, status string, thickness_in double")
    c = spark.createDataFrame([(3, 0.75), (4, 0.5)], "query_id int, thickness_in double")
    got = [x.verdict for x in checks.verdicts(s, r, c).orderBy("query_id").collect()]
    assert got == ["match", "differs", "match-one-route", "differs", "skipped", "unknown", "not-rated"]


def test_designs_by_role_and_tokens(spark):
    s = spark.createDataFrame([("column", [("X701",), ("N701",)]), ("beam", [("X701",), ("N701",)]), ("beam", [("Y701",)])], "role string, designs array<struct<design:string>>")
    assert [[d.design for d in r.designs] for r in checks.designs_for_role(s).collect()] == [["X701"], ["N701"], ["Y701"]]
    t = spark.createDataFrame([(["C", "lw"],), (["NW"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in t.select(checks.condition_of_tokens(F.col("t"))).collect()] == ["Cellular or Corrugated Deck Lightweight", "Normal Weight", None, None]


def test_matching_and_score(spark):
    cols = "level string, section string, seq long, length_in double"
    truth = spark.createDataFrame([("L", "A", 1, 100.0), ("L", "A", 2, 200.0), ("L", "B", 3, 50.0)], cols)
    predicted = spark.createDataFrame([("L", "A", 1, 199.0), ("L", "A", 2, 100.0), ("L", "A", 3, 100.0), ("L", "C", 4, 1.0)], cols)
    m = checks.match_to_key(predicted, truth)
    assert sorted((r.kind, r.seq) for r in m.collect() if r.seq) == [("duplicate", 3), ("false_positive", 4), ("match", 1), ("match", 2)]
    s = checks.score(m).first()
    assert (s.matched, s.missed, s.recall, s.precision) == (2, 1, pytest.approx(2 / 3), 0.5)
    assert (s.median_error, s.p95_error) == (pytest.approx(0.005), 0.0)


def test_crawl_is_breadth_first(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "src string, dst string")
    got = {r.url: r.depth for r in catalog.crawl_order(spark.createDataFrame([("a",)], "url string"), e, 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_empty_tables(spark):
    q = spark.createDataFrame([], QUERY)
    none = spark.createDataFrame([], CELL)
    assert resolve.resolve(q, none, none).count() == 0
    assert model.current(spark.createDataFrame([], "id long, member_id long, scenario_id string, created_at long, thickness_in double, supersedes_id long")).count() == 0


def test_product_lines(spark):
    rows = spark.createDataFrame([("Acme Shield 400",), ("ACME",), (None,)], "n string")
    assert [r[0] for r in rows.select(checks.product_line(F.col("n"), ("acme",))).collect()] == ["SHIELD 400", None, None]


def test_hops_reach_each_design_once(spark):
    names = [f"S{700 + k}" for k in range(8)]
    xrefs = spark.createDataFrame([(a, b) for a in names for b in names if a != b] + [("S707", "S900"), ("S900", "S901")], "design string, target string")
    q = spark.createDataFrame([(1, "S700", "W8X10", 1.0), (2, "S900", "W8X10", 1.0), (3, None, "W8X10", 1.0)], "query_id int, design string, member string, rating_hours double")
    got = {}
    for r in resolve.hops(q, xrefs).collect():
        got.setdefault(r.query_id, []).append((r.at, len(r.path)))
    assert sorted(got[1]) == sorted([("S700", 1), *[(n, 2) for n in names[1:]], ("S900", 3), ("S901", 4)]) and sorted(got[2]) == [("S900", 1), ("S901", 2)]


def test_reasons_name_the_test_that_removed_the_last_cell(spark):
    q = spark.createDataFrame(
        [(1, "S700", "W8X10", 3.0, None, None), (2, "S700", "W8X10", 1.0, "restrained", None), (3, "S700", "W8X10", 1.0, None, "Other"), (4, "S700", "W9X10", 1.0, None, None), (5, "S999", "W8X10", 1.0, None, None), (6, "S700", "W8X10", 2.0, None, "Brand 1"), (7, "S700", "W8X10", 1.0, "unrestrained", "brand 1")],
        "query_id int, design string, member string, rating_hours double, restraint string, product string",
    )
    cell = [("c", k, "W8X10", "S700", h, t, "Unrestrained Beam", "Brand 1") for k, (h, t) in enumerate(((1.0, 0.5), (1.5, 0.75), (2.0, None)))]
    charts = spark.createDataFrame(cell, "chart_id string, seq int, canonical string, design string, hours double, thickness_in double, section string, products string")
    listing = charts.select("seq", "canonical", "design", "hours", "thickness_in", F.lit("Restrained assembly").alias("condition")).filter("hours = 1")
    got = {(r.query_id, r.route): (r.reason, r.n_rows, r.after_product, r.after_restraint, r.after_column, r.seen) for r in resolve.reasons(q, listing, charts).collect()}
    assert got[1, "chart_table"] == ("column", 3, 3, 3, 0, ["1.0", "1.5", "2.0"]) and got[2, "chart_table"] == ("restraint", 3, 3, 0, 0, ["unrestrained"])
    assert got[3, "chart_table"] == ("product", 3, 0, 0, 0, ["Brand 1"]) and got[4, "chart_table"][0] == "member not printed" and got[5, "chart_table"][0] == "design not in the library"
    assert got[6, "chart_table"] == ("rated", 3, 3, 3, 1, []) and got[7, "chart_table"][0] == "found"
    assert got[7, "ul_table"] == ("restraint", 1, None, 0, 0, ["restrained"]) and got[1, "ul_table"] == ("column", 1, None, 1, 0, ["1.0"])


def test_bid_queries_and_report(spark):
    sheets = spark.createDataFrame(
        [("A1", "Brand 1 Inc", [("S700", 1.0), ("X700", 2.0), ("S700", 1.0)]), ("A2", None, []), ("A3", None, None), ("A4", None, [("S701", None)])],
        "sheet_no string, product_name string, designs array<struct<design:string,rating_hr:double>>",
    )
    items = spark.createDataFrame(
        [(1, "A1", "W8X10", None, "beam", 3, 0.5), (2, "A1", "W8X10", None, "column", 4, 0.5), (3, "A2", None, "odd", None, None, 1.0), (4, "A1", None, None, "beam", 3, 0.5), (5, "A1", "W8X10", None, None, 3, None), (6, "A3", "W8X10", None, None, 3, 1.0), (7, "A4", "W8X10", None, "column", 3, 1.0), (8, "no sheet", "W8X10", None, None, 3, 1.0)],
        "item_id int, sheet_no string, canonical_section string, member_label string, role string, sides int, thickness_in double",
    )
    asked = {(r.item_id, r.design): (r.member, r.rating_hours, r.restraint, r.product, r.assumption) for r in checks.bid_queries(sheets, items).collect()}
    assumed = "restraint assumed unrestrained"
    assert asked == {(1, "S700"): ("W8X10", 1.0, "unrestrained", "BRAND 1", assumed), (2, "X700"): ("W8X10", 2.0, None, "BRAND 1", None), (3, None): ("odd", None, "unrestrained", None, None),
                     (6, None): ("W8X10", None, "unrestrained", None, None), (7, "S701"): ("W8X10", 0.0, None, None, None), (8, None): ("W8X10", None, "unrestrained", None, None)}
    listing = spark.createDataFrame([("S700", 1, "W8X10", 1.0, 0.5)], "design string, seq int, canonical string, hours double, thickness_in double")
    charts = spark.createDataFrame([], "chart_id string, design string, seq int, canonical string, hours double, thickness_in double")
    got = {(r.item_id, r.design): (r.status, r.verdict) for r in checks.bid_report(sheets, items, listing, charts).collect()}
    assert got[1, "S700"] == ("resolved", "match") and got[2, "X700"] == ("unknown", "unknown") and got[3, None] == ("no-design", "no-design") and len(got) == 6


def test_keywords_in_one_scan_where_none_cross(spark):
    assert catalog._passes(["fire rating", "rating", "rating level", "level"]) == [["rating level", "rating", "level"], ["fire rating"]]
    text = "Assembly Rating, assembly ratings; RATING rating beam/beam w/d w/dx overrating license version1"
    got = catalog.keyword_scores(spark.createDataFrame([(1, text, "src3"), (2, None, None), (3, "", "src2")], "k int, t string, f string"), "k", "t", "f").orderBy("k").collect()
    assert tuple(got[0])[1:] == (1, 3 + 2 + 1, 3, 1) and tuple(got[1])[1:] == (0, 0, 0, 0) and tuple(got[2])[1:] == (0, 3, 0, 0)


def test_legend_codes_and_drawing_report(spark):
    kinds = "row_id int, product_hint string, canonical string, role string, joist_depth_in double, design string, design_suffix string, design_tokens array<string>, hours double, thickness_in double, sides int"
    rows = [
        (1, None, "W8X10", "primary_beam", None, "S700", None, ["nw"], 1.0, 0.5, 3), (2, None, "W8X10", "column", None, "X700", None, ["C", "LW"], 1.0, 0.5, 3), (3, None, "W8X10", "deck", None, "S700", "b", ["Q"], 1.0, 0.75, 3),
        (4, None, "W8X10", "deck", None, "S700", None, None, 1.0, 0.75, 4), (5, None, None, "joist", None, "S700", None, None, 1.0, 0.75, 3), (6, None, "W8X10", "deck", None, "S700", None, ["C", "P/T"], None, 0.75, 3),
    ]
    legend = spark.createDataFrame(rows, kinds)
    listing = spark.createDataFrame([("S700", 1, "W8X10", 1.0, 0.5)], "design string, seq int, canonical string, hours double, thickness_in double")
    charts = spark.createDataFrame([], "chart_id string, design string, seq int, canonical string, hours double, thickness_in double")
    got = {r.row_id: (r.condition, r.restraint, len(r.notes), r.verdict) for r in checks.drawing_report(legend, listing, charts).collect()}
    assert got == {1: ("Normal Weight", "unrestrained", 0, "match"), 2: ("Lightweight", None, 1, "unknown"), 3: (None, None, 2, "differs-unmapped-code"), 4: (None, None, 0, "differs-4-sides"), 5: (None, "unrestrained", 0, "skipped"), 6: ("Cellular or Corrugated Deck", None, 2, "skipped")}
