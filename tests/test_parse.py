"""Printed lines and positioned spans as tables."""

import pytest
from pyspark.sql import functions as F

from spandrel.operators import parse, takeoff


def test_chart_lines(spark):
    text = ["Isolated Beams", "Unrestrained Beam", "Size W/D 1 Hr 1-1/2 Hr 2 Hr", "W12x26 0.62 1/2 13/16 1-1/16", "W8x10 0.37 NR 1 1-1/4", "W8x15 0.50 1/2 1", "Restrained", "W14x30 .61 7/16 3/4 1"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)] + [("e", 0, "W12x26 0.62 1/2 13/16 1-1/16")], "document string, line_no int, text string")
    rows = parse.chart_rows(lines).orderBy("line_no", "hours").collect()
    assert [(r.canonical, r.hours, r.thickness_in) for r in rows if r.line_no == 3] == [("W12X26", 1, 0.5), ("W12X26", 1.5, 0.8125), ("W12X26", 2, 1.0625)]
    assert [(r.thickness_in, r.note) for r in rows if r.line_no == 4][0] == (None, "not rated")
    assert [r.note for r in rows if r.line_no == 5] == ["cells do not fit the header"]
    assert {(r.line_no, r.section) for r in rows} == {(3, "Unrestrained Beam"), (4, "Unrestrained Beam"), (5, "Unrestrained Beam"), (7, "Restrained")}


def test_listing_cells(spark):
    texts = {
        "a": ["Unrestrained Beam", "Min Thkns In.", "Size", "W/D", "1 Hr", "1-1/2 Hr", "W16 x", "100", "0.62", "1/2", "NR", "", "*W8x10", "3/8*", "9/16", "W8x15", ".5", "1/2", "3/4", "1", "Note 1", "2 Hr", "W8x10", "1"],
        "b": ["Thickness, mils", "A/P", "1 Hr", "2 Hr", "0.5", "40", "80", "0.75", "30", "60"],
        "c": ["Thickness, mm", "1 Hr", "5", "2 Hr", "9", "7"],
        "d": ["W8x10", "0.5", "12", "nothing rated"],
        "e": [],
    }
    lines = spark.createDataFrame([(d, k, t) for d, ts in texts.items() for k, t in enumerate(ts)] + [("e", 0, None), ("e", 1, "  ")], "document string, line_no int, text string")
    got = {}
    for r in parse.listing_cells(lines).orderBy("document", "line_no", "hours", "value_no").collect():
        got.setdefault(r.document, []).append((r.kind, r.canonical, r.ratio, r.hours, r.value_no, r.thickness_in, r.note))
    assert got["a"] == [
        ("size_wd", "W16X100", 0.62, 1, None, 0.5, None), ("size_wd", "W16X100", 0.62, 1.5, None, None, "not rated"), ("size_wd", "W8X10", None, 1, None, 0.375, "marked"),
        ("size_wd", "W8X10", None, 1.5, None, 0.5625, "marked"), ("size_wd", "W8X15", None, None, None, None, "cells do not fit the header"), ("size_wd", "W8X10", None, 2, None, 1, None),
    ]
    assert got["b"] == [("ratio_rows", None, x, h, None, v, None) for x, h, v in ((0.5, 1, 0.04), (0.5, 2, 0.08), (0.75, 1, 0.03), (0.75, 2, 0.06))]
    assert got["c"] == [("rating_rows", None, None, 1, 1, None, None), ("rating_rows", None, None, 2, 1, None, None), ("rating_rows", None, None, 2, 2, None, None)]
    assert set(got) == {"a", "b", "c"}


def test_listing_equations_and_header(spark):
    t = "Design No. N782 Last Updated: 2019-10-09 Ratings 1 Hr, 1-1/2 Hr. h = R / [1.05 (W/D) + 0.61] or T = 0.95 / (A/P); h = (R - 0.2) / (1.1 (W/D)) T = 1.2 (W/D) - 0.3"
    e = {r.form: r for r in parse.listing_equations(spark.createDataFrame([("N782", t)], "design string, text string")).collect()}
    assert (e["h = R / (a*X + b)"].a, e["h = R / (a*X + b)"].b, e["h = R / (a*X + b)"].factor) == (1.05, 0.61, "W/D")
    assert (e["T = k / (X)"].k, e["T = k / (X)"].factor) == (0.95, "A/P")
    assert (e["h = (R - c) / (k*X)"].c, e["h = (R - c) / (k*X)"].k) == (0.2, 1.1)
    assert (e["T = a*(X) + b"].a, e["T = a*(X) + b"].b) == (1.2, -0.3)
    h = parse.listing_header(spark.createDataFrame([("x", t), ("y", "")], "document string, text string")).orderBy("document").collect()
    assert (h[0].design, h[0].hours, h[0].last_updated) == ("N782", [1.0, 1.5], "2019-10-09") and (h[1].design, h[1].hours) == (None, [])


def test_positioned_cells(spark):
    s = spark.createDataFrame([(1, 1, 100.0), (2, 1, 130.0), (3, 1, 400.0)], "span_id int, page int, x double")
    h = spark.createDataFrame([(1, "A", 95.0), (1, "B", 140.0)], "page int, head string, x double")
    assert [r.head for r in parse.positioned_cells(s, h).orderBy("span_id").collect()] == ["A", "B", None]


def test_legends(spark):
    t = spark.createDataFrame([("16 JOIST 4-sided LW C",), ("Secondary beam NW",), ("COLUMN P/T",), ("Misc",)], "text string")
    got = [(r.role, r.sides, r.joist_depth_in, r.design_tokens) for r in parse.legend_rows(t).collect()]
    assert got == [("joist", 4, 16, ["LW", "C"]), ("secondary_beam", None, None, ["NW"]), ("column", None, None, ["P/T"]), ("other", None, None, [])]


def test_long_workbook(spark):
    rows = spark.createDataFrame([(1, "SB", "LW", "1 hr", "41"), (2, "SB", "NW", "2 hr", "NR"), (3, "SB", "LW", "x", "5"), (4, "SX", None, "1 hr", "?")], "id int, product string, variant string, rating string, mils string")
    index = spark.createDataFrame([("sb", "l-w", "N661"), ("S B", None, "N600")], "product string, variant string, design string")
    got = [(r.id, r.design, r.hours, r.thickness_mils, r.not_rated) for r in parse.long_workbook(rows, ["id"], index).orderBy("id").collect()]
    assert got == [(1, "N661", 1, 41, False), (2, "N600", 2, None, True)]


def test_lines_neighbours_and_contexts(spark):
    s = spark.createDataFrame([(1, 1, 1, 1, 0.0, 0.0, 8.0, "W12x26"), (2, 1, 1, 1, 40.0, 0.0, 8.0, "(30)"), (3, 1, 2, 1, 30.0, 50.0, 8.0, "BEAM SCHEDULE"), (4, 1, 3, 1, 900.0, 0.0, 8.0, "W14x30")], "span_id int, page int, block int, line int, x double, y double, size double, text string")
    assert takeoff.line_text(s).filter("block = 1").first()["text"] == "W12x26 (30)"
    around = takeoff.neighbourhood(s, s)
    assert around.filter("span_id = 1").first()["around"] == "(30) BEAM SCHEDULE"
    c = takeoff.label_context(s.join(around, "span_id", "left").withColumn("stacked", F.lit(False)))
    assert {r.span_id: r.context for r in c.collect()} == {1: "schedule", 2: "schedule", 3: "plan_label", 4: "plan_label"}


def test_dimensions_crossings_and_cuts(spark):
    c = spark.createDataFrame([(1, 1, 100.0, 0.0, 200.0, 360.0, 0.7), (2, 1, 500.0, 0.0, 200.0, 360.0, 0.95)], "chain_id int, page int, y double, x0 double, x1 double, length_in double, confidence double")
    d = spark.createDataFrame([(1, 7, 90.0, 140.0, 362.0), (1, 8, 90.0, 60.0, 360.0), (1, 9, 90.0, 490.0, 300.0)], "page int, dim_id int, x double, y double, inches double")
    assert {r.chain_id: (r.dim_id, round(r.confidence, 2)) for r in takeoff.corroborated(c, d).collect()} == {1: (7, 0.8), 2: (None, 0.95)}
    v = spark.createDataFrame([(21, 1, 90.0, 0.0, 200.0), (22, 1, 300.0, 0.0, 900.0)], "chain_id int, page int, x double, y0 double, y1 double")
    met = takeoff.crossings(c, v)
    assert [(r.chain_id, r.v_id) for r in met.collect()] == [(1, 21)]
    labels = spark.createDataFrame([(1, 1, 40.0), (1, 2, 120.0), (2, 3, 40.0), (2, 4, 100.0)], "chain_id int, span_id int, x double")
    got = {r.chain_id: (r.cut, r.needs_review) for r in takeoff.cuts_between_labels(labels, met).collect()}
    assert got == {1: (90.0, False), 2: (70.0, True)}


def test_segments_lengths(spark):
    assert takeoff.synthetic_members(spark, 1, 1).agg(F.sum("length_in")).first()[0] == pytest.approx(4 * 360)
