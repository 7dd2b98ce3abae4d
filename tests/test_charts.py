"""Charts without given heads: columns and groups by position, layouts by fit, tables cut by page ends."""

import random

import pytest

from spandrel.operators import charts

SPANS = "document string, page int, span_id int, x0 double, x1 double, y double, text string"


def page(document, number, rows, heads=True, start=0, shift=0.0):
    out = []

    def put(x, y, text, width=None):
        w = width if width is not None else 5.0 * len(text)
        out.append((document, number, start + len(out), x - w / 2 + shift, x + w / 2 + shift, float(y), text))

    if heads:
        put(300, 60, "A long line of words about the chart and its product")
        put(275, 90, "NORMAL WEIGHT", 140)
        put(475, 90, "LIGHT WEIGHT", 140)
        put(60, 95, "Member")
        for x, t in ((60, "Size"), (130, "W/D"), (225, "1 Hr"), (325, "2 hr"), (425, "1 hr"), (525, "2 Hr.")):
            put(x, 104, t)
    for i, row in enumerate(rows):
        y = 130 + 12 * i
        for x, t in zip((60, 130, 225, 325, 425, 525), row, strict=True):
            if t is not None:
                put(x + (i % 3) - 1, y + 0.4 * (i % 2), t)
    return out


ROWS = [("W8x10", "0.33", "1/2", "1", "3/8", "7/8"), ("W12x26", "0.62", "NR", "1-1/8", "1/4", "—"), ("Other", "0.4", "9", "x y", None, "1 1/2"), ("16 in beam", None, "1/2", None, None, None)]


def cells(spark, spans):
    random.Random(1).shuffle(spans)
    return charts.positioned_chart(spark.createDataFrame(spans, SPANS))


def test_columns_groups_and_notes(spark):
    got = {(r.row_no, r.group_no, r.hours): r for r in cells(spark, page("d", 1, ROWS)).collect()}
    first = min(k[0] for k in got)
    row = lambda i: {(k[1], k[2]): (r.label, r.canonical, r.ratio, r.thickness_in, r.note) for k, r in got.items() if k[0] == first + i}
    assert row(0) == {(1, 1): ("W8x10", "W8X10", 0.33, 0.5, None), (1, 2): ("W8x10", "W8X10", 0.33, 1, None), (2, 1): ("W8x10", "W8X10", 0.33, 0.375, None), (2, 2): ("W8x10", "W8X10", 0.33, 0.875, None)}
    assert [row(1)[k][3:] for k in sorted(row(1))] == [(None, "not rated"), (1.125, None), (0.25, None), (None, "not rated")]
    assert [row(2)[k][3:] for k in sorted(row(2))] == [(None, "too thick"), (None, "not a thickness"), (1.5, None)]
    assert row(3) == {(1, 1): ("16 in beam", None, None, 0.5, None)}
    assert {r.title for k, r in got.items() if k[1] == 1} == {"NORMAL WEIGHT"} and {r.title for k, r in got.items() if k[1] == 2} == {"LIGHT WEIGHT"}
    assert {r.ratio_name for r in got.values() if r.ratio is not None} == {"W/D"}


def test_a_cut_chart_gives_the_rows_of_the_whole_one(spark):
    many = [(f"W8x{10 + i}", f"0.{30 + i}", "1/2", "1", "3/8", "7/8") for i in range(20)]
    key = lambda df: sorted((r.label, r.group_no, r.title, r.hours, r.ratio, r.thickness_in) for r in df.collect())
    whole = key(cells(spark, page("d", 1, many)))
    for cut in (1, 13):
        assert key(cells(spark, page("d", 1, many[:cut]) + page("d", 2, many[cut:], heads=False, start=500))) == whole
    assert len(whole) == 80


def test_pages_without_heads_and_hard_tables(spark):
    assert cells(spark, page("d", 1, ROWS, heads=False)).count() == 0
    other = [(d, p, s, a, b, y, t.replace("2 H", "3 H").replace("2 h", "3 h")) for d, p, s, a, b, y, t in page("d", 2, ROWS, start=900)]
    assert {r.page for r in cells(spark, page("d", 1, ROWS) + other).collect()} == {1}
    blank = [("e", 1, 1, 0.0, 5.0, 10.0, " "), ("e", 1, 2, 0.0, 5.0, 20.0, None)]
    assert cells(spark, blank).count() == 0
    assert charts.positioned_chart(spark.createDataFrame([], SPANS)).count() == 0


LINES = "document string, page int, line_no int, text string"
CHART = ["Beams", "Size W/D 1 Hr 1-1/2 Hr 2 Hr", *[f"W12x{26 + i} 0.{62 + i} 1/2 13/16 1-1/16" for i in range(6)], "W8x10 0.37 NR 1", "Size W/D M/D Hp/A 1 Hr 2 Hr", "W14x30 0.61 35.8 219.2 7/16 1", "W14x34 0.65 38.1 205.9 3/8 —"]


def runs_and_rows(spark, pages):
    rows = [("d", p, n, t) for p, texts in enumerate(pages, 1) for n, t in enumerate(texts)]
    random.Random(2).shuffle(rows)
    runs, cells = charts.chart_runs(spark.createDataFrame(rows, LINES))
    return sorted(runs.collect(), key=lambda r: r.run), cells.collect()


def test_layouts_compete(spark):
    runs, rows = runs_and_rows(spark, [CHART, ["See Design No. N708 for joists", "and use Design S721"], ["nothing here"]])
    assert [(r.kind, r.ratios, r.fits, r.rows) for r in runs] == [("no_rows", None, None, None), ("table", 1, 6, 7), ("table", 3, 2, 2), ("cross_reference", None, None, None), ("no_rows", None, None, None)]
    assert runs[3].targets == ["N708", "S721"]
    by = {(r.canonical, r.hours): (r.ratios, r.thickness_in, r.note) for r in rows}
    assert by["W12X27", 1.5] == ([0.63], 0.8125, None) and by["W14X34", 2] == ([0.65, 38.1, 205.9], None, "not rated") and by["W8X10", None] == (None, None, "cells do not fit the layout")


@pytest.mark.parametrize("cut", [5, 8])
def test_a_table_cut_by_a_page_end(spark, cut):
    key = lambda rows: sorted((r.label, str(r.hours), str(r.ratios), str(r.thickness_in), str(r.note)) for r in rows)
    runs, rows = runs_and_rows(spark, [CHART[:cut], CHART[cut:]])
    assert key(rows) == key(runs_and_rows(spark, [CHART])[1])
    assert "continued" in {r.kind for r in runs}


def test_an_earlier_layout_wins_where_it_fits_better(spark):
    pages = [CHART[:5] + ["Ratings 1 Hr 2 Hr are kept apart"], ["W10x12 0.44 1/2 3/4 1"]]
    runs, rows = runs_and_rows(spark, pages)
    assert (runs[-1].kind, len(runs[-1].ratings)) == ("continued", 3) and {r.hours for r in rows if r.canonical == "W10X12"} == {1, 1.5, 2}
