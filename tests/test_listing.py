"""Whole listing records: kinds of parts, tables over page ends, equations, and no line lost."""

import random

import pytest

from spandrel.operators import listing

COLUMN = """Design No. X901
May 03, 2018
Ratings — 1, 1-1/2 and 2 Hr (See Item 1)
A line before the items
1. Spray-Applied Materials* — Applied by spraying to the thicknesses below.
R
h =
0.95 (W/D) + 0.45
where
h = thickness in the range of 3/8 to 3-3/4 in
R = Fire resistance rating in hours
W/D in the range of 0.30 to 0.55
MAKER ONE CO — Types A, B and
Type C
The thickness of sizes is shown in the table below:
Steel
Size
W/D
1 Hr
1-1/2 Hr
Min Thkns
In. 2 Hr
W8x10
0.33
1-1/4
2-5/16
3-9/16
4/24/2019
FIRE RATINGS | Site
https://example.org/p?e=1
2/3
*W6 x
16
0.57
5/8*
NR
2
(1-3/4**)
NR = No Rating
W10x12
7
A. Alternate method for the columns of this item.
2. Board, intumescent — T = 0.5/(W/D) for 1 hour ratings, W/D of 0.5 to 1.5
Hp/A
30 min, mm
60 min, mm
100
0.5
0.9
120
0.6
1.1
3. Beams — As follows.
Restrained Beam
Rating Hr
Unrestrained Beam
Rating Hr
Thickness In.
1
1
5/8
2
1-1/2
15/16
Rating Period (min)
60
120
Required Thickness (mils)
W12x26
41
83
Last Updated on 2018-05-08
May be copied in its entirety.
"""


def read(text):
    reader, out = listing.Reader("d"), []
    for n, s in enumerate(text.split("\n")):
        out += reader.feed(n, s)
    return out + list(reader.close())


def of(found, kind):
    return [p for p in found if p["kind"] == kind]


def covered(text, found):
    want = [n for n, s in enumerate(text.split("\n")) if s.strip()]
    return sorted(n for p in found for n in p["lines"]) == want


def test_parts_of_a_listing():
    found = read(COLUMN)
    assert covered(COLUMN, found)
    assert [p["label"] for p in of(found, "design") + of(found, "design_date") + of(found, "updated")] == ["X901", "May 03, 2018", "2018-05-08"]
    (rating,) = of(found, "rating")
    assert (rating["hours"], rating["note"]) == ([1, 1.5, 2], "See Item 1")
    assert [(p["item"], p["label"]) for p in of(found, "item")] == [("1", "Spray-Applied Materials*"), ("2", "Board, intumescent"), ("3", "Beams")]
    assert [(p["item"], p["label"], p["text"]) for p in of(found, "maker")] == [("1", "MAKER ONE CO", "Types A, B and Type C")]
    assert [(p["item"], p["sub"]) for p in of(found, "sub_item")] == [("1", "A")]
    assert [p["text"] for p in of(found, "furniture")] == ["4/24/2019\nFIRE RATINGS | Site\nhttps://example.org/p?e=1\n2/3"]
    assert [p["text"] for p in of(found, "notice")] == ["May be copied in its entirety."]
    assert {p["text"] for p in of(found, "unparsed")} == {"A line before the items", "W10x12\n7"}


def test_tables_of_a_listing():
    found = read(COLUMN)
    tables = [(p["table_no"], p["item"], p["label"], p["hours"], p["cells"], p["units"], p["condition"]) for p in of(found, "table")]
    below = "The thickness of sizes is shown in the table below:"
    assert tables == [
        (1, "1", "size_wd", [1, 1.5, 2], ["W/D"], "in", below),
        (2, "2", "ratio_rows", [0.5, 1], ["Hp/A"], "mm", None),
        (3, "3", "rating_rows", [], [], "in", "Restrained Beam"),
        (4, "3", "size_wd", [1, 2], [], "mils", None),
    ]
    rows = [(p["table_no"], p["label"], p["ratios"], p["hours"], p["values_in"], p["note"]) for p in of(found, "row")]
    assert rows[:2] == [(1, "W8x10", [0.33], [1, 1.5, 2], [1.25, 2.3125, 3.5625], None), (1, "W6 x 16", [0.57], [1, 1.5, 2], [0.625, None, 2], "5/8* (1-3/4**) *")]
    assert rows[2:4] == [(2, None, [100], [0.5, 1], [None, None], None), (2, None, [120], [0.5, 1], [None, None], None)]
    assert rows[4:6] == [(3, None, [], [1, 1], [0.625], None), (3, None, [], [2, 1.5], [0.9375], None)]
    assert rows[6][:4] == (4, "W12x26", [], [1, 2]) and rows[6][4] == pytest.approx([0.041, 0.083])


def test_equations_of_a_listing():
    first, second = (p["equation"] for p in of(read(COLUMN), "equation"))
    assert (first["form"], first["factor"], first["a"], first["b"], first["r_units"]) == ("h = R / (a*X + b)", "W/D", 0.95, 0.45, "hours")
    assert (first["ratio_lo"], first["ratio_hi"], first["h_lo"], first["h_hi"], first["h_units"]) == (0.3, 0.55, 0.375, 3.75, "in")
    assert (second["form"], second["k"], second["hours"], second["ratio_lo"]) == ("T = k / (X)", 0.5, 1, 0.5)


@pytest.mark.parametrize("text, form, constants", [
    ("T =((0.0142*Hp/A) - 0.4131)", "T = a*(X) + b", {"a": 0.0142, "b": -0.4131}), ("T = 1.2 (W/D) + 0.3 in", "T = a*(X) + b", {"a": 1.2, "b": 0.3}),
    ("R — 0.38\nh =\n3.58 (A/P)", "h = (R - c) / (k*X)", {"c": 0.38, "k": 3.58}), ("h = R / (1.05 (W/D) + 0.61)", "h = R / (a*X + b)", {"a": 1.05, "b": 0.61}),
])
def test_equation_forms(text, form, constants):
    whole = f"Design No. X1234\n1. Item — x\n{text}"
    found = read(whole)
    (e,) = of(found, "equation")
    assert covered(whole, found) and e["equation"]["form"] == form and {k: e["equation"][k] for k in constants} == constants


def test_second_table_takes_the_heading_above():
    table = "{}\n1 Hr\n2 Hr\nW8x10\n0.33\n{}\n{}"
    text = "Design No. X902\n1. Item — x\nSizes are in the table below\n" + table.format("Thickness, mm", 12, 20) + "\n" + table.format("Thickness, In.", "1/2", "3/4")
    found = read(text)
    one, two = of(found, "table")
    assert covered(text, found) and (one["condition"], two["condition"]) == ("Sizes are in the table below",) * 2
    assert (one["units"], two["units"], two["note"]) == ("mm", "in", "heading of the table directly above")
    assert [p["values_in"] for p in of(found, "row")] == [[None, None], [0.5, 0.75]]


def test_a_cut_table_gives_the_rows_of_the_whole_one():
    lines = COLUMN.split("\n")
    start = lines.index("W8x10")
    whole = [x for k, x in enumerate(lines) if not lines.index("4/24/2019") <= k <= lines.index("2/3")]
    rows = lambda ls: [(p["label"], p["cells"]) for p in of(read("\n".join(ls)), "row")]
    for cut in range(start, start + 8):
        assert rows([*whole[:cut], "4/24/2019", "A | B", "https://x.y/p", "2/3", *whole[cut:]]) == rows(whole)


@pytest.mark.parametrize("seed", range(60))
def test_no_line_is_lost_or_doubled(seed):
    rng = random.Random(seed)
    pool = COLUMN.split("\n") + ["R", "h =", "R — 0.4", "1/2/2019", "W16 x", "(1/2*)", "", "Note", "2 Hr", "Rating, Hr", "NR", "5/8", "1.", "A. x", "—", "CO — t,"]
    text = "\n".join((["Design No. X903"] if seed % 3 else []) + [rng.choice(pool) for _ in range(rng.randint(0, 80))])
    assert covered(text, read(text))


def test_records_over_tables(spark):
    rows = [("b", n, s) for n, s in enumerate(COLUMN.split("\n"))] + [("a", 5, None), ("a", 6, "  "), ("c", 1, "Nothing known")]
    random.Random(1).shuffle(rows)
    lines = spark.createDataFrame(rows, "document string, line_no int, text string")
    found = listing.parts(lines)
    assert {r.document for r in found.collect()} == {"b", "c"}
    got = {r.document: r for r in listing.records(found).collect()}
    assert (got["b"].design, got["b"].last_updated, got["b"].snapshot_date) == ("X901", "2018-05-08", "4/24/2019")
    assert len(got["b"].tables) == 4 and len(got["b"].rows) == 7 and len(got["b"].equations) == 2 and len(got["b"].makers) == 1
    assert got["c"].design is None and [x.text for x in got["c"].unparsed] == ["Nothing known"]
    assert listing.parts(lines.limit(0)).count() == 0


def test_documents_are_read_in_batches_and_answers_kept_are_bounded(spark, monkeypatch):
    lines = spark.createDataFrame([("b", 0, "Design No. X101"), ("a", 1, "May 03, 2018"), ("a", 0, "Design No. X100"), (None, 0, "Design No. X102"), ("b", 1, None)], "document string, line_no int, text string")
    found = listing.parts(lines)
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "PythonUDTF" not in found._jdf.queryExecution().toString()
    got = {(r.document, r.kind, r.line_no, r.label) for r in found.collect()}
    assert got == {("a", "design", 0, "X100"), ("a", "design_date", 1, "May 03, 2018"), ("b", "design", 0, "X101"), (None, "design", 0, "X102")}
    assert listing.parts(lines.limit(0)).count() == 0
    monkeypatch.setattr(listing, "KEPT", 3)
    kept = listing.remembered(lambda s: s.upper())
    assert [kept(s) for s in "abcdeabcde"] == list("ABCDEABCDE") and len(kept.__closure__[1].cell_contents) <= 3
    assert kept("x" * 100) == "X" * 100 and "x" * 100 not in kept.__closure__[1].cell_contents
