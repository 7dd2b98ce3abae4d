"""Parsing and geometry against printed examples."""

import pytest
from pyspark.sql import functions as F

from spandrel.functions import designation, geometry
from spandrel.functions import text as T
from spandrel.sources.tables import page_list


def values(spark, build, *texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("x"))).collect()]


def test_dimensions(spark):
    got = values(spark, T.dimension_inches, "28'-6\"", "28' - 6 1/2\"", '3/4"', "1'-0 3/8\"", "W18X35", "12'", "-2'", "", None)
    assert got == [342, 342.5, 0.75, 12.375, None, 144, -24, None, None]


def test_feet_and_inches(spark):
    rows = spark.createDataFrame([(342.0,), (342.5,), (12.375,), (11.999,), (-6.0,), (0.0625,)], "x double")
    assert [r[0] for r in rows.select(T.feet_inches(F.col("x"))).collect()] == ["28'-6\"", "28'-6 1/2\"", "1'-0 3/8\"", "1'-0\"", "-0'-6\"", "0'-0 1/16\""]


def test_rating_hours(spark):
    got = values(spark, T.rating_hours, "1 Hr", "1-1/2 Hr", "3/4 Hr", "1-Hour", "90 min", "1.5 hr", "NR", None)
    assert got == [1, 1.5, 0.75, 1, 1.5, 1.5, None, None]


def test_scales(spark):
    got = values(spark, T.inches_per_point, "1/8\"=1'-0\"", "1\"=20'", "1:100", "N.T.S.", "plan")
    assert got == [pytest.approx(96 / 72), pytest.approx(240 / 72), pytest.approx(100 / 72), None, None]
    assert 270 * got[0] == pytest.approx(360)


def test_phrases(spark):
    rows = spark.createDataFrame([("Unprotected Roof Deck", "Protected Roof Deck"), ("SHIELD® 400 and 300", "shield 400"), ("x", ""), ("x", None), (None, "x")], "h string, n string")
    assert [r[0] for r in rows.select(T.has_phrase(F.col("h"), F.col("n"))).collect()] == [False, True, True, True, False]


def test_restraint_and_application(spark):
    assert values(spark, T.restraint_of, "Unrestrained Beam", "RESTRAINED", "Beam", None) == ["unrestrained", "restrained", None, None]
    assert values(spark, T.application_of, "Half  Flange Tip", "contour", None) == ["half_flange_tip", "contour", "contour"]


def test_urls_and_names(spark):
    assert values(spark, T.normal_url, "HTTP://Ex.COM/A;p=1?q=1#f", "https://a/B") == ["http://ex.com/A?q=1", "https://a/B"]
    assert values(spark, T.name_key, "A b-C_1.pdf") == ["abc1pdf"]


@pytest.mark.parametrize(
    "raw,canonical",
    [("HSS6x.250", "HSS6X0.250"), ("PIPE 4 STD", "PIPE4STD"), ("W18×35", "W18X35"), ("HSS6x4x3/8", "HSS6X4X3/8"), ("2L4x4x1/4", "2L4X4X1/4"), ("16K2", "16K2"), ("40G8N12K", "40G8N12K"), ("W12x26.0", "W12X26")],
)
def test_designations(raw, canonical):
    assert designation.parse(raw)["canonical"] == canonical


def test_designations_side_by_side():
    text = "(E) W18x35, 2L 3-1/2x3x5/16 HP14×73 24 LH 08; 48G10N9.5F PIPE 6 SCH 40 HSS6X0.25 W18x .5 AW8x10"
    assert [(d["canonical"], d["family"], d["status"]) for d in designation.find(text)] == [
        ("W18X35", "W", "E"), ("2L3-1/2X3X5/16", "DOUBLE_L", None), ("HP14X73", "HP", None), ("24LH08", "JOIST", None),
        ("48G10N9.5F", "JOIST_GIRDER", None), ("PIPE6SCH40", "PIPE", None), ("HSS6X0.250", "HSS_ROUND", None),
    ]


def test_designation_doubts():
    assert designation.find("WI8x3S")[0]["canonical"] == "W18X35" and designation.find("WI8x3S")[0]["confidence"] <= 0.6
    assert designation.find("W99x5000")[0]["confidence"] <= 0.3
    assert designation.find("MAX 5x5 OPENING") == [] == designation.find("WIDTH 18") == designation.find(None)
    assert designation.find("(E) W12x26")[0]["status"] == "E"
    assert designation.parse("W12x26 and W14x30") is None


def test_designations_in_a_column(spark):
    rows = spark.createDataFrame([("W12x26, 16K2",), (None,)], "x string")
    got = [[d["canonical"] for d in r[0]] for r in rows.select(designation.designations(F.col("x"))).collect()]
    assert got == [["W12X26", "16K2"], []]


def test_geometry(spark):
    row = spark.range(1).select(
        geometry.angle_difference(F.lit(179.0), F.lit(1.0)), geometry.up_to_sixteenth(F.lit(0.5415)), geometry.up_to_sixteenth(F.lit(0.5)),
        geometry.perimeter(F.lit(12.2), F.lit(6.49), F.lit(0.23), F.lit(4)), geometry.point_segment_distance(*[F.lit(float(v)) for v in (0, 5, 1, 0, 9, 0)]),
    ).first()
    assert list(row) == [2, 0.5625, 0.5, pytest.approx(49.9), pytest.approx(26**0.5)]


def test_page_list():
    assert page_list("1,3-5") == [0, 2, 3, 4] and page_list(None) is None


def test_white_space_is_linear(spark):
    assert values(spark, T.white_space, " " * 300_000 + "a \t b") == ["a b"]


def test_extracts_and_guesses(spark):
    got = values(spark, T.extracts, "Design N782 and X701, 1-1/2 hr and 2 hour, W12x26, HSS6x4x3/8, 2019-10-09, 10/3/2013; N782", "", None)
    assert (got[0].ratings, got[0].designs, got[0].members) == (["1-1/2", "2"], ["N782", "X701"], ["HSS6x4x3/8", "W12x26"])
    assert got[0].dates == ["10/3/2013", "2019-10-09"] and got[0].years == ["2013", "2019"] and got[1].designs == []
    assert values(spark, lambda c: T.first_guess(c, {"chart": "thickness", "list": "design"}), "design thickness", "design", "x", None) == ["chart", "list", "unknown", "unknown"]


def test_names_marks_and_evidence(spark):
    assert values(spark, T.file_name, "https://h/a/My%20File.pdf?x=1", "https://h/get?file=B.pdf", "https://h") == ["My File.pdf", "B.pdf", None]
    assert values(spark, T.not_rated, " nr ", "—", "1/2", None) == [True, True, False, False]
    row = spark.range(1).select(T.evidence_text(F.lit("a.pdf"), F.lit(3), F.lit(None).cast("string"), F.lit("W12"))).first()
    assert row[0] == "a.pdf p3: W12"


def test_calibration(spark):
    n = [F.lit(float(v)) for v in (0, 0, 3, 4)]
    row = spark.range(1).select(geometry.calibrated(*n, F.lit(60.0)), geometry.calibrated(*n[:2], *n[:2], F.lit(60.0)), geometry.agrees(F.lit(270.0), F.lit(96 / 72), F.lit(360.0)), geometry.agrees(F.lit(270.0), F.lit(1.0), F.lit(None).cast("double"))).first()
    assert list(row) == [12, None, True, False]
