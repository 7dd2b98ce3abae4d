"""Printed documents as tables: lines of charts and listings, positioned spans, legends.

A line's context (rating header, section, family) is carried down by windows over a document's lines, so a
document needs no state machine and documents run in parallel. What does not parse stays out, with a note where
a row was expected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.designation import designations
from ..functions.text import fraction, rating_hours

_RATING = r"(?i)\d+(?:-\d+/\d+|/\d+|\.\d+)?\s*-?\s*(?:hr|hour)s?\.?"
_CELL = r"(?:\d+-\d+/\d+|\d+/\d+|\d*\.\d+|\d+|NR)"
_ROW = rf"(?i)^\s*((?:W|HP|M|S|C|MC|WT|L|HSS|PIPE)\s*\d[^\s]*(?:\s*x\s*[\d./-]+)*)\s+(\d*\.\d+)\s+({_CELL}(?:\s+{_CELL})*)\s*$"


def _carried(lines: DataFrame, column: Column, name: str) -> DataFrame:
    w = Window.partitionBy("document").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(column, ignorenulls=True).over(w))


def chart_rows(lines: DataFrame) -> DataFrame:
    """Cells of chart text (document, line_no, text): label, canonical, ratio, hours, thickness, printed, section.

    A line of two or more ratings is the header of the rows below it; 'Restrained' or 'Unrestrained' lines mark
    sections. A row with more or fewer cells than its header gives one row with a note and no thickness.
    """
    ratings = F.regexp_extract_all("text", F.lit(_RATING), F.lit(0))
    section = F.regexp_extract("text", r"(?i)^\s*((?:un)?restrained(?:\s+\w+)?)\s*$", 1)
    df = _carried(lines, F.when(F.size(ratings) >= 2, ratings), "header")
    df = _carried(df, F.when(section != "", section), "section")
    cells = F.split(F.trim(F.regexp_extract("text", _ROW, 3)), r"\s+")
    rows = df.filter(F.col("text").rlike(_ROW) & F.col("header").isNotNull()).select(
        "document", "line_no", "section", F.regexp_extract("text", _ROW, 1).alias("label"), F.regexp_extract("text", _ROW, 2).cast("double").alias("ratio"), cells.alias("cells"), "header"
    )
    fits = F.size("cells") == F.size("header")
    tidy = rows.select("document", "line_no", "section", "label", "ratio", F.explode(F.when(fits, F.arrays_zip(F.col("header").alias("rating"), F.col("cells").alias("printed"))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("rating"), F.lit(None).cast("string").alias("printed"))))).alias("z"))
    value = F.when(F.upper("z.printed") != "NR", fraction(F.col("z.printed")))
    out = tidy.select(
        "document", "line_no", "section", "label", "ratio", rating_hours(F.col("z.rating")).alias("hours"), value.alias("thickness_in"), F.col("z.printed").alias("as_printed"),
        F.when(F.col("z.rating").isNull(), "cells do not fit the header").when(F.upper("z.printed") == "NR", "not rated").alias("note"),
    )
    return out.withColumn("canonical", F.get(designations(F.col("label")), F.lit(0))["canonical"])


_LABEL = r"(?i)^\*?\s*(?:W|HP|M|S|C|MC|WT|L|HSS|PIPE)\s*\d\S*(?:\s*x\s*[\d./-]+)*$"
_OPEN_LABEL = r"(?i)^(?:W|HP|M|S|C|MC|WT)\s*\d+\s*x$"
_RATIO_NAME = r"(?i)^\(?(?:W/D|A/P|M/D|Hp/A)\)?$"


def listing_cells(lines: DataFrame) -> DataFrame:
    """Thickness cells of listing text that prints one cell a line (document, line_no, text).

    A head is a run of lines that are neither sizes nor numbers; its ratings are the columns of the rows below it, up
    to the next head. Three kinds of rows: `size_wd`, a size, its ratio if printed, and a value for each rating;
    `ratio_rows`, a ratio and the values, where the head names a ratio and no size is printed; `rating_rows`, the
    head's ratings and the values under them, numbered by value_no. A size broken after its x is joined again. The
    last unit and restraint printed hold until the next: mils become inches, millimetres stay null. A row with more
    or fewer values than ratings gives one row with a note. Empty and null lines are left out; numbers under a head
    without ratings are no rows.
    """
    w = Window.partitionBy("document").orderBy("line_no")
    t = F.col("t")
    df = lines.select("document", "line_no", F.trim("text").alias("t")).filter("t <> ''")
    df = df.withColumns({"after": F.lead("t").over(w), "before": F.coalesce(F.lag("t").over(w), F.lit(""))})
    df = df.filter(~(F.col("before").rlike(_OPEN_LABEL) & t.rlike(r"^\d{1,4}$")))
    df = df.withColumn("t", F.when(t.rlike(_OPEN_LABEL) & F.col("after").rlike(r"^\d{1,4}$"), F.concat("t", "after")).otherwise(t))
    kind = (
        F.when(t.rlike(_LABEL), "label").when(t.rlike(rf"^(?:{_RATING})$"), "rating").when(t.rlike(rf"(?i)^{_CELL}[*+#]*$"), "cell").when(t.rlike(_RATIO_NAME), "ratio").otherwise("other")
    )
    df = df.select("document", "line_no", "t", kind.alias("kind"))
    unit = F.when(t.rlike(r"(?i)\bmils\b"), "mils").when(t.rlike(r"(?i)\bmm\b"), "mm").when(t.rlike(r"(?i)\bin(?:ch|ches)?\b"), "in")
    df = _carried(df, F.when(F.col("kind").isin("other", "ratio", "rating"), unit), "units")
    df = _carried(df, F.when(F.col("kind") == "other", F.nullif(F.regexp_extract("t", r"(?i)\b((?:un)?restrained)\b", 1), F.lit(""))), "condition")
    in_body = F.col("kind").isin("cell", "label")
    opens = ~in_body & F.coalesce(F.lag(in_body).over(w), F.lit(True))
    df = df.withColumn("opens", opens.cast("int")).withColumn("head", F.sum("opens").over(w))
    whole = Window.partitionBy("document", "head")
    printed = F.array_sort(F.collect_list(F.when(F.col("kind") == "rating", F.struct("line_no", rating_hours(t).alias("hours")))).over(whole))
    df = df.withColumns({"ratings": F.transform(printed, lambda x: x["hours"]), "declared": F.max(F.col("kind") == "ratio").over(whole)})
    inside = Window.partitionBy("document", "head").orderBy("line_no")
    body = df.filter(F.col("kind").isin("cell", "label") & (F.size("ratings") > 0))
    body = body.withColumns({"size_no": F.count_if(F.col("kind") == "label").over(inside), "place": F.row_number().over(inside) - 1})
    row = F.when((F.col("size_no") == 0) & F.col("declared"), F.floor(F.col("place") / (F.size("ratings") + 1))).otherwise(0)
    cells = F.array_sort(F.collect_list(F.when(F.col("kind") == "cell", F.struct("line_no", "t"))))
    rows = body.groupBy("document", "head", "size_no", row.alias("row")).agg(
        F.min("line_no").alias("line_no"), F.max(F.when(F.col("kind") == "label", F.col("t"))).alias("label"), F.transform(cells, lambda x: x["t"]).alias("cells"),
        F.first("ratings").alias("ratings"), F.first("declared").alias("declared"), F.first("units").alias("units"), F.first("condition").alias("condition"),
    )
    n, got = F.size("ratings"), F.size("cells")
    table = F.when(F.col("size_no") > 0, "size_wd").when(F.col("declared"), "ratio_rows").otherwise("rating_rows")
    rows = rows.withColumn("kind", table).withColumn("with_ratio", (F.col("kind") != "rating_rows") & (got == n + 1))
    fits = F.when(F.col("kind") == "size_wd", got.isin(n, n + 1)).when(F.col("kind") == "ratio_rows", got == n + 1).otherwise(True)
    rows = rows.withColumn("values", F.when(F.col("with_ratio"), F.slice("cells", F.lit(2), n)).otherwise(F.col("cells")))
    pair = lambda hours, value, no: F.struct(hours.alias("hours"), value.alias("printed"), no.cast("int").alias("value_no"))
    by_column = F.transform("values", lambda v, k: pair(F.get("ratings", k), v, F.lit(None)))
    by_rating = F.flatten(F.transform("ratings", lambda h: F.transform("values", lambda v, k: pair(h, v, k + 1))))
    unread = F.array(pair(F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None)))
    tidy = rows.withColumn("z", F.explode(F.when(~fits, unread).when(F.col("kind") == "rating_rows", by_rating).otherwise(by_column)))
    value = fraction(F.regexp_replace("z.printed", r"[*+#]+$", ""))
    inches = F.when(F.col("units") == "mils", value / 1000).when(F.coalesce("units", F.lit("in")) == "in", value)
    note = F.when(F.col("z.printed").isNull(), "cells do not fit the header").when(F.col("z.printed").rlike(r"(?i)^NR"), "not rated").when(F.col("z.printed").rlike(r"[*+#]$") | F.col("label").startswith("*"), "marked")
    return tidy.select(
        "document", "line_no", "kind", F.regexp_replace("label", r"^\*\s*", "").alias("label"), F.get(designations(F.coalesce("label", F.lit(""))), F.lit(0))["canonical"].alias("canonical"),
        F.when(F.col("with_ratio"), F.expr("try_cast(cells[0] as double)")).alias("ratio"), F.col("z.hours").alias("hours"), F.col("z.value_no").alias("value_no"),
        F.col("z.printed").alias("as_printed"), inches.alias("thickness_in"), "units", F.lower("condition").alias("condition"), note.alias("note"),
    )


_X = r"(?:\(?\s*W/D\s*\)?|\(?\s*A/P\s*\)?|\(?\s*M/D\s*\)?)"
_NUM = r"(\d*\.?\d+)"
_FORMS = {
    "h = R / (a*X + b)": (rf"(?i)h\s*=\s*R\s*/\s*[\[(]\s*{_NUM}\s*\*?\s*{_X}\s*([+-])\s*{_NUM}\s*[\])]", ("a", "sign", "b")),
    "T = k / (X)": (rf"(?i)\bT\s*=\s*{_NUM}\s*/\s*{_X}", ("k",)),
    "h = (R - c) / (k*X)": (rf"(?i)h\s*=\s*\(\s*R\s*-\s*{_NUM}\s*\)\s*/\s*\(?\s*{_NUM}\s*\*?\s*{_X}", ("c", "k")),
    "T = a*(X) + b": (rf"(?i)\bT\s*=\s*{_NUM}\s*\*?\s*{_X}\s*([+-])\s*{_NUM}", ("a", "sign", "b")),
}


def listing_equations(texts: DataFrame) -> DataFrame:
    """Equations that a listing (design, text) prints: form, factor, constants a, b, k, c, and the wording."""
    out = None
    for form, (pattern, names) in _FORMS.items():
        found = texts.select("design", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("as_printed"))
        part = {n: F.regexp_extract("as_printed", pattern, k + 1) for k, n in enumerate(names)}
        sign = F.when(part["sign"] == "-", -1).otherwise(1) if "sign" in part else F.lit(1)
        number = lambda n, part=part, sign=sign: (part[n].cast("double") * (sign if n == "b" else 1)) if n in part else F.lit(None).cast("double")
        rows = found.select("design", F.lit(form).alias("form"), F.upper(F.regexp_extract("as_printed", r"(?i)([WAM]/[DP])", 1)).alias("factor"), *[number(n).alias(n) for n in "abkc"], "as_printed")
        out = rows if out is None else out.unionByName(rows)
    return out


def listing_header(texts: DataFrame) -> DataFrame:
    """Design number, ratings in hours and date of each listing (document, text)."""
    ratings = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(_RATING), F.lit(0))), lambda x: rating_hours(x))
    return texts.select(
        "document",
        F.nullif(F.regexp_extract("text", r"(?i)design\s+no\.?\s*([A-Z]\d{3})", 1), F.lit("")).alias("design"),
        F.array_sort(F.array_distinct(F.array_compact(ratings))).alias("hours"),
        F.nullif(F.regexp_extract("text", r"(?i)last\s+updated(?:\s+on)?:?\s*(\d{4}-\d{2}-\d{2}|\w+ \d{1,2}, \d{4})", 1), F.lit("")).alias("last_updated"),
    )


def positioned_cells(spans: DataFrame, heads: DataFrame, reach: float = 24.0) -> DataFrame:
    """Spans of a positioned table with the head (page, head, x) nearest in x within reach; others keep a null.

    Heads are spread over buckets of x, so a span meets only those near it.
    """
    cell = reach * 2
    h = heads.select("page", "head", F.col("x").alias("hx")).withColumn("b", F.explode(F.sequence(F.floor((F.col("hx") - reach) / cell), F.floor((F.col("hx") + reach) / cell))))
    s = spans.withColumn("b", F.floor(F.col("x") / cell))
    off = F.abs(F.col("x") - F.col("hx"))
    near = s.join(h, ["page", "b"]).filter(off <= reach).groupBy("span_id").agg(F.min(F.struct(off.alias("off"), "hx", "head")).alias("m"))
    return spans.join(near, "span_id", "left").withColumn("head", F.col("m.head")).drop("m")


def legend_rows(lines: DataFrame) -> DataFrame:
    """Legend descriptions as role, sides, joist depth and code tokens."""
    t = F.upper("text")
    role = (
        F.when(t.rlike(r"\bCOL(UMN)?S?\b"), "column").when(t.rlike(r"\bJOISTS?\b"), "joist").when(t.rlike(r"\bPRIMARY\b"), "primary_beam").when(t.rlike(r"\bSECONDARY\b"), "secondary_beam")
        .when(t.rlike(r"\bDECK\b"), "deck").when(t.rlike(r"\bBRIDGING\b"), "bridging").when(t.rlike(r"\b(HSS|TUBE)\b"), "hss").when(t.rlike(r"\bANGLE\b"), "angle").when(t.rlike(r"\bBEAMS?\b"), "beam").otherwise("other")
    )
    sides = F.nullif(F.regexp_extract(t, r"\b([34])[ -]?SIDED?\b", 1), F.lit("")).cast("int")
    depth = F.nullif(F.regexp_extract(t, r"\b(\d{2})(?:\"| IN\b)?\s*(?:DEEP\s+)?JOIST", 1), F.lit("")).cast("double")
    tokens = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(NW|LW|P/T|C)\b"), F.lit(1)))
    return lines.select("*", role.alias("role"), sides.alias("sides"), depth.alias("joist_depth_in"), tokens.alias("design_tokens"))


def long_workbook(rows: DataFrame, keys: list[str], design_index: DataFrame | None = None) -> DataFrame:
    """A long thickness sheet (keys, product, variant, rating, mils as text) as tidy rows with the design.

    The design comes from the index by product and variant, else by product. 'NR' and dashes are not rated.
    """
    mils = F.expr("try_cast(mils as double)")
    tidy = rows.withColumns({"hours": rating_hours(F.col("rating")), "not_rated": F.upper(F.trim("mils")).isin("NR", "N/R", "-", "–", "—"), "thickness_mils": mils}).filter("hours is not null and (thickness_mils is not null or not_rated)")
    if design_index is not None:
        key = lambda *c: F.regexp_replace(F.lower(F.concat_ws("", *c)), "[^a-z0-9]", "")
        exact = design_index.filter("variant is not null").select(key("product", "variant").alias("k1"), F.col("design").alias("d1")).dropDuplicates(["k1"])
        loose = design_index.filter("variant is null").select(key("product").alias("k2"), F.col("design").alias("d2")).dropDuplicates(["k2"])
        tidy = tidy.withColumns({"k1": key("product", "variant"), "k2": key("product")}).join(exact, "k1", "left").join(loose, "k2", "left")
        tidy = tidy.withColumn("design", F.coalesce("d1", "d2")).drop("k1", "k2", "d1", "d2")
        keys = [*keys, "design"]
    return tidy.select(*keys, "product", "variant", "hours", "thickness_mils", "not_rated")
