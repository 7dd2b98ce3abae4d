"""Charts without given heads: columns found from positions, layouts found by how well they fit a page's rows.

Positioned charts: columns are the islands of x that the cells of all rows leave, heads are joined to the columns
that they overlap, so one that stands over several is the title of a group. Charts as lines: every printed head with
every number of leading ratios is a layout; those that may hold for a run of rows compete, and the best stays.
Windows run within a document or page; pairs meet by document, page and cell of x. Positioned joins are merges: spans
are often exploded from small files, whose size would pass for that of a table to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.designation import designations
from ..functions.text import fraction, rating_hours
from ..session import checkpointed
from .takeoff import cluster_rows

#: Points: gutters of less are none, prose is longer than PROSE characters, and no thickness is greater than THICKEST inches.
GUTTER, BAND, CELL, PROSE, THICKEST = 2.0, 26.0, 64.0, 30, 5.0
RATING = r"(?i)^\d+(?:-\d+/\d+|/\d+)?\s*-?\s*(?:hr|hour|min)s?\.?$"
THICKNESS = r"(?i)^(?:\d+[ -]\d+/\d+|\d+/\d+|\d*\.\d+|\d+|N\.?R\.?|N/A|-|—|–)$"
RATIO = r"(?i)^\(?(?:W/D|A/P|M/D|Hp/A)\)?$"


def _cells(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))


def heads_of(spans: DataFrame) -> DataFrame:
    """(document, page, head_y, band_top, band_end): the first row of a page with two ratings or more, and the head band about it.

    The band reaches up by BAND points and down to the row before the first one that holds a printed number.
    """
    rating = F.col("text").rlike(RATING)
    rows = spans.groupBy("document", "page", "row_no").agg(F.count_if(rating).alias("n"), F.min("y").alias("y"), F.max("y").alias("last"), F.max(F.col("text").rlike(r"^\d") & ~rating).alias("data"))
    first = rows.filter("n >= 2").groupBy("document", "page").agg(F.min(F.struct("y", "row_no")).alias("h"))
    joined = rows.join(first.hint("merge"), ["document", "page"])
    body = F.min(F.when((F.col("row_no") > F.col("h.row_no")) & F.col("data"), F.col("y")))
    per = joined.groupBy("document", "page", F.col("h.y").alias("head_y")).agg(body.alias("body"))
    return per.select("document", "page", "head_y", (F.col("head_y") - BAND).alias("band_top"), F.coalesce(F.col("body"), F.lit(float("inf"))).alias("body_y"))


def columns_of(spans: DataFrame, heads: DataFrame) -> DataFrame:
    """(document, page, column, x0, x1, name, title, hours, kind) for the pages with heads.

    A column is an island of the x intervals of the page's data cells; a gutter of GUTTER points parts two. A head in
    the band belongs to the columns it overlaps: over one it is part of the column's name (a rating makes it a
    thickness column), over several it is their title. A column without any head keeps a null name.
    """
    near = spans.join(heads.hint("merge"), ["document", "page"])
    data = near.filter((F.col("y") >= F.col("body_y")) & (F.length("text") <= PROSE))
    order = Window.partitionBy("document", "page").orderBy("x0", "x1", "span_id")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = data.withColumn("new", (reach.isNull() | (F.col("x0") > reach + GUTTER)).cast("int")).withColumn("column", F.sum("new").over(order))
    columns = islands.groupBy("document", "page", "column").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    band = near.filter((F.col("y") >= F.col("band_top")) & (F.col("y") < F.col("body_y"))).select("document", "page", "span_id", "y", "text", F.col("x0").alias("h0"), F.col("x1").alias("h1"))
    spread = columns.withColumn("b", _cells(F.col("x0"), F.col("x1")))
    met = band.withColumn("b", _cells(F.col("h0"), F.col("h1"))).join(spread.hint("merge"), ["document", "page", "b"]).filter("h0 <= x1 and h1 >= x0").drop("b").distinct()
    # a head belongs to all columns whose middle it covers, or else to the one that it overlaps most
    covers = ((F.col("h0") <= (F.col("x0") + F.col("x1")) / 2) & (F.col("h1") >= (F.col("x0") + F.col("x1")) / 2)).cast("int")
    share = F.least("x1", "h1") - F.greatest("x0", "h0")
    by_head = Window.partitionBy("document", "page", "span_id")
    met = met.withColumns({"covers": covers, "n": F.sum(covers).over(by_head), "best": F.row_number().over(by_head.orderBy(share.desc(), "column"))}).filter((F.col("covers") == 1) | ((F.col("n") == 0) & (F.col("best") == 1)))
    words = F.array_sort(F.collect_list(F.when((F.col("n") < 2) & ~F.col("text").rlike(RATING), F.struct("y", "h0", "text"))))
    named = met.groupBy("document", "page", "column").agg(
        F.nullif(F.array_join(F.transform(words, lambda w: w["text"]), " "), F.lit("")).alias("name"),
        F.max_by(F.when(F.col("n") >= 2, F.col("text")), F.when(F.col("n") >= 2, F.col("y"))).alias("title"),
        F.min_by(F.when(F.col("text").rlike(RATING), F.col("text")), F.when(F.col("text").rlike(RATING), F.col("y"))).alias("rating"),
    )
    hours = rating_hours(F.col("rating"))
    kind = F.when(hours.isNotNull(), "thickness").when(F.col("name").rlike(RATIO), "ratio").when(F.col("name").rlike(r"(?i)\b(?:size|member|wt|dia|diameter)\b"), "label").otherwise("value")
    return columns.join(named.hint("merge"), ["document", "page", "column"], "left").select("document", "page", "column", "x0", "x1", "name", "title", hours.alias("hours"), F.coalesce(kind, F.lit("value")).alias("kind"))


def positioned_chart(spans: DataFrame) -> DataFrame:
    """Thickness cells of positioned charts, with no heads given: spans (document, page, span_id, x0, x1, y, text).

    (document, page, row_no, group_no, title, label, canonical, ratio_name, ratio, hours, as_printed, thickness_in, note). A page
    without heads takes the columns of the page with heads before it; one whose ratings differ from the document's first is left
    out. Columns from where hours restart, or a new title, are a group of their own. Label columns are joined in order of x; a row
    without a label takes its words. Cells over THICKEST inches and cells that are no thickness keep a note instead of a value.
    Prose, and pages before any heads, give no rows; an empty table gives an empty result.
    """
    rows = cluster_rows(spans.withColumn("x", F.col("x0")).withColumn("page_no", F.col("page")).withColumn("page", F.struct("document", "page_no")))
    rows = rows.drop("page", "x").withColumnRenamed("page_no", "page").filter(F.length(F.trim("text")) > 0).withColumn("text", F.trim("text"))
    rows = checkpointed(rows)  # read five times below
    heads = heads_of(rows)
    columns = checkpointed(columns_of(rows, heads))
    by_page = Window.partitionBy("document", "page").orderBy("x0")
    restart = F.coalesce((F.col("hours") <= F.lag("hours").over(by_page)) | ~F.col("title").eqNullSafe(F.lag("title").over(by_page)), F.lit(True))
    thick = columns.filter("kind = 'thickness'").withColumn("group_no", F.sum(restart.cast("int")).over(by_page)).select("document", "page", "column", "group_no")
    columns = columns.join(thick.hint("merge"), ["document", "page", "column"], "left")
    prints = columns.filter("kind = 'thickness'").groupBy("document", "page").agg(F.array_sort(F.collect_list(F.struct("x0", "hours"))).alias("h")).select("document", "page", F.transform("h", lambda h: h["hours"]).alias("h"))
    first = Window.partitionBy("document").orderBy("page")
    good = prints.withColumn("same", F.col("h") == F.first("h").over(first)).select("document", "page", "same")
    pages = rows.select("document", "page").distinct().join(good.hint("merge"), ["document", "page"], "left")
    source = F.last(F.when(F.col("same"), F.col("page")), ignorenulls=True).over(first)
    pages = pages.withColumn("source", source).filter(F.coalesce("same", F.lit(True)) & F.col("source").isNotNull()).join(heads.select("document", "page", "body_y").hint("merge"), ["document", "page"], "left")
    long = F.max(F.length("text") > PROSE).over(Window.partitionBy("document", "page", "row_no"))
    body = rows.withColumn("prose", long).filter("not prose").join(pages.hint("merge"), ["document", "page"]).filter(F.col("body_y").isNull() | (F.col("y") >= F.col("body_y")))
    spread = columns.withColumnsRenamed({"page": "source", "x0": "c0", "x1": "c1"}).withColumn("b", _cells(F.col("c0") - GUTTER, F.col("c1") + GUTTER))
    met = body.withColumn("b", _cells(F.col("x0"), F.col("x1"))).join(spread.hint("merge"), ["document", "source", "b"]).filter(f"x0 <= c1 + {GUTTER} and x1 >= c0 - {GUTTER}")
    share = F.least("x1", "c1") - F.greatest("x0", "c0")
    found = met.groupBy("document", "page", "row_no", "span_id", "x0", "text").agg(F.max_by(F.struct("column", "kind", "name", "title", "hours", "group_no"), F.struct(share, -F.col("column"))).alias("c"))
    words = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("x0", "text")))), lambda w: w["text"]), " ")
    kind = F.col("c.kind")
    ratio = F.min_by(F.when(kind == "ratio", F.struct("c.name", "text")), F.when(kind == "ratio", F.col("x0")))
    cells = F.collect_list(F.when(kind == "thickness", F.struct("c.group_no", "c.title", "c.hours", "text")))
    lines = found.groupBy("document", "page", "row_no").agg(words(kind == "label").alias("label"), words((kind == "value") & ~F.col("text").rlike(r"^[\d./ -]+$")).alias("other"), ratio.alias("r"), cells.alias("cells"))
    lines = lines.select("document", "page", "row_no", F.coalesce(F.nullif("label", F.lit("")), F.nullif("other", F.lit(""))).alias("label"), "r", F.explode("cells").alias("c"))
    rated = ~F.upper("c.text").rlike(r"^(?:N.*|-|—|–)$")
    value = F.when(F.col("c.text").rlike(THICKNESS) & rated, fraction(F.regexp_replace("c.text", r"\s+", "-")))
    note = F.when(F.col("label").isNull(), "no label").when(~F.col("c.text").rlike(THICKNESS), "not a thickness").when(~rated, "not rated").when(value > THICKEST, "too thick")
    return lines.select(
        "document", "page", "row_no", F.col("c.group_no").alias("group_no"), F.col("c.title").alias("title"), "label", F.get(designations(F.coalesce(F.regexp_replace("label", r"\s*x\s*", "X"), F.lit(""))), F.lit(0))["canonical"].alias("canonical"),
        F.col("r.name").alias("ratio_name"), F.expr("try_cast(r.text as double)").alias("ratio"), F.col("c.hours").alias("hours"), F.col("c.text").alias("as_printed"), F.when(note.isNull(), value).alias("thickness_in"), note.alias("note"),
    )


# charts as lines

_RATINGS = r"(?i)\d+(?:-\d+/\d+|/\d+)?\s*-?\s*(?:hr|hour)s?\.?"
_LABEL = r"(?i)^((?:W|HP|M|S|C|MC|WT|L|HSS|PIPE)\s*\d\S*(?:\s*x\s*[\d./-]+)*)\s+(.*)$"
MOST_RATIOS = 3


def chart_runs(lines: DataFrame, back: int = 2) -> tuple[DataFrame, DataFrame]:
    """Runs of rows with the layout that fits them best, and the rows: lines (document, page, line_no, text).

    A run is what stands between two heads or page ends. Layouts that may hold for it are the `back` heads printed before it in the
    document, on whatever page, with 0 to MOST_RATIOS ratios before the thicknesses. A layout's score is the number of rows that it
    fits: as many cells as ratios and ratings, the ratios decimals, the rest thicknesses. The number of ratios is settled for each
    head by all rows down to the next head, so that a few rows behind a page end do not change it; then the heads compete for
    each run. Ties go to the nearer head, then to fewer ratios.

    runs: document, page, run, kind (`table` under a head of its page, `continued` under an earlier one, `cross_reference` where
    no rows but designs to use stand, `no_rows`), head_page, ratings, ratios, fits, rows, targets. rows: document, page, line_no, run, label,
    canonical, ratios, hours, as_printed, thickness_in, note; a row that the layout does not fit, or before any head, has a note and no value.
    """
    w = Window.partitionBy("document").orderBy("page", "line_no")
    ratings = F.regexp_extract_all("text", F.lit(_RATINGS), F.lit(0))
    df = lines.filter(F.trim("text") != "").withColumn("text", F.trim("text")).withColumn("head", F.when(F.size(ratings) >= 2, F.transform(ratings, rating_hours)))
    new = F.col("head").isNotNull() | ~F.coalesce(F.col("page") == F.lag("page").over(w), F.lit(False))
    df = df.withColumns({"run": F.sum(new.cast("int")).over(w), "heads": F.count("head").over(w)})
    heads = df.filter("head is not null").select("document", F.col("heads").alias("head_no"), F.col("page").alias("head_page"), F.col("head").alias("ratings"))
    label, rest = F.regexp_extract("text", _LABEL, 1), F.regexp_extract("text", _LABEL, 2)
    rows = df.filter(F.col("head").isNull() & (label != "")).select("document", "page", "run", "line_no", "heads", label.alias("label"), F.split(rest, r"\s+").alias("cells"))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(back - 1))).alias("far")).withColumn("head_no", F.col("heads") - F.col("far"))
    tried = each.join(heads, ["document", "head_no"]).select("*", F.explode(F.sequence(F.lit(0), F.lit(MOST_RATIOS))).alias("ratios"))
    shape = F.expr("size(cells) = ratios + size(ratings) and forall(slice(cells, 1, ratios), c -> c rlike '^[0-9]*[.][0-9]+$')")
    thick = F.forall(F.slice("cells", F.col("ratios") + 1, F.size("ratings")), lambda c: c.rlike(THICKNESS))
    scored = tried.groupBy("document", "page", "run", "head_no", "far", "head_page", "ratings", "ratios").agg(F.count_if(shape & thick).alias("fits"), F.count("*").alias("rows"))
    total = scored.groupBy("document", "head_no", "ratios").agg(F.sum(F.when(F.col("far") == 0, F.col("fits")).otherwise(0)).alias("total"))
    settled = total.groupBy("document", "head_no").agg((-F.max(F.struct("total", (-F.col("ratios")).alias("few")))["few"]).alias("ratios"))
    scored = scored.join(settled, ["document", "head_no", "ratios"])
    kept = scored.groupBy("document", "page", "run").agg(F.max(F.struct("fits", (-F.col("far")).alias("near"), (-F.col("ratios")).alias("few"), "head_page", "ratings", "ratios", "rows")).alias("k"))
    kept = kept.select("document", "page", "run", "k.head_page", "k.ratings", "k.ratios", "k.fits", "k.rows")
    targets = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("text", F.lit(r"(?i)\b(?:use|see|refer to)\s+(?:[a-z]+\s+)*?(?:design\s+)?(?:no\.\s*)?([A-Z]{1,2}\d{3})\b"), F.lit(1))))))
    runs = df.groupBy("document", "page", "run").agg(targets.alias("targets")).join(kept, ["document", "page", "run"], "left")
    kind = F.when(F.col("fits").isNull(), F.when(F.size("targets") > 0, "cross_reference").otherwise("no_rows")).when(F.col("head_page") == F.col("page"), "table").otherwise("continued")
    runs = runs.select("document", "page", "run", kind.alias("kind"), "head_page", "ratings", "ratios", "fits", "rows", "targets")
    placed = rows.join(kept.select("document", "page", "run", "ratings", "ratios"), ["document", "page", "run"], "left")
    right = placed.withColumn("right", F.coalesce(shape & thick, F.lit(False)))
    pair = F.arrays_zip(F.col("ratings").alias("hours"), F.slice("cells", F.col("ratios") + 1, F.size("ratings")).alias("printed"))
    none = F.array(F.struct(F.lit(None).cast("double").alias("hours"), F.lit(None).cast("string").alias("printed")))
    tidy = right.select("*", F.explode(F.when(F.col("right"), pair).otherwise(none)).alias("z"))
    value = F.when(~F.upper("z.printed").rlike(r"^(?:N.*|-|—|–)$"), fraction(F.col("z.printed")))
    note = F.when(F.col("ratings").isNull(), "no head before").when(~F.col("right"), "cells do not fit the layout").when(value.isNull(), "not rated")
    leads = F.when(F.col("right"), F.transform(F.slice("cells", 1, F.col("ratios")), lambda c: c.cast("double")))
    cells = tidy.select("document", "page", "line_no", "run", "label", F.get(designations(F.col("label")), F.lit(0))["canonical"].alias("canonical"), leads.alias("ratios"), F.col("z.hours").alias("hours"), F.col("z.printed").alias("as_printed"), value.alias("thickness_in"), note.alias("note"))
    return runs, cells
