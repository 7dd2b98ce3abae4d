"""Takeoff operators: labels, chains and their association, summaries.

Geometry is keyed by page; joins are equi-joins on page and coordinate buckets with range conditions on top, so
no page is paired with itself in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import confidence, spaced
from . import greedy


def validate_labels(labels: DataFrame, shapes: DataFrame | None) -> DataFrame:
    """Adds `validated` and adjusts `confidence`: +0.03 (1 at most) for a listed shape, 0.5 at most otherwise."""
    if shapes is None:
        return labels.withColumn("validated", F.lit(False)).withColumn("confidence", F.least("confidence", F.lit(0.9)))
    known = shapes.select(F.upper("label").alias("_label")).distinct()
    joined = labels.join(known, F.upper("canonical_section") == F.col("_label"), "left")
    hit = F.col("_label").isNotNull()
    return joined.withColumn("validated", hit).withColumn("confidence", F.when(hit, F.least(F.col("confidence") + 0.03, F.lit(1.0))).otherwise(F.least("confidence", F.lit(0.5)))).drop("_label")


def status_color(members: DataFrame) -> DataFrame:
    """gray: excluded, red: conflict, green: accepted or sure in all three respects, yellow: the rest."""
    sure = F.least("confidence_id", "confidence_geom", "confidence_length") >= 0.8
    color = F.when(F.col("review_state") == "excluded", "gray").when(F.col("review_state") == "conflict", "red").when((F.col("review_state") == "accepted") | sure, "green").otherwise("yellow")
    return members.withColumn("color", color).withColumn("needs_review", F.col("color").isin("yellow", "red"))


def summary(members: DataFrame, with_excluded: bool = False) -> DataFrame:
    """Counts and feet by level and section; an unknown length is counted, never taken as 0."""
    rows = members if with_excluded else members.filter(F.coalesce("review_state", F.lit("")) != "excluded")
    return rows.groupBy("level", "canonical_section").agg(
        F.count("*").alias("n"),
        F.count("length_in").alias("n_with_length"),
        (F.coalesce(F.sum("length_in"), F.lit(0.0)) / 12).alias("total_lf"),
        (F.count("*") - F.count("length_in")).alias("unknown_lengths"),
        F.count_if(F.col("needs_review")).alias("needs_review"),
    )


def top_groups(rows: DataFrame, by: list[str], most: int = 40) -> DataFrame:
    """The `most` largest groups, ties by name (a top-k report)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(most)


def merge_chains(segments: DataFrame, gap: float = 1.5) -> DataFrame:
    """Collinear segments of a page, offset and dash as chains: islands of overlaps or gaps up to `gap`.

    Offsets within a chain are equal here, so the running end of the earlier segments tells where one begins.
    """
    line = Window.partitionBy("page", "y", "dashed").orderBy("x0", "x1")
    before = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    starts = segments.withColumn("starts", F.when(before.isNull() | (F.col("x0") > before + gap), 1).otherwise(0))
    island = starts.withColumn("island", F.sum("starts").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("page", "y", "dashed", "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("pieces")).withColumn("chain_length", F.col("x1") - F.col("x0"))


def associate(spans: DataFrame, chains: DataFrame, cell: float = 32.0) -> DataFrame:
    """Each label with its nearest parallel line: offset up to max(10, 2.5 size), 15 % beyond its ends at most.

    Chains are spread over buckets of `cell` points along, labels over the buckets across that they reach, so a label of
    any size meets each chain once. The nearest chain wins (the lower, longer, earlier one on a tie); `competing` counts the
    others; a label without a line keeps a row.
    """
    reach = F.greatest(F.lit(10.0), 2.5 * F.col("size"))
    length = F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-9))
    c = chains.withColumn("bx", F.explode(F.sequence(F.floor((F.col("x0") - 0.15 * length) / cell), F.floor((F.col("x1") + 0.15 * length) / cell))))
    c = c.withColumn("by", F.floor(F.col("y") / cell)).withColumnRenamed("y", "cy")
    s = spans.withColumn("bx", F.floor(F.col("x") / cell)).withColumn("by", F.explode(F.sequence(F.floor((F.col("y") - reach) / cell), F.floor((F.col("y") + reach) / cell))))
    t = (F.col("x") - F.col("x0")) / length
    off = F.abs(F.col("y") - F.col("cy"))
    near = s.join(c, ["page", "bx", "by"]).filter((off <= reach) & (t >= -0.15) & (t <= 1.15))
    best = near.groupBy("span_id").agg(F.min(F.struct(off.alias("off"), F.col("cy").alias("cy"), "x0", "x1", "dashed")).alias("b"), F.count("*").alias("hits"))
    joined = spans.join(best, "span_id", "left")
    competing = F.coalesce(F.col("hits") - 1, F.lit(0))
    return joined.select(
        "span_id", "page", F.col("b.cy").alias("line_y"), F.col("b.x0").alias("line_x0"), F.col("b.x1").alias("line_x1"), competing.alias("competing"),
        confidence(F.col("b").isNotNull(), competing, F.col("b.off") > 0.6 * reach, F.coalesce("b.dashed", F.lit(False))).alias("confidence"),
    )


def nearest_grid(points: DataFrame, grids: DataFrame, reach: float = 12.0) -> DataFrame:
    """Nearest grid line of each axis within reach, letters first: 'C/5'; points without one keep a null."""
    cell = reach * 2
    g = grids.select("page", "axis", "coord", "label").withColumn("b", F.explode(F.sequence(F.floor((F.col("coord") - reach) / cell), F.floor((F.col("coord") + reach) / cell))))
    sides = [points.select("span_id", "page", F.lit(a).alias("axis"), F.col(c).alias("at")) for a, c in (("v", "x"), ("h", "y"))]
    p = sides[0].unionByName(sides[1]).withColumn("b", F.floor(F.col("at") / cell))
    off = F.abs(F.col("at") - F.col("coord"))
    hit = p.join(g, ["page", "axis", "b"]).filter(off <= reach).groupBy("span_id", "axis").agg(F.min(F.struct(off.alias("off"), "coord", "label")).alias("g"))
    named = hit.groupBy("span_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct(F.col("g.label").rlike("^[0-9]").alias("digit"), F.col("g.label").alias("label")))).getField("label"), "/").alias("grid"))
    return points.select("span_id").join(named, "span_id", "left")


def column_stacks(spans: DataFrame, pitch: float = 3.0, least: int = 3) -> DataFrame:
    """Left-aligned stacks: labels of a page and x bucket whose gaps are up to `pitch` times the size, in runs of `least`."""
    stack = Window.partitionBy("page", "bucket").orderBy("y", "span_id")
    rows = spans.withColumn("bucket", F.floor(F.col("x") / 2))
    gap = F.col("y") - F.lag("y").over(stack)
    size = F.greatest("size", F.lag("size").over(stack))
    rows = rows.withColumn("run", F.when(gap <= pitch * size, 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("run").over(stack.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("in_run", F.count("*").over(Window.partitionBy("page", "bucket", "run"))).withColumn("stacked", F.col("in_run") >= least).select("span_id", "page", "bucket", "run", "in_run", "stacked")


def cluster_rows(spans: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Text rows of a page: a new row begins where y is more than `tolerance` below the last span."""
    w = Window.partitionBy("page").orderBy("y", "x", "span_id")
    rows = spans.withColumn("new", F.when(F.col("y") - F.lag("y").over(w) <= tolerance, 0).otherwise(1))
    return rows.withColumn("row_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def cluster_rows_from_first(spans: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """As `cluster_rows`, but measured from the row's first span: a page's distinct ys are gone through once."""
    starts = spans.groupBy("page").agg(F.array_sort(F.collect_set("y")).alias("ys")).select("page", F.explode(spaced(F.col("ys"), F.lit(float(tolerance)), True)).alias("y"), F.lit(1).alias("first"))
    w = Window.partitionBy("page").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    numbered = spans.select("page", "y").distinct().join(starts, ["page", "y"], "left").withColumn("row_no", F.count("first").over(w).cast("int")).drop("first")
    return spans.join(numbered, ["page", "y"])


def forward_fill(rows: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """Each row with the last value of `column` at or before it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(f"{column}_filled", F.last(column, ignorenulls=True).over(w))


def split_at_cuts(chains: DataFrame, cuts: DataFrame, least: float = 6.0) -> DataFrame:
    """Chains cut at points along them; a cut that would leave a piece shorter than `least` is passed over."""
    key = ["page", "y", "dashed", "x0", "x1"]
    cells = F.sequence(F.floor(F.col("x0") / 256), F.floor(F.col("x1") / 256))
    # a chain goes through the cuts once: of each cell it takes those within it, and its cells are put together again
    spread = chains.select(*key, F.posexplode_outer(cells).alias("part", "b"))
    at = cuts.groupBy("page", "y", F.floor(F.col("x") / 256).alias("b")).agg(F.collect_set("x").alias("at"))
    within = F.filter(F.coalesce("at", F.array().cast("array<double>")), lambda c: (c > F.col("x0")) & (c < F.col("x1")))
    parts = spread.join(at, ["page", "y", "b"], "left").select(*key, F.coalesce("part", F.lit(0)).alias("part"), within.alias("cuts"))
    # most chains lie in one cell, which is all of them
    alone = F.floor(F.col("x0") / 256).eqNullSafe(F.floor(F.col("x1") / 256))
    wide = parts.filter(~alone).groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("cuts"))).alias("cuts"), F.count_if(F.col("part") == 0).alias("copies"))
    wide = wide.select(*key, "cuts", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
    joined = parts.filter(alone).select(*key, "cuts").unionByName(wide)
    room = F.filter(F.array_sort("cuts"), lambda c: F.col("x1") - c >= least)
    keep = spaced(F.concat(F.array("x0"), room), F.lit(float(least)))
    ends = joined.withColumn("starts", keep)
    return ends.select(*key, F.posexplode(F.arrays_zip(F.col("starts").alias("p0"), F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("x1")).alias("p1"))).alias("piece", "z")).select(*key, "piece", F.col("z.p0").alias("p0"), F.col("z.p1").alias("p1"))


def nearest_mark(spans: DataFrame, marks: DataFrame, tolerance: float) -> DataFrame:
    """Each span with the mark of its page nearest in y within `tolerance`; the earlier mark on a tie.

    Places (page, y) are looked up once, between the next marks below and above in their cell, so no place is paired with all marks about it.
    """
    cell = tolerance * 2
    first = marks.groupBy("page", F.col("y").alias("at")).agg(F.min("mark_id").alias("mark_id")).filter("at is not null")
    m = first.withColumn("b", F.explode(F.sequence(F.floor((F.col("at") - tolerance) / cell), F.floor((F.col("at") + tolerance) / cell))))
    p = spans.select("page", F.col("y").alias("at")).distinct().filter("at is not null").withColumn("b", F.floor(F.col("at") / cell))
    rows = m.select("page", "b", "at", F.lit(0).alias("asks"), F.struct(F.col("at").alias("my"), "mark_id").alias("m")).unionByName(p.select("page", "b", "at", F.lit(1).alias("asks")), allowMissingColumns=True)
    next_of = lambda *order: F.last("m", ignorenulls=True).over(Window.partitionBy("page", "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sides = rows.select("page", "at", "asks", next_of("at", "asks").alias("below"), next_of(F.desc("at"), "asks").alias("above")).filter("asks = 1")
    reach = lambda side: F.when(F.abs(F.col("at") - F.col(f"{side}.my")) <= tolerance, F.struct(F.abs(F.col("at") - F.col(f"{side}.my")).alias("off"), F.col(f"{side}.mark_id").alias("mark_id")))
    found = sides.select("page", F.col("at").alias("y"), F.least(reach("below"), reach("above")).alias("m"))
    return spans.join(found, ["page", "y"], "left").select("span_id", "page", F.col("m.mark_id").alias("mark_id"), F.col("m.off").alias("off"))


def reused_marks(items: DataFrame) -> DataFrame:
    """Items whose value or sides differ from those of the first item of the same mark."""
    w = Window.partitionBy("mark").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.struct("value", "sides")).over(w)
    return items.withColumn("f", first).filter(~F.col("f.value").eqNullSafe(F.col("value")) | ~F.col("f.sides").eqNullSafe(F.col("sides"))).select("mark", "seq", "value", "sides", F.col("f.value").alias("first_value"), F.col("f.sides").alias("first_sides"))


def same_members(members: DataFrame, reach: float = 2.0) -> DataFrame:
    """(page, section, seq, kept): for each member the first one kept, in `seq` order, of its page and section with all four coordinates within `reach`.

    A member that none kept before is near is kept itself. The rule is sequential; it runs by itself in each island of
    members that a gap of more than `reach` parts from the others, and in time linear in the members. Members without a coordinate are kept.
    """
    places = ["x0", "y0", "x1", "y1"]
    whole = F.forall(F.array(*places), lambda v: v.isNotNull())
    rows = members.select(F.col("page").cast("long").alias("page"), F.col("section").cast("string").alias("section"), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in places])
    parted = greedy.islands(rows.filter(whole), ["page", "section"], places, reach).select("page", "section", "island", "seq", *places)
    found = greedy.streamed(parted, ["page", "section", "island"], ["seq"], lambda: greedy.FirstWithin(reach, 4), [("page", "long"), ("section", "string"), ("seq", "long"), ("kept", "long")])
    return found.unionByName(rows.filter(~whole).select("page", "section", "seq", F.col("seq").alias("kept")))


def merge_same_members(members: DataFrame, reach: float = 2.0) -> DataFrame:
    """The members that `same_members` keeps, with n_merged and, where members have `evidence` (an array), that of all merged ones, in seq order."""
    columns = ["page", "section", "seq", "x0", "y0", "x1", "y1"]
    pairs = same_members(members, reach)
    if "evidence" not in members.columns:
        counted = pairs.groupBy("page", "section", F.col("kept").alias("seq")).agg((F.count("*") - 1).alias("n_merged"))
        return members.select(*columns).join(counted, ["page", "section", "seq"])
    own = members.select("page", "section", "seq", "evidence").join(pairs, ["page", "section", "seq"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda x: F.coalesce(x["evidence"], F.array().cast(members.schema["evidence"].dataType)))
    counted = own.groupBy("page", "section", F.col("kept").alias("seq")).agg((F.count("*") - 1).alias("n_merged"), F.flatten(listed).alias("evidence"))
    return members.select(*columns).join(counted, ["page", "section", "seq"])


def sheet_level(spans: DataFrame) -> DataFrame:
    """Level of each page: the first level text in the title block (0.85), else the first anywhere (0.6)."""
    level = F.regexp_extract(F.upper("text"), r"\b(LEVEL\s+\d+|ROOF|MEZZANINE|BASEMENT)\b", 1)
    block = (F.col("x") > 0.78 * F.col("width")) | (F.col("y") > 0.85 * F.col("height"))
    found = spans.withColumn("level", level).filter("level <> ''").groupBy("page").agg(F.min(F.struct((~block).alias("outside"), "span_id", "level")).alias("l"))
    return found.select("page", F.col("l.level").alias("level"), F.when(F.col("l.outside"), 0.6).otherwise(0.85).alias("confidence"))


def sheet_number(spans: DataFrame) -> DataFrame:
    """Sheet number of each page: the largest match in the title block, the first on a tie."""
    block = (F.col("x") > 0.78 * F.col("width")) | (F.col("y") > 0.85 * F.col("height"))
    number = F.regexp_extract("text", r"^\s*([A-Z]{1,2}-?\d{1,3}(?:\.\d{1,2})?)\s*$", 1)
    found = spans.withColumn("sheet", number).filter(block & (F.col("sheet") != "")).groupBy("page").agg(F.min(F.struct((-F.col("size")).alias("s"), "span_id", "sheet")).alias("b"))
    return found.select("page", F.col("b.sheet").alias("sheet"))


def synthetic_members(spark, bays_x: int = 4, bays_y: int = 3, bay_in: float = 360.0) -> DataFrame:
    """A regular frame by `range` cross products: girders along x, beams along y; an exact answer key."""
    xs, ys = (spark.range(n).select(F.col("id").alias(c)) for n, c in ((bays_x + 1, "i"), (bays_y + 1, "j")))
    nodes = xs.join(ys)
    girders = nodes.filter(F.col("i") < bays_x).select("i", "j", F.lit("girder").alias("role"), F.lit(bay_in).alias("length_in"))
    beams = nodes.filter(F.col("j") < bays_y).select("i", "j", F.lit("beam").alias("role"), F.lit(bay_in).alias("length_in"))
    return girders.unionByName(beams)


def line_text(spans: DataFrame) -> DataFrame:
    """Text of each printed line (page, block, line), its spans in order."""
    parts = F.array_sort(F.collect_list(F.struct("x", "span_id", "text")))
    return spans.groupBy("page", "block", "line").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def neighbourhood(labels: DataFrame, spans: DataFrame) -> DataFrame:
    """Text around each label: spans within max(60, 6 size) in x and y, in reading order; by buckets of 128 points."""
    cell, radius = 128.0, F.greatest(F.lit(60.0), 6 * F.col("size"))
    near = labels.select("span_id", "page", "size", F.col("x").alias("lx"), F.col("y").alias("ly"))
    for axis in ("lx", "ly"):
        near = near.withColumn(f"b{axis}", F.explode(F.sequence(F.floor((F.col(axis) - radius) / cell), F.floor((F.col(axis) + radius) / cell))))
    s = spans.select("page", F.col("span_id").alias("other"), "x", "y", "text", F.floor(F.col("x") / cell).alias("blx"), F.floor(F.col("y") / cell).alias("bly"))
    hit = near.join(s, ["page", "blx", "bly"]).filter((F.abs(F.col("x") - F.col("lx")) <= radius) & (F.abs(F.col("y") - F.col("ly")) <= radius) & (F.col("other") != F.col("span_id")))
    words = F.array_sort(F.collect_list(F.struct("y", "x", "other", "text")))
    return hit.groupBy("span_id").agg(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("around"))


def label_context(labels: DataFrame) -> DataFrame:
    """What a label stands in, by the text around it and whether it is stacked: schedule, legend, note or plan."""
    around = F.upper(F.coalesce("around", F.lit("")))
    context = (
        F.when(around.rlike(r"\bSCHEDULE\b") | F.coalesce("stacked", F.lit(False)), "schedule")
        .when(around.rlike(r"\b(LEGEND|ABBREVIATIONS?)\b"), "legend")
        .when(around.rlike(r"\b(NOTES?|TYP\.? DETAIL|SEE DETAIL)\b"), "note")
        .otherwise("plan_label")
    )
    return labels.withColumn("context", context)


def corroborated(chains: DataFrame, dimensions: DataFrame, share: float = 0.02, reach: float = 60.0) -> DataFrame:
    """Chains with the first printed dimension beside them (within reach and their ends) that agrees with their length."""
    cell = reach * 2
    d = dimensions.select("page", "dim_id", F.col("x").alias("dx"), F.col("y").alias("dy"), "inches").withColumn("b", F.explode(F.sequence(F.floor((F.col("dy") - reach) / cell), F.floor((F.col("dy") + reach) / cell))))
    c = chains.withColumn("b", F.floor(F.col("y") / cell))
    agrees = F.abs(F.col("inches") - F.col("length_in")) <= share * F.col("inches")
    hit = c.join(d, ["page", "b"]).filter((F.abs(F.col("dy") - F.col("y")) <= reach) & F.col("dx").between(F.col("x0"), F.col("x1")) & agrees)
    first = hit.groupBy("chain_id").agg(F.min("dim_id").alias("dim_id"))
    return chains.join(first, "chain_id", "left").withColumn("confidence", F.least(F.col("confidence") + F.when(F.col("dim_id").isNotNull(), 0.1).otherwise(0.0), F.lit(1.0)))


def crossings(horizontal: DataFrame, vertical: DataFrame, slack: float = 1.0) -> DataFrame:
    """Where vertical chains (page, x, y0, y1) meet horizontal ones (page, y, x0, x1), with slack at the ends; by buckets of 64 points."""
    cell = 64.0
    h = horizontal.withColumn("b", F.explode(F.sequence(F.floor((F.col("x0") - slack) / cell), F.floor((F.col("x1") + slack) / cell))))
    v = vertical.select("page", F.col("chain_id").alias("v_id"), "x", "y0", "y1").withColumn("b", F.floor(F.col("x") / cell))
    met = h.join(v, ["page", "b"]).filter(F.col("x").between(F.col("x0") - slack, F.col("x1") + slack) & F.col("y").between(F.col("y0") - slack, F.col("y1") + slack))
    return met.select("page", "chain_id", "v_id", "x", "y")


def cuts_between_labels(labels: DataFrame, crossed: DataFrame) -> DataFrame:
    """A cut between each two neighbouring labels of a chain: the crossing nearest their midpoint within 0.4 of the gap, else the midpoint for review."""
    w = Window.partitionBy("chain_id").orderBy("x", "span_id")
    gaps = labels.withColumn("next_x", F.lead("x").over(w)).filter("next_x > x").select("chain_id", "span_id", ((F.col("x") + F.col("next_x")) / 2).alias("mid"), (F.col("next_x") - F.col("x")).alias("gap"))
    c = crossed.select("chain_id", F.col("x").alias("cx")).distinct()
    off = F.abs(F.col("cx") - F.col("mid"))
    near = gaps.join(c, "chain_id").filter(off <= 0.4 * F.col("gap")).groupBy("chain_id", "span_id").agg(F.min(F.struct(off.alias("off"), "cx")).alias("n"))
    return gaps.join(near, ["chain_id", "span_id"], "left").select("chain_id", "span_id", F.coalesce("n.cx", "mid").alias("cut"), F.col("n").isNull().alias("needs_review"))


def of_role(members: DataFrame, role: str | None) -> DataFrame:
    """Members of a role, or all."""
    return members if not role else members.filter(F.col("member_type") == role)


def sorted_grids(grids: DataFrame) -> DataFrame:
    """Grid lines of each page by axis and place, numbered."""
    return grids.withColumn("no", F.row_number().over(Window.partitionBy("page").orderBy("axis", "coord", "label")))
