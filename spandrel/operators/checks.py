"""Submitted values against resolutions, and predictions against an answer key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import greedy, resolve


def designs_for_role(sheets: DataFrame) -> DataFrame:
    """(sheet, role, design): a column takes the sheet's X and Y designs, others the rest; all where that leaves none."""
    is_column = lambda d: d["design"].substr(1, 1).isin("X", "Y")
    fit = F.filter("designs", lambda d: is_column(d) == (F.col("role") == "column"))
    return sheets.withColumn("designs", F.when(F.size(fit) == 0, F.col("designs")).otherwise(fit))


def product_line(name: Column, makers: tuple[str, ...] = ("inc", "inc.", "company", "international")) -> Column:
    """A product name in capitals without the words of its maker; null if nothing is left."""
    kept = F.filter(F.split(F.trim(name), r"\s+"), lambda w: ~F.lower(w).isin(*[m.lower() for m in makers]))
    return F.nullif(F.upper(F.array_join(kept, " ")), F.lit(""))


def verdicts(submitted: DataFrame, resolutions: DataFrame, candidates: DataFrame, sides: str | None = None, by: str = "query_id", counted: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """match, differs, match-one-route, not-rated, skipped or the resolution's status for each submitted row.

    A conflict matches one route where some candidate has exactly the submitted value. `by` is the column of `submitted` that names
    the resolution's query; resolutions are broadcast if what is `counted` in their place is few. Columns to `keep` are
    handed on.
    """
    values = candidates.groupBy("query_id").agg(F.collect_set("thickness_in").alias("values"))
    found = resolutions.select("query_id", "status", "thickness_in").join(values, "query_id", "left").withColumnRenamed("query_id", by)
    joined = submitted.join(found if counted is None else resolve.few(found, counted), by, "left").withColumn("among", F.array_contains("values", F.col("submitted_in")))
    near = F.abs(F.col("thickness_in") - F.col("submitted_in")) < 1e-6
    verdict = (
        F.when(F.col("submitted_in").isNull(), "skipped")
        .when((F.col("status") == "resolved") & F.col("thickness_in").isNull(), "not-rated")
        .when(F.col("status") == "resolved", F.when(near, "match").otherwise("differs"))
        .when(F.col("status") == "conflict", F.when(F.col("among"), "match-one-route").otherwise("differs"))
        .when((F.col("status") == "review") & F.col("among"), "review-match")
        .otherwise(F.coalesce("status", F.lit("unknown")))
    )
    if sides:
        verdict = F.when((verdict == "differs") & (F.col(sides) == 4), "differs-4-sides").otherwise(verdict)
    return joined.select("query_id", "submitted_in", "status", verdict.alias("verdict"), *(["thickness_in"] if by != "query_id" else []), *keep)


def judged(queries: DataFrame, listing: DataFrame, charts: DataFrame, equations: DataFrame | None = None, xrefs: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, submitted_in, status, verdict, thickness_in) and columns to `keep` of queries that have a submitted value; candidates are found once for each question."""
    asked, named = resolve.asked_once(queries)
    found = checkpointed(resolve.folded(resolve.candidates(asked, listing, charts, equations, xrefs)))
    resolved = resolve.resolve(asked, listing, charts, equations, xrefs, found=found)
    return verdicts(named.select("query_id", "question", "submitted_in", *keep), resolved, found, by="question", counted=asked, keep=keep)


def bid_queries(sheets: DataFrame, items: DataFrame) -> DataFrame:
    """The thickness queries of a bid: each item under each design of its sheet that fits its role, once for a design and rating.

    sheets: sheet_no, product_name, designs (array of struct design, rating_hr); items: item_id, sheet_no, canonical_section, member_label,
    role, sides, thickness_in. Items without a member or a thickness are skipped. Columns take X and Y designs, others the rest, all where
    that leaves none. The restraint of all but columns is assumed unrestrained, and said so. An item of a sheet without designs keeps
    one row without a query.
    """
    rows = items.withColumn("member", F.coalesce("canonical_section", "member_label")).filter("member is not null and thickness_in is not null").withColumn("role", F.coalesce("role", F.lit("beam")))
    joined = rows.join(sheets.select("sheet_no", product_line(F.col("product_name")).alias("product"), "designs"), "sheet_no", "left")
    listed = F.filter(F.coalesce("designs", F.array().cast("array<struct<design:string,rating_hr:double>>")), lambda d: d["design"].isNotNull())
    fit = F.filter(listed, lambda d: F.substring(d["design"], 1, 1).isin("X", "Y") == (F.col("role") == "column"))
    taken = F.array_distinct(F.transform(F.when(F.size(fit) == 0, listed).otherwise(fit), lambda d: F.struct(d["design"].alias("design"), F.coalesce(d["rating_hr"].cast("double"), F.lit(0.0)).alias("rating_hours"))))
    each = joined.select("item_id", "sheet_no", "member", "role", "sides", F.col("thickness_in").alias("submitted_in"), "product", F.explode_outer(taken).alias("d"))
    beam = F.col("role") != "column"
    return each.select(
        "item_id", "sheet_no", "member", "role", "sides", "submitted_in", "product", F.col("d.design").alias("design"), F.col("d.rating_hours").alias("rating_hours"), F.when(beam, "unrestrained").alias("restraint"),
        F.when(beam & F.col("d").isNotNull(), "restraint assumed unrestrained").alias("assumption"), F.when(F.col("d").isNotNull(), F.concat_ws("/", F.col("item_id").cast("string"), "d.design", F.col("d.rating_hours").cast("string"))).alias("query_id"),
    )


def bid_report(sheets: DataFrame, items: DataFrame, listing: DataFrame, charts: DataFrame, equations: DataFrame | None = None, xrefs: DataFrame | None = None) -> DataFrame:
    """A bid's items against the library: one row for each query of `bid_queries`, with status, resolved thickness and verdict.

    Verdicts as in `verdicts`, and `no-design` for items of sheets that list none. Candidates are worked out once for each question;
    rows go through the verdicts whole, so they are neither stored nor joined with them.
    """
    asked = bid_queries(sheets, items)
    queries = asked.withColumn("row", F.struct("item_id", "sheet_no", "member", "role", "sides", "design", "rating_hours", "assumption"))
    out = judged(queries, listing, charts, equations, xrefs, keep=("row",))
    said = lambda c: F.when(F.col("query_id").isNull(), "no-design").otherwise(F.col(c)).alias(c)
    return out.select("row.item_id", "row.sheet_no", "row.member", "row.role", "row.sides", "submitted_in", "row.design", "row.rating_hours", "row.assumption", said("status"), "thickness_in", said("verdict"))


KNOWN_TOKENS = ("NW", "LW", "C", "P/T")
BEAM_ROLES = ("primary_beam", "secondary_beam", "bridging", "angle", "channel", "hss", "joist")


def legend_conditions(legend: DataFrame) -> DataFrame:
    """`legend` (design, design_suffix, design_tokens, ...) with `condition`, `unmapped` and `notes`: what its printed code is read as.

    C stands for a cellular or corrugated deck, but on a column design (X) for the wide-flange chart, which asks no condition. Tokens and
    suffixes that stand for nothing known are kept as printed and noted.
    """
    up = F.transform(F.coalesce("design_tokens", F.array().cast("array<string>")), F.upper)
    on_column = F.coalesce(F.col("design").startswith("X"), F.lit(False))
    read = F.when(on_column, F.filter(up, lambda t: t != "C")).otherwise(up)
    other = F.filter(up, lambda t: ~t.isin(*KNOWN_TOKENS))
    suffix = F.coalesce("design_suffix", F.lit("")) != ""
    notes = F.array_compact(
        F.concat(
            F.array(
                F.when(F.array_contains(up, "C"), F.when(on_column, "C read as wide-flange column chart").otherwise("C read as cellular or corrugated deck")),
                F.when(F.array_contains(up, "P/T"), F.lit("P/T read as pipe or tube column chart")),
                F.when(suffix, F.concat(F.lit("suffix "), "design_suffix", F.lit(" not mapped"))),
            ),
            F.transform(other, lambda t: F.concat(F.lit("token "), t, F.lit(" not mapped"))),
        )
    )
    return legend.withColumns({"condition": condition_of_tokens(read), "unmapped": suffix | (F.size(other) > 0), "notes": notes})


def drawing_report(legend: DataFrame, listing: DataFrame, charts: DataFrame, equations: DataFrame | None = None, xrefs: DataFrame | None = None) -> DataFrame:
    """Legend rows of shop drawings against the library: one row each with condition, notes, status and verdict.

    legend: row_id, product_hint, canonical, role, joist_depth_in, design, design_suffix, design_tokens, hours, thickness_in, sides. Rows without a member
    (or, for joists, a depth), design, rating or thickness are `skipped`. The restraint of beams is assumed unrestrained, but for X and Y
    designs. A value that differs is told apart where the row has four sides, or a code that stands for nothing known.
    """
    depth = F.when(F.col("role") == "joist", F.col("joist_depth_in"))
    asks = (F.col("canonical").isNotNull() | depth.isNotNull()) & F.col("design").isNotNull() & F.col("hours").isNotNull() & F.col("thickness_in").isNotNull()
    column = F.substring("design", 1, 1).isin("X", "Y")
    restraint = F.when(F.col("role").isin(*BEAM_ROLES) & ~column, "unrestrained")
    rows = legend_conditions(legend).withColumns({"asks": F.coalesce(asks, F.lit(False)), "depth": depth, "restraint": restraint})
    # a row that does not ask has no design to be looked for
    asked = rows.select(
        F.col("row_id").alias("query_id"), F.when(F.col("asks"), F.col("design")).alias("design"), F.coalesce("canonical", F.concat(F.lit("JOIST "), F.col("depth").cast("string"))).alias("member"), F.col("hours").alias("rating_hours"), "restraint",
        product_line(F.col("product_hint")).alias("product"), "condition", F.col("depth").alias("joist_depth_in"), F.col("thickness_in").alias("submitted_in"),
        F.struct("row_id", "role", "design", "condition", "restraint", "notes", "asks", "sides", "unmapped").alias("row"),
    )
    said = judged(asked, listing, charts, equations, xrefs, keep=("row",)).select("row.*", "status", F.col("verdict").alias("v"))
    differs = F.col("v") == "differs"
    verdict = F.when(~F.col("asks"), "skipped").when(differs & (F.col("sides") == 4), "differs-4-sides").when(differs & F.col("unmapped"), "differs-unmapped-code").otherwise(F.col("v"))
    return said.select("row_id", "role", "design", "condition", "restraint", "notes", F.when(F.col("asks"), F.col("status")).alias("status"), verdict.alias("verdict"))


def verdict_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def condition_of_tokens(tokens: Column) -> Column:
    """The chart condition that printed code tokens stand for: concrete weight, and cellular or corrugated deck."""
    up = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.upper(t))
    weight = F.when(F.array_contains(up, "LW"), "Lightweight").when(F.array_contains(up, "NW"), "Normal Weight")
    deck = F.when(F.array_contains(up, "C"), "Cellular or Corrugated Deck")
    return F.nullif(F.concat_ws(" ", deck, weight), F.lit(""))


def match_to_key(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Greedy one-to-one matches by level and section: each prediction in `seq` order takes the free truth of least relative length error, the earlier on a tie.

    kind: match, duplicate (truths there were, all taken), false_positive (there were none), missed. Groups are independent; each takes a
    logarithmic time for a prediction and holds its truths only.
    """
    side = lambda df, k: df.select(F.col("level").cast("string").alias("level"), F.col("section").cast("string").alias("section"), F.lit(k).alias("side"), F.col("seq").cast("long").alias("seq"), F.col("length_in").cast("double").alias("length_in"))
    fields = [("level", "string"), ("section", "string"), ("seq", "long"), ("truth_seq", "long"), ("kind", "string"), ("error", "double")]
    return greedy.streamed(side(truth, 0).unionByName(side(predicted, 1)), ["level", "section"], ["side", "seq"], greedy.NearestFree, fields)


def nth(values: DataFrame, ranks: list[int], column: str = "v", few: int = 4096) -> list[float]:
    """The values of the given 0-based ranks in order of size, by counting: a range is cut into 256 parts until a part has few values.

    Only counts, and a bounded number of values, reach the driver. Infinite values are greatest. Ranks must be within the count.
    """
    counted = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    finite = counted.filter(F.abs("v") < float("inf"))
    out = []
    for rank in ranks:
        part, low, high, left = finite, None, None, rank
        while True:
            size = part.agg(F.count("*").alias("n"), F.sum("k").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high")).first()
            if left >= (size["rows"] or 0):
                out.append(float("inf"))
                break
            low, high = size["low"], size["high"]
            if size["n"] <= few:
                for r in sorted(part.collect()):
                    if left < r["k"]:
                        out.append(r["v"])
                        break
                    left -= r["k"]
                break
            bin_of = F.least(F.floor((F.col("v") - low) / (high - low) * 256), F.lit(255))
            bins = part.groupBy(bin_of.alias("b")).agg(F.sum("k").alias("k")).collect()
            for b in sorted(bins):
                if left < b["k"]:
                    part = part.filter(bin_of == b["b"])
                    break
                left -= b["k"]
    return out


def score(matches: DataFrame) -> DataFrame:
    """Recall, precision, counts, and the length error's upper median and floor-rank 95th percentile.

    The percentiles are found by counting (`nth`), so neither a task nor the driver holds all errors.
    """
    n = lambda k: F.count_if(F.col("kind") == k)
    counts = matches.agg(n("match").alias("matched"), n("duplicate").alias("duplicates"), n("false_positive").alias("false_positives"), n("missed").alias("missed"))
    errors = matches.filter("kind = 'match'").select(F.col("error").alias("v"))
    total = errors.count()
    median, p95 = nth(errors, [total // 2, int(0.95 * (total - 1))]) if total else (None, None)
    return counts.select(
        F.try_divide("matched", F.col("matched") + F.col("missed")).alias("recall"),
        F.try_divide("matched", F.col("matched") + F.col("duplicates") + F.col("false_positives")).alias("precision"),
        "matched", "duplicates", "false_positives", "missed", F.lit(median).cast("double").alias("median_error"), F.lit(p95).cast("double").alias("p95_error"),
    )
