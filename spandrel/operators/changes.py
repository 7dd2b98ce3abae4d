"""Change requests to the project model as the rows they append: assertion, assignment, audit and review events.

`rows_for` is the batch form over a whole log of requests. `spandrel.streaming.changes` does the same for a stream, with the same
ids, so a finished stream equals it.

Requests: request_id, created_at, what (one of TABLES), member_id, scenario_id, status (resolved, conflict, review, unknown), method,
value (double), choice (boolean: a person chose the value), actor, reason, source_ref. Order is by created_at, then request_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import model

TABLES = ("interpretation", "rating", "exposure", "condition", "design")
KEY = ("what", "member_id", "scenario_id")
REQUEST = "request_id string, created_at string, what string, member_id string, scenario_id string, status string, method string, value double, choice boolean, actor string, reason string, source_ref string"
ASSERTION = "assertion_id string, member_id string, kind string, value double, method string, confidence double, source_ref string, verified_by string"
ASSIGNMENT = "id string, what string, member_id string, scenario_id string, created_at string, status string, value double, assertion_id string, supersedes_id string, actor string"
AUDIT = "subject_id string, action string, before string, after string, reason string, actor string"
REVIEW = "item_id string, member_id string, scenario_id string, category string, kind string, status string, ts string, assertion_id string"
ROWS = f"assertion struct<{ASSERTION.replace(' ', ':').replace(',:', ',')}>, assignment struct<{ASSIGNMENT.replace(' ', ':').replace(',:', ',')}>, audit struct<{AUDIT.replace(' ', ':').replace(',:', ',')}>, review array<struct<{REVIEW.replace(' ', ':').replace(',:', ',')}>>"


def _id(kind: str) -> Column:
    return F.sha1(F.concat_ws("/", F.lit(kind), "what", "member_id", "scenario_id", "request_id"))


def public(prefix: str = "") -> Column:
    """What an audit row shows of an assignment."""
    return F.to_json(F.struct(F.col(prefix + "status").alias("status"), F.col(prefix + "value").alias("value"), F.col(prefix + "actor").alias("actor")))


def prepared(requests: DataFrame) -> DataFrame:
    """Requests with what they come to by themselves: a value only where one is resolved or chosen, the kind of assertion, ids."""
    chosen = F.coalesce("choice", F.lit(False))
    settled = chosen | F.coalesce(F.col("status") == "resolved", F.lit(False))
    kind = F.when(chosen, "HUMAN_OVERRIDE").when(~settled, "ASSUMPTION").when(F.col("method") == "ul_equation", "CALCULATION").otherwise("FACT")
    sure = F.when(chosen, 1.0).when(~settled, 0.0).when(F.col("method") == "ul_equation", 0.95).otherwise(0.98)
    rows = requests.withColumns({"chosen": chosen, "settled": settled, "kind": kind, "sure": sure})
    rows = rows.withColumns({"value": F.when(F.col("settled"), F.col("value")), "status": F.when(chosen, "override").otherwise(F.coalesce("status", F.lit("unknown")))})
    return rows.withColumns({"id": _id("assignment"), "assertion_id": _id("assertion"), "item_id": F.when(~F.col("settled"), _id("item")), "shown": public()})


def _struct(fields: str, **columns: Column) -> Column:
    return F.struct(*[columns.get(f.split()[0], F.col(f.split()[0])).cast(f.split()[1]).alias(f.split()[0]) for f in fields.split(", ")])


def _assertion() -> Column:
    return _struct(ASSERTION, method=F.when(F.col("settled"), F.col("method")), confidence=F.col("sure"), source_ref=F.when(F.col("settled"), F.col("source_ref")), verified_by=F.when(F.col("chosen"), F.col("actor")))


def rows_for(requests: DataFrame) -> DataFrame:
    """(assertion, assignment, audit, review) for each request: the rows that it appends to the four tables.

    The assertion comes first and is named by the assignment; the assignment supersedes the one before it of its table, member and
    scenario; the audit row shows both. A request without a settled value opens a review item; a person's choice closes all
    items of its key that are open. Nothing is updated. Of equal request_ids of a key the first is taken.
    """
    w = Window.partitionBy(*KEY).orderBy("created_at", "request_id")
    rows = prepared(requests.dropDuplicates([*KEY, "request_id"]))
    rows = rows.withColumns({"supersedes_id": F.lag("id").over(w), "before": F.lag("shown").over(w)})
    done = F.count_if("chosen").over(w)  # an item is closed by the first choice behind it
    rows = rows.withColumn("run", F.when(F.col("chosen"), done - 1).otherwise(done))
    opened = F.collect_list(F.when(~F.col("settled"), F.col("item_id"))).over(Window.partitionBy(*KEY, "run"))
    return appended(rows.withColumn("opened", opened))


def appended(rows: DataFrame) -> DataFrame:
    """The four kinds of rows of prepared requests that know what they supersede, the row before, and the items opened before."""
    event = lambda item, status, assertion: _struct(REVIEW, item_id=item, category=F.col("what"), kind=F.when(F.col("status") == "conflict", "conflict").otherwise("unknown"), status=F.lit(status), ts=F.col("created_at"), assertion_id=assertion)
    none = F.array().cast(f"array<struct<{REVIEW.replace(' ', ':').replace(',:', ',')}>>")
    events = F.when(~F.col("settled"), F.array(event(F.col("item_id"), "open", F.lit(None)))).when(F.col("chosen"), F.transform(F.array_sort("opened"), lambda i: event(i, "resolved", F.col("assertion_id")))).otherwise(none)
    audit = _struct(AUDIT, subject_id=F.col("id"), action=F.concat("what", F.lit(".assign")), after=F.col("shown"))
    return rows.select(_assertion().alias("assertion"), _struct(ASSIGNMENT).alias("assignment"), audit.alias("audit"), events.alias("review"))


def tables_of(rows: DataFrame) -> dict[str, DataFrame]:
    """The rows of `rows_for` by table."""
    return {
        "assertion": rows.select("assertion.*"),
        "assignment": rows.select("assignment.*"),
        "audit": rows.select("audit.*"),
        "review": rows.select(F.inline("review")),
    }


def requests_for(members: DataFrame, resolutions: DataFrame, scenario: str, at: str, actor: str = "design-engine", role: str | None = None) -> DataFrame:
    """Design requests for every member (of a role) from the resolution of its own query: members (member_id, member_type), resolutions (query_id = member_id, status, method, thickness_in).

    A member whose query has no resolution asks with status unknown. Running it again at the same time gives the same requests.
    """
    asked = members if not role else members.filter(F.col("member_type") == role)
    found = resolutions.select(F.col("query_id").cast("string").alias("member_id"), F.col("status").alias("found"), F.col("method"), F.col("thickness_in"))
    rows = asked.select(F.col("member_id").cast("string").alias("member_id")).distinct().join(found, "member_id", "left")
    return rows.select(
        F.concat_ws("/", F.lit(at), F.lit(actor)).alias("request_id"), F.lit(at).alias("created_at"), F.lit("design").alias("what"), "member_id", F.lit(scenario).alias("scenario_id"), F.coalesce("found", F.lit("unknown")).alias("status"),
        "method", F.col("thickness_in").alias("value"), F.lit(False).alias("choice"), F.lit(actor).alias("actor"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("source_ref"),
    )


def freeze(assignments: DataFrame, members: DataFrame, scenario: str) -> DataFrame:
    """A stage: for each member the current row of each of the five tables in the scenario, as JSON; null where there is none."""
    mine = assignments.filter(F.col("scenario_id") == scenario)
    return model.stage_snapshot({t: mine.filter(F.col("what") == t).drop("what") for t in TABLES}, members)
