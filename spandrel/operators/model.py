"""The append-only project model: current rows, supersession, review queue, meter, stages, assignments.

A change is a new row that names the row it supersedes. Nothing is updated in place: a review item closes by a
further event.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current(assignments: DataFrame) -> DataFrame:
    """The current row of each member and scenario: of those that no row supersedes the newest, the greater id on a tie."""
    gone = assignments.filter("supersedes_id is not null").select(F.col("supersedes_id").alias("id")).distinct()
    w = Window.partitionBy("member_id", "scenario_id").orderBy(F.desc("created_at"), F.desc("id"))
    return assignments.join(gone, "id", "left_anti").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def supersession_audit(assignments: DataFrame) -> DataFrame:
    """Each superseding row with what it changed: before and after."""
    old = assignments.select(F.col("id").alias("supersedes_id"), F.col("thickness_in").alias("before"))
    return assignments.filter("supersedes_id is not null").join(old, "supersedes_id").select("id", "supersedes_id", "before", F.col("thickness_in").alias("after"), (~F.col("before").eqNullSafe(F.col("thickness_in"))).alias("changed"))


def assign(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows to append for `changes` (id, member_id, scenario_id, created_at, values): each supersedes the current row."""
    now = current(table).select("member_id", "scenario_id", F.col("id").alias("supersedes_id"))
    return changes.drop("supersedes_id").join(now, ["member_id", "scenario_id"], "left").select(*table.columns)


def open_items(events: DataFrame) -> DataFrame:
    """Review items whose latest event leaves them open."""
    w = Window.partitionBy("item_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("r", F.row_number().over(w)).filter("r = 1 and status = 'open'").select("item_id", "category", "ts")


def meter(members: DataFrame, assignments: DataFrame, events: DataFrame) -> DataFrame:
    """One row: members, those assigned, those whose assignment has no value, open items in all and by conflict."""
    m = members.select("member_id").distinct()
    c = current(assignments).groupBy("member_id").agg(F.min(F.col("thickness_in").isNotNull()).alias("valued"))
    one = m.join(c, "member_id", "left").agg(F.count("*").alias("members"), F.count("valued").alias("assigned"), F.count_if(~F.col("valued")).alias("unresolved"))
    items = open_items(events).agg(F.count("*").alias("open_items"), F.count_if(F.col("category") == "conflict").alias("open_conflicts"))
    return one.join(items)  # one row each


def status_counts(resolutions: DataFrame) -> DataFrame:
    """Queries by status; a row that stands for several has their number in `times`."""
    return resolutions.groupBy("status").agg((F.sum("times") if "times" in resolutions.columns else F.count("*")).alias("n"))


def stage_snapshot(tables: dict[str, DataFrame], members: DataFrame) -> DataFrame:
    """A frozen stage: for each member the current row of every assignment table, as JSON by table name."""
    rows = [F.struct(*[c for c in t.columns if c not in ("created_at", "member_id", "scenario_id")]) for t in tables.values()]
    parts = [current(t).select("member_id", F.to_json(r).alias(name)) for (name, t), r in zip(tables.items(), rows, strict=True)]
    return reduce(lambda a, b: a.join(b, "member_id", "left"), parts, members.select("member_id").distinct())


def ensure_base(scenarios: DataFrame, projects: DataFrame) -> DataFrame:
    """Base scenarios to append: for projects that have none. Running it again gives no rows."""
    have = scenarios.filter("kind = 'base_bid'").select("project_id")
    return projects.select("project_id").distinct().join(have, "project_id", "left_anti").select(F.sha1(F.concat(F.lit("scn_"), "project_id")).alias("scenario_id"), "project_id", F.lit("base_bid").alias("kind"), F.lit(True).alias("is_current"))


def assertions_for(resolutions: DataFrame) -> DataFrame:
    """What is recorded for a resolution: FACT 0.98, CALCULATION 0.95, or ASSUMPTION 0.0 with a review item."""
    resolved = F.col("status") == "resolved"
    kind = F.when(resolved & (F.col("method") == "ul_equation"), "CALCULATION").when(resolved, "FACT").otherwise("ASSUMPTION")
    sure = F.when(kind == "FACT", 0.98).when(kind == "CALCULATION", 0.95).otherwise(0.0)
    return resolutions.withColumn("kind", kind).withColumn("confidence", sure).withColumn("review_category", F.when(~resolved, F.col("status")))


def choose(events: DataFrame, choices: DataFrame) -> DataFrame:
    """Closing events to append for the open items of the members and scenarios that `choices` (item_id, ts) settle."""
    return open_items(events).drop("ts").join(choices, "item_id").select("item_id", "ts", F.lit("resolved").alias("status"), "category")


def save_members(members: DataFrame) -> dict[str, DataFrame]:
    """Rows to append, by table; members without evidence are refused, and returned as such."""
    has = F.coalesce(F.size("evidence"), F.lit(0)) > 0
    good = members.filter(has)
    return {
        "member": good.drop("evidence"),
        "evidence": good.select("member_id", F.posexplode("evidence").alias("ord", "e")).select("member_id", "ord", "e.*"),
        "audit": good.select("member_id", F.lit("member_saved").alias("action")),
        "refused": members.filter(~has),
    }


def violations(assertions: DataFrame) -> DataFrame:
    """Assertions that break a rule, with the rule: confidence outside 0..1, FACT without source, CALCULATION without method."""
    rule = (
        F.when(~F.col("confidence").between(0, 1), "confidence_range")
        .when((F.col("kind") == "FACT") & F.col("source_ref").isNull(), "fact_without_source")
        .when((F.col("kind") == "CALCULATION") & F.col("method").isNull(), "calculation_without_method")
    )
    return assertions.withColumn("rule", rule).filter("rule is not null")


def explain(members: DataFrame, evidence: DataFrame, assertions: DataFrame, member_id: str) -> DataFrame:
    """Evidence and assertions of the members whose id is, or ends with, the one given."""
    m = members.filter((F.col("member_id") == member_id) | F.col("member_id").endswith(member_id)).select("member_id")
    e = m.join(evidence, "member_id").select("member_id", F.lit("evidence").alias("what"), F.col("raw_text").alias("detail"))
    return e.unionByName(m.join(assertions, "member_id").select("member_id", F.lit("assertion").alias("what"), F.concat_ws(" = ", "key", "value").alias("detail")))


def assign_all(table: DataFrame, members: DataFrame, resolutions: DataFrame, scenario: str, at, role: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows to append for every member (of a role) from the resolution of its section, and their counts by status.

    resolutions: section, status, thickness_in. Each row supersedes the member's current one in the scenario; its id
    follows from member, scenario and time, so a second run gives the same rows.
    """
    asked = members if not role else members.filter(F.col("member_type") == role)
    rows = asked.join(resolutions, asked["canonical_section"] == resolutions["section"], "left")
    status = F.coalesce("status", F.lit("unknown"))
    changes = rows.select(
        F.sha1(F.concat_ws("/", F.col("member_id").cast("string"), F.lit(scenario), F.lit(str(at)))).alias("id"),
        "member_id", F.lit(scenario).alias("scenario_id"), F.lit(at).alias("created_at"), F.when(status == "resolved", F.col("thickness_in")).alias("thickness_in"), status.alias("status"),
    )
    now = current(table).filter(F.col("scenario_id") == scenario).select("member_id", F.col("id").alias("supersedes_id"))
    out = changes.join(now, "member_id", "left")
    return out, out.groupBy("status").agg(F.count("*").alias("n"))
