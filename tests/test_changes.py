"""The change log: batch against a plain loop, the stream against the batch, and a stream killed between two tables."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from spandrel.operators import changes
from spandrel.streaming import changes as stream


def requests(n=240, seed=6):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        status = rng.choice(["resolved", "resolved", "conflict", "unknown", None])
        out.append((f"r{rng.randrange(10**6):06}", f"2026-01-{rng.randint(1, 28):02}", rng.choice(changes.TABLES[3:]), f"m{rng.randrange(8)}", rng.choice("ab"), status,
                    rng.choice(["ul_table", "ul_equation"]), rng.randrange(1, 30) / 16, rng.random() < 0.2 or None, rng.choice(["x", "y"]), None, "doc"))
    return out


def plain(rows):
    """Request by request, as a person would keep the books."""
    name = lambda kind, r: hashlib.sha1("/".join([kind, r[2], r[3], r[4], r[0]]).encode()).hexdigest()
    last, opened = {}, {}
    assignment, assertion, review, audit = [], [], [], []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        key, chosen = r[2:5], bool(r[8])
        good = chosen or r[5] == "resolved"
        kind = "HUMAN_OVERRIDE" if chosen else "ASSUMPTION" if not good else "CALCULATION" if r[6] == "ul_equation" else "FACT"
        assertion.append((name("assertion", r), kind, r[7] if good else None, {"HUMAN_OVERRIDE": 1.0, "ASSUMPTION": 0.0, "CALCULATION": 0.95, "FACT": 0.98}[kind]))
        status, value = "override" if chosen else r[5] or "unknown", r[7] if good else None
        row = (name("assignment", r), status, value, name("assertion", r), last.get(key, (None, None))[0])
        shown = {k: v for k, v in (("status", status), ("value", value), ("actor", r[9])) if v is not None}
        assignment.append(row)
        audit.append((row[0], last.get(key, (None, None))[1], shown))
        last[key] = (row[0], shown)
        if chosen:
            review += [(i, "resolved", name("assertion", r)) for i in opened.pop(key, [])]
        elif not good:
            opened.setdefault(key, []).append(name("item", r))
            review.append((name("item", r), "open", None))
    return {"assignment": sorted(map(str, assignment)), "assertion": sorted(map(str, assertion)), "review": sorted(map(str, review)), "audit": sorted(map(str, audit))}


def books(tables):
    load = lambda s: json.loads(s) if s else None
    return {
        "assignment": sorted(str((r.id, r.status, r.value, r.assertion_id, r.supersedes_id)) for r in tables["assignment"].collect()),
        "assertion": sorted(str((r.assertion_id, r.kind, r.value, r.confidence)) for r in tables["assertion"].collect()),
        "review": sorted(str((r.item_id, r.status, r.assertion_id)) for r in tables["review"].collect()),
        "audit": sorted(str((r.subject_id, load(r.before), load(r.after))) for r in tables["audit"].collect()),
    }


@pytest.fixture(scope="module")
def log():
    return requests()


def test_batch_keeps_the_books(spark, log):
    df = spark.createDataFrame(log + log[:5], changes.REQUEST)
    assert books(changes.tables_of(changes.rows_for(df))) == plain(log)
    assert changes.rows_for(df.limit(0)).count() == 0


def test_stream_killed_between_tables_gives_equal_tables(spark, log, tmp_path):
    spark.conf.set(*stream.STATE_STORE)
    parts = sorted(log, key=lambda r: (r[1], r[0]))
    source = str(tmp_path / "in")
    killed = []

    def kill(name, batch_id):
        if (name, batch_id) in (("assignment", 0), ("audit", 1)) and (name, batch_id) not in killed:
            killed.append((name, batch_id))
            raise RuntimeError("killed")

    (tmp_path / "in").mkdir()
    asked = spark.readStream.schema(changes.REQUEST).option("maxFilesPerTrigger", 1).parquet(source)
    for k in range(3):
        spark.createDataFrame(parts[80 * k : 80 * (k + 1)], changes.REQUEST).coalesce(1).write.mode("append").parquet(source)
        for _ in range(3):
            try:
                stream.write_batches(asked, str(tmp_path / "out"), str(tmp_path / "state"), kill)
                break
            except Exception as e:  # the query ends as a killed one would
                assert "killed" in str(e)
    assert len(killed) == 2
    assert books({t: stream.written(spark, str(tmp_path / "out"), t) for t in ("assertion", "assignment", "audit", "review")}) == plain(log)


def test_stage_over_five_tables(spark, log):
    rows = [(*r[:2], changes.TABLES[i % 5], *r[3:]) for i, r in enumerate(log)]
    found = changes.tables_of(changes.rows_for(spark.createDataFrame(rows, changes.REQUEST)))["assignment"]
    members = spark.createDataFrame([("m1",), ("m2",), ("none",)], "member_id string")
    got = {r.member_id: r.asDict() for r in changes.freeze(found, members, "a").collect()}
    assert set(got) == {"m1", "m2", "none"} and set(got["m1"]) == {"member_id", *changes.TABLES} and not any(got["none"][t] for t in changes.TABLES)
    for what in changes.TABLES:
        mine = sorted((r for r in rows if r[2:5] == (what, "m1", "a")), key=lambda r: (r[1], r[0]))
        shown = json.loads(got["m1"][what])["status"] if got["m1"][what] else None
        assert shown == (("override" if mine[-1][8] else mine[-1][5] or "unknown") if mine else None)


def test_requests_from_resolutions(spark):
    members = spark.createDataFrame([(1, "beam"), (2, "beam"), (3, "column"), (4, "beam")], "member_id long, member_type string")
    found = spark.createDataFrame([(1, "resolved", "ul_table", 0.5), (2, "conflict", "ul_table", None), (3, "resolved", "ul_table", 1.0)], "query_id long, status string, method string, thickness_in double")
    rows = changes.tables_of(changes.rows_for(changes.requests_for(members, found, "base", "2026-02-01", role="beam")))
    assert {(r.member_id, r.status, r.value) for r in rows["assignment"].collect()} == {("1", "resolved", 0.5), ("2", "conflict", None), ("4", "unknown", None)}
    assert rows["review"].filter(F.col("status") == "open").count() == 2
