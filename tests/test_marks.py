"""The nearest mark by the next ones below and above."""

import random

from pyspark.sql import functions as F

from spandrel.operators import takeoff


def test_nearest_mark_equals_all_pairs_and_pairs_nothing(spark):
    rng = random.Random(3)
    marks = [(rng.randrange(3), rng.randrange(80) / 2, k) for k in range(90)]
    spans = [(k, rng.randrange(4), rng.randrange(120) / 2) for k in range(300)]
    found = takeoff.nearest_mark(spark.createDataFrame(spans, "span_id int, page int, y double"), spark.createDataFrame(marks, "page int, y double, mark_id int"), 1.5)
    got = {r.span_id: (r.mark_id, r.off) for r in found.collect()}
    for k, page, y in spans:
        near = min(((abs(y - my), m) for p, my, m in marks if p == page and abs(y - my) <= 1.5), default=(None, None))
        assert got[k] == (near[1], near[0])
    many = takeoff.nearest_mark(spark.range(200).select(F.col("id").alias("span_id"), F.lit(1).alias("page"), F.lit(5.0).alias("y")), spark.range(200).select(F.lit(1).alias("page"), F.lit(5.0).alias("y"), F.col("id").alias("mark_id")), 1.5)
    assert many.count() == 200 and many._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
