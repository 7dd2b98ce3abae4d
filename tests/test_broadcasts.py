"""Tables that grow are merged, whatever their files' size."""

import pytest

from spandrel.operators import charts, crawl


def plans(monkeypatch, module, run):
    seen, keep = [], module.checkpointed
    monkeypatch.setattr(module, "checkpointed", lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    return [*seen, run()._jdf.queryExecution().executedPlan().toString()] + seen


def test_crawl_broadcasts_no_urls(spark, monkeypatch):
    edges = spark.range(50).selectExpr("concat('https://a.example/', id) as src", "concat('https://a.example/', id + 1) as dst", "0L as place")
    rules = spark.createDataFrame([("a.example", "/x", False)], "host string, path string, allow boolean")
    found = plans(monkeypatch, crawl, lambda: crawl.crawl(edges.selectExpr("src as url").limit(1), edges, rules, ["a.example"], depth=2))
    assert len(found) > 3 and not any("BroadcastHashJoin" in p for p in found)


@pytest.mark.parametrize("n", [60])
def test_positioned_chart_broadcasts_no_spans(spark, monkeypatch, n):
    spans = spark.range(n).selectExpr("'d' as document", "1 as page", "id as span_id", "100.0 * (id % 3) as x0", "100.0 * (id % 3) + 20 as x1", "12.0 * floor(id / 3) as y", "case when id < 3 then concat(id + 1, ' Hr') else '1/2' end as text")
    found = plans(monkeypatch, charts, lambda: charts.positioned_chart(spans))
    assert not any("BroadcastHashJoin" in p for p in found)
