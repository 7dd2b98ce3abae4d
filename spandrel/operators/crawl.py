"""Crawling as rounds over a link table: host lists, path rules, page budgets, breadth first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

STATUS = ("fetched", "other host", "disallowed", "over budget")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    """Path and query of a url, '/' where it has none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`urls` (url, ...) with the rule of its host that has the longest path in front of its own: columns rule, allowed.

    rules: host, path, allow. Of equal paths an allowing rule wins; without a rule a url is allowed. A url meets only the prefixes of
    its path that have the length of some rule of its host, by equality, so no host's urls are paired with all of its rules.
    """
    r = rules.select(F.lower("host").alias("host"), "path", "allow").filter(F.length("path") > 0).groupBy("host", "path").agg(F.max("allow").alias("allow"))
    lengths = r.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    keyed = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("url_path")).distinct()
    tried = keyed.join(lengths.hint("merge"), "host").select("url", "host", "url_path", F.explode("lengths").alias("n")).filter(F.col("n") <= F.length("url_path"))
    met = tried.withColumn("path", F.expr("left(url_path, n)")).join(r.hint("merge"), ["host", "path"])
    best = met.groupBy("url").agg(F.max_by(F.struct("path", "allow"), "n").alias("r"))
    return urls.join(best.hint("merge"), "url", "left").withColumn("rule", F.col("r.path")).withColumn("allowed", F.coalesce("r.allow", F.lit(True))).drop("r")


def crawl(seeds: DataFrame, edges: DataFrame, rules: DataFrame, hosts: list[str], depth: int = 3, budget: int = 200) -> DataFrame:
    """(url, depth, host, rule, status): what a crawl of the links (src, dst, place) from the seeds comes to.

    A url is met once, at its least depth. It is fetched if its host is listed, the longest rule allows it and its host has fetched
    fewer than `budget` pages; only fetched pages are followed, `depth` links deep. Within a depth a host takes its pages in order of
    the least page that names them, the place there, and the url. The host list is a parameter and stays in the plan. Tables of urls
    are merged, never broadcast.
    """
    listed = [h.lower() for h in hosts]
    level = seeds.select("url").distinct().withColumn("named", F.struct(F.lit("").alias("src"), F.lit(0).cast("long").alias("place")))
    seen = None
    for d in range(depth + 1):
        fresh = ruled(level, rules).withColumn("host", host_of(F.col("url")))
        reason = F.when(~F.col("host").isin(listed), "other host").when(~F.col("allowed"), "disallowed")
        fresh = fresh.withColumn("reason", reason)
        w = Window.partitionBy("host").orderBy("named", "url")
        ranked = fresh.filter("reason is null").withColumn("no", F.row_number().over(w)).filter(F.col("no") <= budget)  # ranks beyond the budget are cut off before the shuffle
        if seen is not None:
            used = seen.filter("status = 'fetched'").groupBy("host").agg(F.count("*").alias("used"))
            ranked = ranked.join(used, "host", "left").filter(F.col("no") + F.coalesce("used", F.lit(0)) <= budget)
        fetched = ranked.select("url", F.lit(True).alias("within"))
        status = F.coalesce("reason", F.when(F.col("within"), "fetched"), F.lit("over budget"))
        now = checkpointed(fresh.join(fetched.hint("merge"), "url", "left").select("url", F.lit(d).alias("depth"), "host", "rule", status.alias("status")))
        seen = now if seen is None else checkpointed(seen.unionByName(now))
        if d == depth:
            break
        named = now.filter("status = 'fetched'").select(F.col("url").alias("src")).join(edges.hint("merge"), "src").groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("src", F.col("place").cast("long").alias("place"))).alias("named"))
        level = checkpointed(named.join(seen.select("url").hint("merge"), "url", "left_anti"))
        if level.isEmpty():
            break
    return seen
