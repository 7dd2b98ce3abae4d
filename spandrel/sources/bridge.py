"""Domain tables derived from the star tables by SQL that Spark and DuckDB read alike.

A name in braces is a star table or another bridge.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import TABLES, read_table

BRIDGES = {
    "member": """
select concat('mem_', cast(l_orderkey as string), '_', cast(l_partkey as string), '_', cast(l_suppkey as string), '_', cast(l_linenumber as string)) as member_id,
  concat('LEVEL 0', cast(l_linenumber as string)) as level,
  concat('W', cast(8 + 2 * (l_partkey % 10) as string), 'X', cast(10 + (l_partkey % 30) as string)) as canonical_section,
  case l_returnflag when 'A' then 'beam' when 'N' then 'column' else 'joist' end as member_type,
  case when l_returnflag = 'R' and l_tax = 0.08 then cast(null as double) else cast(l_quantity as double) * 12 end as length_in,
  0.5e0 + 0.125e0 * (l_suppkey % 4) as confidence_geom,
  0.5e0 + 0.125e0 * (l_partkey % 4) as confidence_id,
  case when l_linestatus = 'F' then 'unreviewed' when l_linenumber = 7 and l_suppkey % 3 = 0 then 'excluded' else 'accepted' end as review_state,
  l_orderkey, l_partkey, l_suppkey, l_linenumber
from {lineitem}""",
    "shape": """
select concat('W', cast(8 + 2 * (p_partkey % 10) as string), 'X', cast(10 + (p_partkey % 30) as string)) as label,
  min(8e0 + 2 * (p_partkey % 10)) as d, min(4e0 + (p_partkey % 10) * 0.5e0) as bf, min(0.25e0 + (p_partkey % 5) * 0.0625e0) as tw
from {part} where p_partkey % 30 < 24 group by 1""",
    "chart_cell": """
select concat('S', cast(700 + p_size as string)) as design, concat(p_brand, '/', p_type) as chart_id, p_partkey as seq,
  concat('W', cast(8 + 2 * (p_partkey % 10) as string), 'X', cast(10 + (p_partkey % 30) as string)) as canonical,
  p_brand as products, case when p_partkey % 4 = 0 then concat(p_type, ' half flange tip') else p_type end as condition,
  case p_partkey % 3 when 0 then 'Unrestrained Beam' when 1 then 'Restrained Beam' else cast(null as string) end as section,
  h.hours as hours,
  case when p_partkey % 17 = 0 then cast(null as double) else (4 + ((p_partkey * 7 + h.i * 3) % 20)) / 16e0 end as thickness_in,
  (20 + (p_partkey % 64)) / 64e0 as ratio, 'W/D' as ratio_kind, 10e0 + 2 * (p_partkey % 6) as depth_in
from (select *, 1 as i, 1.0e0 as hours from {part} union all select *, 2, 1.5e0 from {part} union all select *, 3, 2.0e0 from {part}) h""",
    "ul_cell": """
select concat('S', cast(700 + p_size as string)) as design, p_partkey as seq,
  concat('W', cast(8 + 2 * (p_partkey % 10) as string), 'X', cast(10 + (p_partkey % 30) as string)) as canonical,
  case p_partkey % 5 when 0 then 'Restrained assembly' when 1 then 'Unrestrained assembly' else cast(null as string) end as condition,
  h.hours as hours, (4 + ((p_partkey * 7 + h.i * 3) % 20)) / 16e0 as thickness_in, (20 + (p_partkey % 64)) / 64e0 as ratio
from (select *, 1 as i, 1.0e0 as hours from {part} union all select *, 3, 2.0e0 from {part}) h where p_partkey % 6 = 1""",
    "equation": """
select concat('S', cast(700 + p_size as string)) as design, min(p_partkey) as seq, 'W/D' as factor,
  case p_size % 4 when 0 then 'h = R / (a*X + b)' when 1 then 'T = k / (X)' when 2 then 'T = a*(X) + b' else 'h = (R - c) / (k*X)' end as form,
  1.0e0 as a, 0.5e0 as b, 1.0e0 as k, 0.5e0 as c, 0.5e0 as ratio_lo, 1.25e0 as ratio_hi, 0.25e0 as h_lo, 4.0e0 as h_hi, p_size % 3 = 0 as r_minutes
from {part} where p_size % 5 = 2 group by p_size""",
    "xref": """
select distinct concat('S', cast(700 + p_size as string)) as design, concat('S', cast(701 + (p_size * 7) % 50 as string)) as target from {part}""",
    "query_set": """
select o_orderkey as query_id, concat('S', cast(700 + (o_custkey % 55) as string)) as design,
  concat('W', cast(8 + 2 * (o_orderkey % 10) as string), 'X', cast(10 + (o_orderkey % 30) as string)) as member,
  case o_orderstatus when 'F' then 1.0e0 when 'O' then 1.5e0 else 2.0e0 end as rating_hours,
  case when o_orderkey % 2 = 0 then 'unrestrained' else cast(null as string) end as restraint,
  case when o_orderkey % 3 = 0 then cast(null as string) else concat('Brand#', cast(1 + o_orderkey % 25 as string)) end as product,
  case when o_orderkey % 5 = 0 then (4 + o_orderkey % 20) / 16e0 else (4 + (o_orderkey * 7) % 20) / 16e0 end as submitted_in
from {orders}""",
    "bid_query": """
with d as (
  select c_custkey as sheet, concat('S', cast(700 + c_custkey % 55 as string)) as design, 1.0e0 as hours, false as x from {customer} where c_custkey % 9 <> 0
  union select c_custkey, concat('S', cast(700 + c_custkey % 50 as string)), 1.5e0, false from {customer} where c_custkey % 9 <> 0
  union select c_custkey, concat('X', cast(700 + c_custkey % 55 as string)), 2.0e0, true from {customer} where c_custkey % 9 <> 0 and c_custkey % 4 = 0)
select concat(cast(o_orderkey as string), '/', design, '/', cast(hours as string)) as query_id, o_orderkey as item_id, design, hours as rating_hours, x,
  concat('W', cast(8 + 2 * (o_orderkey % 10) as string), 'X', cast(10 + (o_orderkey % 30) as string)) as member,
  case when o_orderkey % 3 = 0 then cast(null as string) else 'unrestrained' end as restraint, case when o_custkey % 3 = 0 then cast(null as string) else concat('BRAND#', cast(1 + o_custkey % 25 as string)) end as product,
  (4 + o_orderkey % 20) / 16e0 as submitted_in
from {orders} join d on d.sheet = o_custkey
where o_orderkey % 11 <> 0 and (case when o_orderkey % 3 = 0 and o_custkey % 4 = 0 then x when o_orderkey % 3 <> 0 then not x else true end)""",
    "report_query": """
select o_orderkey as query_id, concat('S', cast(700 + (o_custkey % 55) as string)) as design, concat('W', cast(8 + 2 * (o_orderkey % 10) as string), 'X', cast(10 + (o_orderkey % 30) as string)) as member,
  case o_orderstatus when 'F' then 1.0e0 when 'O' then 1.5e0 else 2.0e0 end as rating_hours, case when o_orderkey % 2 = 0 then 'unrestrained' else cast(null as string) end as restraint,
  case when o_custkey % 3 = 0 then cast(null as string) else concat('BRAND#', cast(1 + o_custkey % 25 as string)) end as product,
  case o_orderkey % 6 when 1 then 'Normal Weight' when 2 then 'Cellular or Corrugated Deck Lightweight' else cast(null as string) end as cond,
  (4 + o_orderkey % 20) / 16e0 as submitted_in, 3 + o_orderkey % 7 % 2 as sides, o_orderkey % 6 = 4 or o_orderkey % 17 = 0 as unmapped
from {orders} where o_orderkey % 13 <> 0""",
    "assignment": """
select o_orderkey as id, o_custkey as member_id, o_orderpriority as scenario_id, o_orderdate as created_at,
  case when o_orderkey % 11 = 0 then cast(null as double) else (o_orderkey % 20) / 16e0 end as thickness_in,
  lag(o_orderkey) over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as supersedes_id
from {orders}""",
    "review_event": """
select event_id, user_id as item_id, ts, case event_type when 'purchase' then 'resolved' when 'error' then 'dismissed' else 'open' end as status,
  case user_id % 3 when 0 then 'unknown' when 1 then 'conflict' else 'geometry' end as category
from {events}""",
    "manifest": """
select event_id, concat('https://host', cast(user_id % 7 as string), '.example/doc', cast(user_id as string), '.pdf') as url,
  concat('id', cast(user_id % 200 as string)) as source_id, ts as fetched_at,
  case event_type when 'view' then 'fetched' when 'click' then 'unchanged' when 'purchase' then 'manual' when 'error' then 'error' else 'refused_host' end as status,
  case when event_id % 5 = 0 then cast(null as string) else concat('maker', cast(user_id % 7 as string), '/doc', cast(user_id as string), '.pdf') end as stored_path
from {events}""",
    "route_result": """
select p_partkey as route_id, concat('https://host', cast(p_partkey % 7 as string), '.example/doc', cast(p_partkey as string), '.pdf') as url,
  case p_partkey % 4 when 0 then 'listing' when 1 then 'chart' when 2 then 'chart' else 'unknown' end as kind,
  concat('S', cast(700 + p_size as string)) as design, p_size % 3 as n_tables, p_size as n_rows
from {part}""",
    "segment": """
select l_partkey % 40 as page, cast(l_suppkey as double) as y, cast((l_orderkey % 500) * 4 as double) as x0,
  cast((l_orderkey % 500) * 4 + l_quantity as double) as x1, l_linestatus = 'F' as dashed, l_orderkey, l_partkey, l_suppkey, l_linenumber
from {lineitem}""",
    "span": """
select o_orderkey as span_id, o_custkey % 40 as page, cast((o_orderkey % 500) * 4 as double) as x, cast(o_custkey % 100 as double) + 3 as y, 8e0 + (o_orderkey % 3) + case when o_orderkey % 50 = 0 then 30e0 else 0e0 end as size,
  concat('W', cast(8 + 2 * (o_orderkey % 10) as string), 'X', cast(10 + (o_orderkey % 30) as string)) as text
from {orders}""",
    "slanted": """
select page, seq, key, dashed, width, case k when 0 then t when 1 then o else t - o end as x0, case k when 0 then o when 1 then t else t + o end as y0,
  case k when 0 then t + n when 1 then o else t + n - o end as x1, case k when 0 then o when 1 then t + n else t + n + o end as y1
from (select l_partkey % 40 as page, l_orderkey * 8 + l_linenumber as seq,
  concat(cast(l_orderkey as string), '/', cast(l_partkey as string), '/', cast(l_suppkey as string), '/', cast(l_linenumber as string)) as key, l_linestatus = 'F' as dashed, 0.5e0 * (1 + l_linenumber % 2) as width,
  l_orderkey % 3 as k, cast((l_orderkey % 500) * 4 as double) as t, (l_suppkey % 50) * 0.5e0 as o, cast(l_quantity as double) as n from {lineitem}) s""",
    "bubble": """
select s_suppkey as circle_id, s_suppkey % 40 as page, case when s_suppkey % 2 = 0 then s_suppkey * 13.0e0 else 10e0 end as cx,
  case when s_suppkey % 2 = 0 then 10e0 else s_suppkey * 13.0e0 end as cy, 3e0 + s_suppkey % 5 as r,
  case when s_suppkey % 2 = 0 then chr(cast(65 + s_suppkey % 26 as int)) when s_suppkey % 9 = 0 then 'NOTE' else cast(s_suppkey % 100 as string) end as label
from {supplier}""",
    "grid": """
select s_suppkey % 40 as page, case when s_suppkey % 2 = 0 then 'v' else 'h' end as axis, s_suppkey * 13.0e0 as coord,
  case when s_suppkey % 2 = 0 then chr(cast(65 + s_suppkey % 26 as int)) else cast(s_suppkey as string) end as label
from {supplier}""",
}


def expand(text: str, name: str | None = None) -> list[str]:
    """Names in braces, in the order in which they must be defined."""
    out: list[str] = []
    for used in re.findall(r"\{(\w+)\}", text):
        if used in BRIDGES:
            out += [x for x in (*expand(BRIDGES[used]), used) if x not in out]
    return list(dict.fromkeys(out))


def bridge(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named bridge over the tables of a data folder."""
    text = BRIDGES[name]
    frames = {t: read_table(spark, sf_dir, t) if t in TABLES else bridge(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **frames)


def oracle(text: str) -> str:
    """DuckDB SQL: `text` after the definitions of the bridges it names in braces."""
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s).strip()
    names = expand(text)
    body = plain(text)
    if not names:
        return body
    views = ",\n".join(f"{n} as ({plain(BRIDGES[n])})" for n in names)
    if body.lower().startswith("with recursive"):
        return f"with recursive {views},\n{body[14:]}"
    return f"with {views},\n{body[4:]}" if body.lower().startswith("with") else f"with {views}\n{body}"
