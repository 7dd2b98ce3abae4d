"""DuckDB SQL for the queries, written apart from the DataFrame operators; names in braces are star tables or bridges."""

from __future__ import annotations

from ..sources.bridge import oracle

_FT = """
case when u is null then null else concat(case when length_in < 0 then '-' else '' end, cast(u // 192 as varchar), '''-', cast((u % 192) // 16 as varchar),
  case when u % 16 = 0 then '' when u % 8 = 0 then ' 1/2' when u % 4 = 0 then concat(' ', cast((u % 16) // 4 as varchar), '/4')
  when u % 2 = 0 then concat(' ', cast((u % 16) // 2 as varchar), '/8') else concat(' ', cast(u % 16 as varchar), '/16') end, '"') end"""
_COLOR = """
select *, case when review_state = 'excluded' then 'gray' when review_state = 'conflict' then 'red'
  when review_state = 'accepted' or least(confidence_id, confidence_geom, 0.875) >= 0.8 then 'green' else 'yellow' end as color from {member}"""
_CHAINS = """
chains as (
  select page, y, dashed, island, min(x0) as x0, max(x1) as x1, count(*) as pieces from (
    select *, sum(s) over (partition by page, y, dashed order by x0, x1 rows unbounded preceding) as island from (
      select *, case when b is null or x0 > b + 1.5 then 1 else 0 end as s from (
        select *, max(x1) over (partition by page, y, dashed order by x0, x1 rows between unbounded preceding and 1 preceding) as b from {segment})))
  group by page, y, dashed, island)"""
_RESTRAINT = "case when lower({0}) like '%unrestrained%' then 'unrestrained' when lower({0}) like '%restrained%' then 'restrained' end"
_PHRASE = "(q.product is null or contains(concat(' ', lower(regexp_replace(c.products, '#', ' ')), ' '), concat(' ', lower(regexp_replace(q.product, '#', ' ')), ' ')))"
_ROUTES = f"""
facts as (select chart_id, list_distinct(list({_RESTRAINT.format('section')}) filter (where section is not null)) as rs from {{chart_cell}} group by chart_id),
ul as (
  select q.query_id, q.design, c.seq, c.thickness_in, 'ul_table' as method, 2 as authority, cast(null as varchar) as products, cast(null as varchar) as chart_id, cast(null as varchar) as section, c.condition
  from {{query_set}} q join {{ul_cell}} c on q.design = c.design and q.member = c.canonical and abs(q.rating_hours - c.hours) < 1e-6
  where q.restraint is null or {_RESTRAINT.format('c.condition')} is null or {_RESTRAINT.format('c.condition')} = q.restraint),
ch as (
  select q.query_id, q.design, c.seq, c.thickness_in, 'chart_table' as method, 6 as authority, c.products, c.chart_id, c.section, c.condition
  from {{query_set}} q join {{chart_cell}} c on q.design = c.design and q.member = c.canonical and abs(q.rating_hours - c.hours) < 1e-6 join facts f on c.chart_id = f.chart_id
  where {_PHRASE} and c.condition not like '%half flange%' and (q.restraint is null
    or case when c.section is not null then {_RESTRAINT.format('c.section')} = q.restraint else len(rs) = 0 or rs is null or rs = [q.restraint] end)),
firsts as (
  select design, canonical, arg_min(ratio, rank * 1000000000 + seq) as ratio from (
    select design, canonical, ratio, 0 as rank, seq from {{ul_cell}} union all select design, canonical, ratio, 1, seq from {{chart_cell}}) group by design, canonical),
raw as (
  select q.query_id, q.design, e.seq, e.h_lo, e.h_hi,
    case when e.form like 'h = R / (%' then (case when r_minutes then 60 * q.rating_hours else q.rating_hours end) / (a * f.ratio + b)
      when e.form like 'T = k / (%' then k / f.ratio when e.form like 'h = (R - c)%' then ((case when r_minutes then 60 * q.rating_hours else q.rating_hours end) - c) / (k * f.ratio)
      else a * f.ratio + b end as v
  from {{query_set}} q join firsts f on q.design = f.design and q.member = f.canonical join {{equation}} e on q.design = e.design
  where f.ratio between e.ratio_lo - 1e-9 and e.ratio_hi + 1e-9),
eq as (
  select query_id, design, seq, ceil(v * 16 - 1e-9) / 16 as thickness_in, 'ul_equation' as method, 2 as authority, cast(null as varchar) as products, cast(null as varchar) as chart_id, cast(null as varchar) as section, cast(null as varchar) as condition
  from raw where v between h_lo - 1e-9 and h_hi + 1e-9),
cand as (select * from ul union all select * from ch union all select * from eq)"""
_LADDER = """
known as (select design from {ul_cell} union select design from {chart_cell} union select design from {equation}),
agg as (
  select query_id, count(*) as n, count(distinct thickness_in) + max(case when thickness_in is null then 1 else 0 end) as nv, min(thickness_in) as least, max(thickness_in) as most,
    arg_min(method, authority * 10000000000 + (case when method = 'ul_table' then 0 else 1000000000 end) + seq) as method,
    min(thickness_in) as any_value
  from cand group by query_id),
res as (
  select q.query_id, q.submitted_in, case when k.design is null or a.n is null then 'unknown' when a.nv > 1 then 'conflict' when a.method = 'chart_table' and q.product is null then 'review' else 'resolved' end as status,
    coalesce(a.n, 0) as n_candidates, coalesce(a.nv, 0) as n_values, a.least, a.most, a.any_value, a.method
  from {query_set} q left join known k on q.design = k.design left join agg a on q.query_id = a.query_id)"""
_QUANTITY = """
gone as (select distinct supersedes_id as id from {assignment} where supersedes_id is not null),
cur as (
  select member_id, thickness_in from (
    select *, row_number() over (partition by member_id, scenario_id order by created_at desc, id desc) as r from {assignment}
    where id not in (select id from gone)) where r = 1 and scenario_id = '1-URGENT'),
o as (select o_orderkey, min(o_custkey) as cust from orders group by 1),
m as (
  select b.*, c.thickness_in, case when b.member_type = 'column' then 4 else 3 end as sides, case when l_partkey % 2 = 0 then (20 + l_partkey % 64) / 64e0 end as ratio,
    concat('S', cast(700 + l_suppkey % 9 as varchar)) as design, s.d, s.bf, s.tw
  from {member} b left join o on b.l_orderkey = o.o_orderkey left join cur c on o.cust = c.member_id left join {shape} s on b.canonical_section = s.label),
p as (
  select *, case when d is not null then 'aisc_dimensions' when ratio is not null then 'chart_wd' end as method,
    case when d is not null then 2 * d + (case when sides = 4 then 4 else 3 end) * bf - 2 * tw when ratio is not null then (10 + (l_partkey % 30)) / ratio end as perimeter_in from m),
s1 as (
  select *, case when length_in is null then 'no_length' when thickness_in is null then 'no_thickness' when perimeter_in is null then 'no_surface_basis' else 'ok' end as status, length_in / 12 as length_ft from p),
s2 as (select *, case when status = 'ok' then perimeter_in / 12 * length_ft end as sq_ft from s1),
qt as (select *, case when status = 'ok' then sq_ft * thickness_in end as bd_ft from s2)"""
_CURRENT = """
gone as (select distinct supersedes_id as id from {assignment} where supersedes_id is not null),
cur as (
  select * from (select *, row_number() over (partition by member_id, scenario_id order by created_at desc, id desc) as r from {assignment}
    where id not in (select id from gone)) where r = 1)"""
_OPEN = """
open_items as (
  select item_id, category from (select *, row_number() over (partition by item_id order by ts desc, event_id desc) as r from {review_event}) where r = 1 and status = 'open')"""
_LATEST = """
latest as (
  select url, event_id, status, stored_path from (
    select *, row_number() over (partition by url order by fetched_at desc, event_id desc) as r from {manifest}
    where status in ('fetched', 'unchanged', 'manual') and stored_path is not null) where r = 1)"""


def _hits(words: tuple[str, ...], hint: str) -> str:
    one = lambda w: f"least(len(regexp_extract_all(regexp_replace(lower(text), '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9]){_doubled(w)}($|[^a-z0-9])')), 5)"
    return " + ".join(one(w) for w in words) + f" + case when source = '{hint}' then 3 else 0 end"


def _doubled(word: str) -> str:
    """Every character but letters and digits is doubled in the text, so that neighbouring matches share none."""
    return "".join(c if c.isalnum() else ("\\" + c if c in "./" else c) * 2 for c in word)


def _scores() -> str:
    from ..operators.catalog import HINTS, KEYWORDS

    return "select doc_id, " + ", ".join(f"cast({_hits(w, HINTS[n])} as bigint) as score_{n}" for n, w in KEYWORDS.items()) + " from {documents}"


_PART_TEXT = "select p_partkey, p_size, p_partkey % 4 as k, cast(p_size as varchar) as s from {part}"

_SQL = {
    "takeoff_summary": f"""
select level, canonical_section, count(*) as n, count(length_in) as n_with_length, coalesce(sum(length_in), 0) / 12 as total_lf,
  count(*) - count(length_in) as unknown_lengths, count(*) filter (where color in ('yellow', 'red')) as needs_review
from ({_COLOR}) where review_state <> 'excluded' group by level, canonical_section""",
    "member_status_color": f"select color, member_type, count(*) as n, count(*) filter (where color in ('yellow', 'red')) as needs_review from ({_COLOR}) group by 1, 2",
    "members_projection": f"""
select l_orderkey, l_partkey, l_suppkey, l_linenumber, canonical_section, color, length_in / 12 as length_ft, {_FT} as length_text
from (select *, cast(round(abs(length_in) * 16) as bigint) as u from ({_COLOR}))""",
    "top_sections": "select canonical_section, member_type, count(*) as n from {member} group by 1, 2 order by n desc, 1, 2 limit 40",
    "label_validate": """
select canonical_section, s.label is not null as validated, count(*) as n,
  min(case when s.label is not null then least(confidence_id + 0.03, 1) else least(confidence_id, 0.5) end) as least,
  max(case when s.label is not null then least(confidence_id + 0.03, 1) else least(confidence_id, 0.5) end) as most
from {member} m left join {shape} s on m.canonical_section = s.label group by 1, 2""",
    "designation_extract": r"""
select p_partkey, nullif(regexp_extract(t, p, 2), '') as family, cast(nullif(regexp_extract(t, p, 3), '') as integer) as depth, cast(nullif(regexp_extract(t, p, 4), '') as double) as weight
from (select p_partkey, '(^|[^A-Z0-9])(WT|MT|ST|HP|MC|W|M|S|C)([0-9]{1,2})X([0-9]{1,4})($|[^A-Z0-9/.])' as p,
  concat('TYP ', ['W', 'HP', 'MC', 'X'][p_partkey % 4 + 1], cast(p_size as varchar), 'X', cast(p_partkey % 97 as varchar), ' (E)') as t from {part})""",
    "chain_merge": f"with {_CHAINS} select page, y, dashed, island, x0, x1, pieces, x1 - x0 as chain_length from chains",
    "label_chain_associate": f"""
with {_CHAINS},
hit as (
  select s.span_id, s.size, c.y as cy, c.x0, c.x1, c.dashed, abs(s.y - c.y) as off
  from {{span}} s join chains c on s.page = c.page and abs(s.y - c.y) <= greatest(10, 2.5 * s.size)
    and (s.x - c.x0) / greatest(c.x1 - c.x0, 1e-9) between -0.15 and 1.15),
b as (select *, row_number() over (partition by span_id order by off, cy, x0, x1, dashed) as r, count(*) over (partition by span_id) as hits from hit)
select s.span_id, s.page, b.cy as line_y, b.x0 as line_x0, b.x1 as line_x1, cast(coalesce(hits - 1, 0) as bigint) as competing,
  case when b.cy is null then 0e0 else greatest(0.9e0 - 0.2e0 * (hits - 1), 0.35e0) - case when off > 0.6e0 * greatest(10, 2.5 * b.size) then 0.1e0 else 0e0 end - case when b.dashed then 0.1e0 else 0e0 end end as confidence
from {{span}} s left join b on s.span_id = b.span_id and b.r = 1""",
    "grid_nearest": """
with p as (select span_id, page, 'v' as axis, x as at from {span} union all select span_id, page, 'h', y from {span}),
h as (select p.span_id, p.axis, g.label, row_number() over (partition by p.span_id, p.axis order by abs(p.at - g.coord), g.coord, g.label) as r
  from p join {grid} g on p.page = g.page and p.axis = g.axis and abs(p.at - g.coord) <= 12),
n as (select span_id, string_agg(label, '/' order by regexp_matches(label, '^[0-9]'), label) as grid from h where r = 1 group by span_id)
select s.span_id, n.grid from {span} s left join n on s.span_id = n.span_id""",
    "column_stacks": """
with a as (select *, cast(floor(x / 2) as bigint) as bucket from {span}),
b as (select *, y - lag(y) over w as gap, greatest(size, lag(size) over w) as big from a window w as (partition by page, bucket order by y, span_id)),
c as (select *, sum(case when gap <= 3 * big then 0 else 1 end) over (partition by page, bucket order by y, span_id rows unbounded preceding) as run from b)
select span_id, page, bucket, cast(run as bigint) as run, count(*) over (partition by page, bucket, run) as in_run, count(*) over (partition by page, bucket, run) >= 3 as stacked from c""",
    "row_cluster_lag": """
with a as (select *, case when y - lag(y) over (partition by page order by y, x, span_id) <= 3 then 0 else 1 end as fresh from {span}),
b as (select *, sum(fresh) over (partition by page order by y, x, span_id rows unbounded preceding) as row_no from a)
select page, cast(row_no as bigint) as row_no, count(*) as n, min(y) as y0, max(y) as y1 from b group by 1, 2""",
    "forward_fill_family": """
select span_id, page, last_value(case when span_id % 7 = 0 then text end ignore nulls) over (partition by page order by span_id rows between unbounded preceding and current row) as family_filled from {span}""",
    "nearest_swatch": """
with m as (select s_suppkey % 40 as page, cast(s_suppkey * 7 % 100 as double) as y, s_suppkey as mark_id from {supplier}),
h as (select s.span_id, m.mark_id, abs(s.y - m.y) as off, row_number() over (partition by s.span_id order by abs(s.y - m.y), m.mark_id) as r from {span} s join m on s.page = m.page and abs(s.y - m.y) <= 6)
select s.span_id, s.page, h.mark_id, h.off from {span} s left join h on s.span_id = h.span_id and h.r = 1""",
    "swatch_reuse_qa": """
with i as (select p_brand as mark, p_partkey as seq, (p_partkey % 3) / 4e0 as value, p_size % 2 + 3 as sides from {part}),
f as (select *, first_value(value) over (partition by mark order by seq) as first_value, first_value(sides) over (partition by mark order by seq) as first_sides from i)
select * from f where first_value <> value or first_sides <> sides""",
    "geometry_functions": """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sqrt((x1 - x0) * (x1 - x0) + l_linenumber * l_linenumber), 6) as len,
  round(degrees(atan2(l_linenumber, x1 - x0)), 6) as angle, 0.0e0 as t, cast(l_linenumber as double) as off, ceil(x1 / 7 * 16 - 1e-9) / 16 as sixteenths from {segment}""",
    "rating_hours_parse": """
select p_partkey, case p_partkey % 6 when 0 then 1.0e0 when 1 then 1.5e0 when 2 then p_size * 5 / 60e0 when 3 then 0.75e0 when 4 then 2.5e0 end as hours from {part}""",
    "dimension_parse": f"""
select p_partkey, length_in as inches, {_FT} as text
from (select *, cast(round(abs(length_in) * 16) as bigint) as u from (
  select p_partkey, case k when 0 then p_size * 12 + 6e0 when 1 then p_size * 12 + 3.5e0 when 2 then 0.75e0 end as length_in from ({_PART_TEXT})))""",
    "scale_parse": f"select p_partkey, case k when 0 then 96e0 / 72 when 1 then p_size * 12e0 / 72 when 2 then (case when p_size + 9 >= 10 then (p_size + 9) / 72e0 end) end as inches_per_point from ({_PART_TEXT})",
    "phrase_match": r"""
select p_partkey, contains(concat(' ', regexp_replace(lower(concat_ws(' ', p_name, p_brand, p_type)), '[^a-z0-9/]+', ' ', 'g'), ' '),
  concat(' ', regexp_replace(lower(case when p_partkey % 2 = 0 then string_split(p_name, ' ')[-1] else concat('rand#', cast(p_size as varchar)) end), '[^a-z0-9/]+', ' ', 'g'), ' ')) as found from {part}""",
    "restraint_classify": f"""
select {_RESTRAINT.format('section')} as restraint, case when condition like '%half flange%' then 'half_flange_tip' else 'contour' end as application, count(*) as n from {{chart_cell}} group by 1, 2""",
    "route_ul_table": f"with {_ROUTES} select query_id, seq, thickness_in from ul",
    "route_chart": f"with {_ROUTES} select query_id, seq, thickness_in, products from ch",
    "route_equation": f"with {_ROUTES} select query_id, seq, thickness_in from eq",
    "ratio_lookup": f"with {_ROUTES} select query_id, f.ratio, case when f.ratio is not null then 'W/D' end as ratio_kind from {{query_set}} q left join firsts f on q.design = f.design and q.member = f.canonical",
    "xref_closure": """
with recursive walk as (
  select distinct design, design as target, [design] as path, design as txt from {xref}
  union all
  select w.design, x.target, list_append(w.path, x.target), concat(w.txt, '>', x.target) from walk w join {xref} x on w.target = x.design
  where not list_contains(w.path, x.target))
select design, target, txt as path from walk""",
    "resolve_status": f"with {_ROUTES}, {_LADDER} select status, count(*) as n from res group by 1",
    "resolve_all": f"with {_ROUTES}, {_LADDER} select query_id, status, case when status = 'resolved' then any_value end as thickness_in, cast(n_candidates as bigint) as n_candidates, cast(n_values as bigint) as n_values from res",
    "resolve_conflicts": f"with {_ROUTES}, {_LADDER} select query_id, cast(n_values as bigint) as n_values, least, most from res where status = 'conflict'",
    "candidate_dedupe": f"""
with {_ROUTES}, g as (select method, count(*) as k from cand group by query_id, method, thickness_in, design, products, condition, section)
select method, count(*) as n, cast(sum(k - 1) as bigint) as copies from g group by method""",
    "joist_collapse": f"""
with facts as (select chart_id, list_distinct(list({_RESTRAINT.format('section')}) filter (where section is not null)) as rs from {{chart_cell}} group by chart_id),
c as (
  select q.query_id, c.thickness_in, c.chart_id, c.section, c.seq from {{query_set}} q join {{chart_cell}} c on q.design = c.design and c.depth_in = 10 + 2 * (q.query_id % 6) and abs(c.hours - q.rating_hours) < 1e-6
    join facts f on c.chart_id = f.chart_id
  where c.condition not like '%half flange%' and (q.restraint is null or case when c.section is not null then {_RESTRAINT.format('c.section')} = q.restraint else rs is null or len(rs) = 0 or rs = [q.restraint] end))
select query_id, thickness_in, chart_id, section, min(seq) as seq,
  case when count(*) > 1 then concat(cast(count(*) as varchar), ' designations: ', string_agg(concat('R', cast(seq as varchar)), ', ' order by seq, concat('R', cast(seq as varchar)))) else min(concat('R', cast(seq as varchar))) end as row_label
from c group by query_id, thickness_in, chart_id, section""",
    "surface_basis": f"with {_QUANTITY} select method, status, count(*) as n, round(min(perimeter_in), 6) as least, round(max(perimeter_in), 6) as most from qt group by 1, 2",
    "quantity_by_condition": f"""
with {_QUANTITY} select design, '?' as product, thickness_in, cast(sides as bigint) as sides, count(*) as members, sum(length_in) / 12 as linear_ft, round(sum(sq_ft), 4) as sq_ft, round(sum(bd_ft), 4) as bd_ft
from qt where status = 'ok' group by design, thickness_in, sides""",
    "quantity_by_level": f"with {_QUANTITY} select level, count(*) as members, sum(length_in) / 12 as linear_ft, round(sum(sq_ft), 4) as sq_ft, round(sum(bd_ft), 4) as bd_ft from qt where status = 'ok' group by level",
    "quantity_totals": f"""
with {_QUANTITY}, t as (
  select count(*) as members, count(*) filter (where status = 'ok') as members_quantified, coalesce(sum(length_in) filter (where status = 'ok'), 0) / 12 as linear_ft,
    coalesce(sum(sq_ft), 0) as sq_ft, coalesce(sum(bd_ft), 0) as bd_ft from qt)
select members, members_quantified, linear_ft, round(sq_ft, 4) as sq_ft, round(bd_ft, 4) as bd_ft, round(bd_ft * 1.25, 4) as bd_ft_adjusted, cast(ceil(bd_ft * 1.25 / 18) as bigint) as bags, cast(ceil(bd_ft / 18) as bigint) as bags_theoretical from t""",
    "quantity_grouping_sets": f"with {_QUANTITY} select level, thickness_in, count(*) as members, sum(length_in) as length_in, cast(grouping_id(level, thickness_in) as integer) as gid from qt where status = 'ok' group by cube (level, thickness_in)",
    "bid_check": f"""
with {_ROUTES}, {_LADDER}, among as (select distinct query_id, thickness_in from cand)
select r.query_id, r.submitted_in, r.status, case when r.status = 'resolved' and r.any_value is null then 'not-rated'
  when r.status = 'resolved' then case when abs(r.any_value - r.submitted_in) < 1e-6 then 'match' else 'differs' end
  when r.status = 'conflict' then case when a.query_id is not null then 'match-one-route' else 'differs' end
  when r.status = 'review' and a.query_id is not null then 'review-match' else r.status end as verdict
from res r left join among a on r.query_id = a.query_id and r.submitted_in = a.thickness_in""",
    "current_assignment": f"with {_CURRENT} select id, member_id, scenario_id, thickness_in from cur",
    "supersession_audit": """
select a.id, a.supersedes_id, b.thickness_in as before, a.thickness_in as after, a.thickness_in is distinct from b.thickness_in as changed
from {assignment} a join {assignment} b on a.supersedes_id = b.id""",
    "review_queue": f"with {_OPEN} select item_id, category from open_items",
    "resolution_meter": f"""
with {_CURRENT}, {_OPEN},
v as (select member_id, thickness_in is not null as valued from cur where scenario_id = '2-HIGH')
select (select count(*) from customer) as members, (select count(*) from v where member_id in (select c_custkey from customer)) as assigned,
  (select count(*) from v where not valued and member_id in (select c_custkey from customer)) as unresolved,
  (select count(*) from open_items) as open_items, (select count(*) from open_items where category = 'conflict') as open_conflicts""",
    "stage_snapshot": f"""
with {_CURRENT}
select c_custkey as member_id, a.id as design_id, b.id as rating_id from {{customer}}
left join cur a on a.member_id = c_custkey and a.scenario_id = '1-URGENT' left join cur b on b.member_id = c_custkey and b.scenario_id = '2-HIGH'""",
    "assertion_kinds": f"""
with {_ROUTES}, {_LADDER}, k as (select case when status = 'resolved' and method = 'ul_equation' then 'CALCULATION' when status = 'resolved' then 'FACT' else 'ASSUMPTION' end as kind, status from res)
select kind, case kind when 'FACT' then 0.98e0 when 'CALCULATION' then 0.95e0 else 0.0e0 end as confidence, case when status <> 'resolved' then status end as review_category, count(*) as n from k group by 1, 2, 3""",
    "accuracy_score": """
with m as (select case when l_suppkey % 10 < 7 then 'match' when l_suppkey % 10 = 7 then 'duplicate' when l_suppkey % 10 = 8 then 'false_positive' else 'missed' end as kind, (l_partkey % 16) / 64e0 as e from {member} where length_in is not null),
s as (select e, row_number() over (order by e) - 1 as i, count(*) over () as n from m where kind = 'match'),
c as (select count(*) filter (where kind = 'match') as matched, count(*) filter (where kind = 'duplicate') as duplicates, count(*) filter (where kind = 'false_positive') as false_positives, count(*) filter (where kind = 'missed') as missed from m)
select matched * 1e0 / (matched + missed) as recall, matched * 1e0 / (matched + duplicates + false_positives) as precision, matched, duplicates, false_positives, missed,
  (select e from s where i = n // 2) as median_error, (select e from s where i = cast(floor(0.95 * (n - 1)) as bigint)) as p95_error from c""",
    "manifest_latest": f"with {_LATEST} select url, event_id, status from latest",
    "manifest_stream_fold": f"with {_LATEST} select url, event_id, status from latest",
    "manifest_previous": """
with g as (select * from {manifest} where status in ('fetched', 'unchanged', 'manual')),
u as (select url, event_id from (select *, row_number() over (partition by url order by fetched_at desc, event_id desc) as r from g) where r = 1),
i as (select source_id, event_id from (select *, row_number() over (partition by source_id order by fetched_at desc, event_id desc) as r from g) where r = 1),
a as (select distinct url, source_id from {manifest} where status = 'error')
select a.url, a.source_id, coalesce(u.event_id, i.event_id) as previous_event, case when u.url is not null then 'url' when i.source_id is not null then 'id' end as found_by
from a left join u on a.url = u.url left join i on a.source_id = i.source_id""",
    "coverage_by_manufacturer": f"""
with {_LATEST},
l as (select url, string_split(stored_path, '/')[1] as manufacturer from latest),
r as (select t.*, coalesce(l.manufacturer, string_split(t.url, '/')[3]) as manufacturer from {{route_result}} t left join l on t.url = l.url),
d as (select manufacturer, design, max(n_tables) as t from r where kind = 'listing' group by 1, 2),
x as (
  select manufacturer, count(*) as documents, 0 as charts, 0 as listings, 0 as chart_rows, 0 as w, 0 as wo from l group by 1
  union all select manufacturer, 0, count(*) filter (where kind = 'chart'), count(*) filter (where kind = 'listing'), coalesce(sum(n_rows) filter (where kind = 'chart'), 0), 0, 0 from r group by 1
  union all select manufacturer, 0, 0, 0, 0, count(*) filter (where t > 0), count(*) filter (where t = 0) from d group by 1)
select manufacturer, cast(sum(documents) as bigint) as documents, cast(sum(charts) as bigint) as charts, cast(sum(listings) as bigint) as listings, cast(sum(chart_rows) as bigint) as chart_rows,
  cast(sum(w) as bigint) as designs_with_tables, cast(sum(wo) as bigint) as designs_without_tables from x group by manufacturer""",
    "page_links": """
select page_id, count(distinct href) as n from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href from {pages}) group by page_id""",
    "new_links": """
with l as (select distinct page_id, href from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href from {pages}))
select href, count(distinct page_id) as n_pages from l where href not in (select href from l where page_id % 10 = 0) group by href""",
    "manual_match": """
with d as (select distinct concat(p_name, ' ', cast(p_size as varchar), '.PDF') as name from {part}),
r as (select regexp_replace(lower(concat(p_name, '-', cast(p_size as varchar), '.pdf')), '[^a-z0-9]', '', 'g') as key, min(p_partkey) as ord from {part} where p_size % 2 = 0 group by 1)
select d.name, case when r.ord is not null then concat('m', cast(r.ord as varchar)) end as registry_id from d left join r on regexp_replace(lower(d.name), '[^a-z0-9]', '', 'g') = r.key""",
    "media_by_folder": "select source as folder, count(*) as files, cast(sum(n_chars) as bigint) as bytes, max(n_chars) as largest from {documents} group by 1",
    "entries_by_decade": "select cast(year(l_shipdate) - year(l_shipdate) % 10 as integer) as decade, count(*) as n from {lineitem} group by 1",
    "import_states": """
select case when r = 1 then 'new' else 'unchanged' end as state, count(*) as n
from (select row_number() over (partition by url, event_id % 3 order by fetched_at, event_id) as r from {manifest}) group by 1""",
    "workbook_tidy": """
select p_partkey, p_brand, h as hours, mils from (
  select p_partkey, p_brand, 1.0e0 as h, case when p_partkey % 2 <> 0 then p_size end as mils from {part}
  union all select p_partkey, p_brand, 2.0e0, case when p_partkey % 3 <> 0 then p_size * 2 end from {part}
  union all select p_partkey, p_brand, 3.0e0, case when p_partkey % 4 <> 0 then p_size * 3 end from {part}) where mils is not null""",
}
_SQL["bid_verdicts"] = f"select verdict, count(*) as n from ({oracle(_SQL['bid_check'])}) group by 1"
_SQL["keyword_scores"] = _scores()
_SQL["doc_classify"] = f"""
with s as ({_scores()}),
r as (select doc_id, list_sort([{{'s': -score_chart, 'n': 'chart'}}, {{'s': -score_drawing, 'n': 'drawing'}}, {{'s': -score_license, 'n': 'license'}}, {{'s': -score_listing, 'n': 'listing'}}]) as l from s),
c as (select doc_id, -l[1].s as best, l[1].n as name, least(greatest(0.3e0 + -l[1].s * 0.1e0 - -l[2].s * 0.05e0, 0), 0.95e0) as conf from r)
select doc_id, cast(best as bigint) as best_score, round(conf, 4) as confidence, case when conf >= 0.45 - 1e-9 and best >= 2 then name else 'unclassified' end as doc_class from c"""

_SQL |= {
    "designation_all": """
select family, canonical, count(*) as n, max(confidence) as confidence from (
  select 'W' as family, text as canonical, 0.95e0 as confidence from {span} union all select 'HSS_ROUND', 'HSS6X0.250', 0.95e0 from {span}
  union all select 'JOIST', concat('16K', cast(page % 9 + 1 as varchar)), 0.9e0 from {span}) group by 1, 2""",
    "chain_split": f"""
with {_CHAINS},
cut as (select distinct page, y - 3 as y, x from {{span}}),
hit as (select c.page, c.y, c.dashed, c.x0, c.x1, list_sort(list(cut.x) filter (where cut.x is not null)) as cuts
  from chains c left join cut on c.page = cut.page and c.y = cut.y and cut.x > c.x0 and cut.x < c.x1 group by all),
s as (select *, list_reduce(list_concat([[x0]], list_transform(coalesce(cuts, []), lambda v: [v])), lambda a, v: case when v[1] - a[-1] >= 6 and x1 - v[1] >= 6 then list_append(a, v[1]) else a end) as starts from hit),
p as (select *, unnest(range(1, len(starts) + 1)) as i from s)
select page, y, dashed, x0, x1, cast(i - 1 as integer) as piece, starts[i] as p0, case when i < len(starts) then starts[i + 1] else x1 end as p1 from p""",
    "row_cluster_first": """
with l as (select page, list_sort(list(distinct y)) as ys from {span} group by page),
s as (select page, list_reduce(list_transform(ys, lambda v: [v]), lambda a, v: case when v[1] - a[-1] > 2 then list_append(a, v[1]) else a end) as starts from l),
r as (select x.page, x.y, cast(len(list_filter(s.starts, lambda v: v <= x.y)) as integer) as row_no from {span} x join s on x.page = s.page)
select page, row_no, count(*) as n, min(y) as y0, max(y) as y1 from r group by 1, 2""",
    "slanted_chains": """
with a as (select *, (degrees(atan2(y1 - y0, x1 - x0)) + 360) % 180 as angle from {slanted} where sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) >= 0.5),
b as (select *, cast(round_even(angle / 2, 0) as integer) % 90 as slope, cast(round_even(width / 0.35, 0) as integer) as weight from a),
c as (select *, radians(arg_min(angle, seq) over (partition by page, slope, dashed, weight)) as r from b),
d as (select *, round(y0 * cos(r) - x0 * sin(r), 6) as off, round(x0 * cos(r) + y0 * sin(r), 6) as u0, round(x1 * cos(r) + y1 * sin(r), 6) as u1 from c),
e as (select *, least(u0, u1) as t0, greatest(u0, u1) as t1 from d),
f as (select *, case when off - lag(off) over w <= 0.75 then 0 else 1 end as jump from e window w as (partition by page, slope, dashed, weight order by off, t0, t1, seq)),
g as (select *, sum(jump) over (partition by page, slope, dashed, weight order by off, t0, t1, seq rows unbounded preceding) as band from f),
h as (select *, max(t1) over (partition by page, slope, dashed, weight, band order by off, t0, t1, seq rows between unbounded preceding and 1 preceding) as reached from g),
i as (select *, sum(case when reached is null or t0 > reached + 1.5 then 1 else 0 end) over (partition by page, slope, dashed, weight, band order by off, t0, t1, seq rows unbounded preceding) as island from h),
j as (select page, slope, dashed, weight, band, island, any_value(r) as r, avg(off) as off, min(t0) as t0, max(t1) as t1, max(width) as width, count(*) as parts from i group by 1, 2, 3, 4, 5, 6)
select page, slope, dashed, weight, cast(band as bigint) as band, cast(island as bigint) as island, width, parts,
  round(t0 * cos(r) - off * sin(r), 4) + 0e0 as x0, round(t0 * sin(r) + off * cos(r), 4) + 0e0 as y0, round(t1 * cos(r) - off * sin(r), 4) + 0e0 as x1, round(t1 * sin(r) + off * cos(r), 4) + 0e0 as y1 from j""",
    "grid_detect": """
with s as (select circle_id, page, cx, cy, r, label, circle_id % 2 = 0 as up, case when circle_id % 7 = 0 then 50e0 else 400e0 end as len from {bubble}),
l as (select circle_id as seg_id, page, up, case when up then cx else cx + r end as x0, case when up then cy + r else cy end as y0,
  case when up then cx else cx + r + len end as x1, case when up then cy + r + len else cy end as y1 from s where len >= 100),
b as (select t.circle_id as span_id, t.page, t.label, c.cx, c.cy, c.r, row_number() over (partition by t.circle_id order by c.circle_id) as k
  from s t join s c on t.page = c.page and c.r >= 4 and sqrt(pow(t.cx + 1 - c.cx, 2) + pow(t.cy - 1 - c.cy, 2)) <= 0.6 * c.r
  where regexp_matches(t.label, '^(?:[A-Z]{1,2}|[0-9]{1,2}|[A-Z]\\.[0-9]|[A-Z][0-9])$')),
n as (select b.span_id, b.page, b.label, b.r, l.seg_id, l.up, case when l.up then l.x0 else l.y0 end as coord,
  case when l.up then sqrt(pow(b.cx - l.x0, 2) + pow(b.cy - greatest(l.y0, least(l.y1, b.cy)), 2)) else sqrt(pow(b.cy - l.y0, 2) + pow(b.cx - greatest(l.x0, least(l.x1, b.cx)), 2)) end as off,
  least(sqrt(pow(b.cx - l.x0, 2) + pow(b.cy - l.y0, 2)), sqrt(pow(b.cx - l.x1, 2) + pow(b.cy - l.y1, 2))) as fin
  from b join l on b.page = l.page where b.k = 1),
m as (select *, row_number() over (partition by span_id order by off + 0.25 * fin, seg_id) as k from n where off <= 2.5 * r and fin <= 4 * r),
o as (select *, case when up then 'x' else 'y' end as axis, case when off + 0.25 * fin < r then 0.9e0 else 0.7e0 end as confidence from m where k = 1),
q as (select *, row_number() over (partition by page, label, axis order by confidence desc, span_id) as best from o)
select page, label, axis, coord, confidence from q where best = 1""",
    "grid_cuts": f"""
with {_CHAINS},
c as (select concat(cast(page as varchar), '/', cast(y as varchar), '/', cast(dashed as varchar), '/', cast(x0 as varchar)) as chain_id, page, y, x0, x1 from chains where x1 > x0),
g as (select page, case when axis = 'v' then 'x' else 'y' end as axis, case when axis = 'v' then coord else coord / 13 + 1 end as coord, label from {{grid}}),
a as (select distinct c.chain_id, (v.coord - c.x0) / (c.x1 - c.x0) as t, concat('grid intersection ', v.label) as why, c.x1 - c.x0 as len
  from c join g h on c.page = h.page and h.axis = 'y' and abs(c.y - h.coord) <= 1.5 join g v on v.page = c.page and v.axis = 'x' and v.coord > c.x0 and v.coord < c.x1),
b as (select distinct c.chain_id, (s.x - c.x0) / (c.x1 - c.x0) as t, 'column symbol' as why, c.x1 - c.x0 as len
  from c join {{span}} s on c.page = s.page and abs(s.y - c.y) <= 3 and s.x > c.x0 and s.x < c.x1),
u as (select chain_id, t, why from a union all select chain_id, t, why from b where not exists (select 1 from a where a.chain_id = b.chain_id and abs(a.t - b.t) * b.len <= 4))
select chain_id, why, count(*) as n, round(min(t), 6) as first, round(max(t), 6) as last from u group by 1, 2""",
    "sheet_scale": """
with s as (select page, span_id, span_id % 9 <> 0 as late, case when page in (9, 11) then null when span_id % 5 = 0 then 96e0 / 72 when span_id % 5 = 1 then 48e0 / 72 when span_id % 5 = 2 then 240e0 / 72 end as v from {span}),
k as (select page, arg_min(v, (late, span_id)) filter (v is not null) as v, min(late) filter (v is not null) as late, count(distinct round(v, 6)) as n from s group by page)
select page, round(case when page in (7, 9) then 2 else v end, 6) as inches_per_point, case when page in (7, 9) then 0.98e0 when n > 1 then 0.6e0 else 0.9e0 end as confidence,
  case when page in (7, 9) then 'manual' when late then 'sheet' else 'title_block' end as source, n as n_scales from k where v is not null or page in (7, 9)""",
    "rows_by_product": "select products, count(*) as n, cast(row_number() over (order by count(*) desc, products) as integer) as rank from {chart_cell} group by 1",
    "pdf_links": "select url, count(*) as n from {manifest} where contains(lower(url), 'host3.') and url like '%.pdf' group by 1",
    "allowed_links": "select url, status, count(*) as n from {manifest} where url like 'https://host1.example/%' or url like 'https://host4.example/%' group by 1, 2",
    "walked_files": """
select p_partkey, path from (select *, concat('top/', case p_partkey % 4 when 3 then 'keep/' else '' end, p_brand, '.pdf') as path from {part}
  where p_partkey % 4 in (0, 3) and p_partkey % 5 > 1) where not (p_brand like 'Brand#1_')""",
    "members_by_role": "select level, count(*) as n from {member} where member_type = 'beam' group by 1",
    "grid_listing": "select *, cast(row_number() over (partition by page order by axis, coord, label) as integer) as no from {grid}",
    "capped_report": f"""
with {_ROUTES}, r as (select *, row_number() over (partition by query_id order by authority, case when method = 'ul_table' then 0 else 1 end, seq, thickness_in, coalesce(chart_id, ''), coalesce(section, '')) as k from cand)
select query_id, count(*) as shown, min(thickness_in) as least, max(thickness_in) as most from r where k <= 4 group by 1""",
    "tube_names": """
with l as (select p_partkey, p_size, p_partkey % 4 as k, p_partkey % 5 as w,
  concat(case p_partkey % 4 when 0 then 'ST ' when 1 then 'RT' when 2 then 'hss ' else 'W' end, cast(p_size as varchar), ' x ', cast(p_size % 7 + 1 as varchar), 'x',
    case p_partkey % 5 when 0 then '3/8' when 1 then '.25' when 2 then '1' when 3 then '0.5' else 'x' end) as label from {part})
select p_partkey, label, case when k < 3 and w < 4 then concat('HSS', cast(p_size as varchar), 'X', cast(p_size % 7 + 1 as varchar), 'X', case w when 0 then '3/8' when 1 then '0.250' when 2 then '1' else '0.500' end) end as canonical from l""",
    "filled_across": """
with c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 3 = 1 then l_returnflag end as label from {lineitem})
select *, last_value(label ignore nulls) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding) as label_filled from c""",
    "header_groups": """
with a as (select o_custkey, o_orderkey as line, case when o_orderkey - lag(o_orderkey) over (partition by o_custkey order by o_orderkey) <= 900 then 0 else 1 end as fresh from {orders})
select o_custkey, line, cast(sum(fresh) over (partition by o_custkey order by line rows unbounded preceding) as bigint) as header_group from a""",
    "hour_groups": """
with a as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 4 + 1 as hours from {lineitem}),
b as (select *, case when hours > lag(hours) over w then 0 else 1 end as fresh from a window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey))
select l_orderkey, l_linenumber, l_partkey, l_suppkey, hours, cast(sum(fresh) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding) as bigint) as column_group from b""",
    "assign_bulk": """
with gone as (select supersedes_id from {assignment} where supersedes_id is not null),
now as (select member_id, id, row_number() over (partition by member_id, scenario_id order by created_at desc, cast(id as varchar) desc) as r from {assignment} where scenario_id = '2-HIGH' and id not in (select supersedes_id from gone)),
m as (select c_custkey as member_id, c_custkey % 11 as s from {customer} where c_custkey % 3 <> 0),
k as (select member_id, s, case when s > 8 then 'unknown' when s % 4 = 3 then 'conflict' else 'resolved' end as status from m)
select k.member_id, '2-HIGH' as scenario_id, status, case when status = 'resolved' then (s + 1) / 16e0 end as thickness_in, cast(now.id as varchar) as supersedes_id from k left join now on k.member_id = now.member_id and now.r = 1""",
    "listing_cells": """
with p as (select distinct p_partkey as k from {part}),
c as (select k, 1e0 as hours, (k % 7 + 1) / 16e0 as v from p union all select k, 2e0, case when k % 17 = 0 then null else k % 5 + 1.5e0 end from p)
select k as document, 'size_wd' as kind, concat('W', cast(8 + 2 * (k % 10) as varchar), 'X', cast(10 + k % 30 as varchar)) as canonical, (20 + k % 64) / 100e0 as ratio, hours,
  round(case when k % 2 = 0 then v / 1000 else v end, 8) as thickness_in, case when k % 3 = 0 then 'unrestrained' end as condition, case when v is null then 'not rated' end as note from c""",
}
_SQL["listing_record"] = """
with k as (select distinct p_partkey as p from {part}),
mils as (select p, p % 3 = 0 as m, case when p % 3 = 0 then 1e-3 else 1e0 end as s, chr(10) as nl from k),
x as (
  select p, 'design' as kind, null as item, null as sub, 0 as line_no, 1 as n_lines, concat('X', p % 900 + 100) as label, concat('Design No. X', p % 900 + 100) as text,
    null as printed, null as units, null as note, null as table_no, cast(null as double) as a, cast(null as double) as ratio_hi from mils
  union all select p, 'design_date', null, null, 1, 1, 'May 03, 2018', 'May 03, 2018', null, null, null, null, null, null from mils
  union all select p, 'rating', null, null, 2, 1, 'Ratings', concat('Ratings — 1, ', p % 3 + 2, ' Hr (See Item 2)'), null, null, 'See Item 2', null, null, null from mils
  union all select p, 'unparsed', null, null, 3, 1, null, concat('Stray words ', p), null, null, null, null, null, null from mils
  union all select p, 'item', '1', null, 4, 1, 'Steel Column', concat('1. Steel Column — Size ', p % 7), null, null, null, null, null, null from mils
  union all select p, case when p % 2 = 1 then 'sub_item' else 'text' end, '1', case when p % 2 = 1 then 'A' end, 5, 1, case when p % 2 = 1 then 'A' end,
    case when p % 2 = 1 then 'A. Bracing as shown below' else 'a plain sentence of the first item' end, null, null, null, null, null, null from mils
  union all select p, 'item', '2', null, 6, 1, 'Spray Material', concat('2. Spray Material — Applied in ', p % 5 + 1, ' coats'), null, null, null, null, null, null from mils
  union all select p, 'equation', '2', null, 7, 3, null, concat('R / h = / 0.', p % 90 + 10, ' (W/D) + 0.5'), null, null, null, null, (p % 90 + 10) / 100e0, p % 4 + 1 from mils
  union all select p, 'text', '2', null, 10, 1, null, concat('W/D in the range of 0.5 to ', p % 4 + 1), null, null, null, null, null, null from mils
  union all select p, 'maker', '2', null, 11, 1 + p % 2, concat('MAKER ', p % 9, ' CO'), concat('Types A and', case when p % 2 = 1 then ' Type B' else '' end), null, null, null, null, null, null from mils
  union all select p, 'text', '2', null, 12, 1, null, 'then text goes on in lower case', null, null, null, null, null, null from mils where p % 2 = 0
  union all select p, 'condition', '2', null, 13, 1, null, 'Sizes stand in the table below', null, null, null, null, null, null from mils
  union all select p, 'table', '2', null, 14, 4, 'size_wd', concat('W/D', nl, '1 Hr', nl, '2 Hr', nl, case when m then 'Thickness, mils' else 'Min Thkns In.' end), null,
    case when m then 'mils' else 'in' end, null, 1, null, null from mils
  union all select p, 'row', '2', null, 18, 4, concat('W8x', p % 30 + 10), concat('W8x', p % 30 + 10, nl, '0.', p % 64 + 20, nl, p % 7 + 1, '/8', nl, case when p % 5 = 0 then 'NR' else cast(p % 6 + 1 as varchar) end),
    concat(cast(round((p % 7 + 1) * 1000 * s) as bigint), ',', case when p % 5 = 0 then '-' else cast(cast(round((p % 6 + 1) * 8000 * s) as bigint) as varchar) end),
    case when m then 'mils' else 'in' end, null, 1, null, null from mils
  union all select p, 'furniture', '2', null, 21, 4, null, concat('4/24/2019', nl, 'RATINGS | Site', nl, 'https://example.org/p?e=1', nl, '2/3'), null, null, null, null, null, null from mils
  union all select p, 'row', '2', null, 26, 5, concat('W10 x ', p % 40 + 12), concat('W10 x ', p % 40 + 12, nl, '0.75', nl, '1-1/2*', nl, '2'), concat(cast(round(12000 * s) as bigint), ',', cast(round(16000 * s) as bigint)),
    case when m then 'mils' else 'in' end, '1-1/2*', 1, null, null from mils where p % 4 <> 0
  union all select p, 'unparsed', '2', null, 26, 4, null, concat('W10 x ', p % 40 + 12, nl, '0.75', nl, '1-1/2*'), null, null, 'cells do not fit the heads', 1, null, null from mils where p % 4 = 0
  union all select p, 'text', '2', null, 30, 1, null, 'a broken row', null, null, null, null, null, null from mils where p % 4 = 0
  union all select p, case when p % 5 = 0 and p % 4 <> 0 then 'legend' else 'text' end, '2', null, 31, 1, case when p % 5 = 0 and p % 4 <> 0 then 'NR' end, 'NR = No Rating', null, null, null,
    case when p % 5 = 0 and p % 4 <> 0 then 1 end, null, null from mils
  union all select p, 'updated', null, null, 32, 1, '2018-05-08', 'Last Updated on 2018-05-08', null, null, null, null, null, null from mils
  union all select p, 'notice', null, null, 33, 1, null, 'Notice.', null, null, null, null, null, null from mils)
select cast(p as varchar) as document, * exclude (p) from x"""
_CHARTED = """
with r as (select document, k, row_number() over (partition by document order by k) - 1 as i from (select distinct p_brand as document, p_partkey as k from {part}) d),
c as (select document, k, i, cast(i // 30 + 1 as integer) as page, concat(8 + 2 * (k % 10), 'X', 10 + k % 30) as size, (20 + k % 64) / 100e0 as ratio from r),"""
_SQL["chart_cells"] = (
    _CHARTED
    + """
v as (
  select *, 1 as group_no, 1e0 as hours, case when k % 17 = 0 then 'NR' else concat(k % 7 + 1, '/8') end as as_printed, (k % 7 + 1) / 8e0 as v from c
  union all select *, 1, 2e0, concat(k % 3 + 1, '-1/2'), k % 3 + 1.5e0 from c
  union all select *, 2, 1e0, case when k % 11 = 0 then '9' else concat(k % 5 + 1, '/16') end, case when k % 11 = 0 then 9e0 else (k % 5 + 1) / 16e0 end from c
  union all select *, 2, 2e0, cast(k % 4 + 1 as varchar), k % 4 + 1e0 from c where k % 13 <> 0)
select document, page, group_no, case group_no when 1 then 'NORMAL WEIGHT' else 'LIGHT WEIGHT' end as title, concat('W', size) as label, concat('W', size) as canonical, 'W/D' as ratio_name,
  ratio, hours, as_printed, case when as_printed not in ('NR', '9') then v end as thickness_in, case as_printed when 'NR' then 'not rated' when '9' then 'too thick' end as note
from v"""
)
_SQL["chart_runs"] = (
    _CHARTED
    + """
p as (select document, page, count(*) as n, count(*) filter (k % 19 <> 0) as fits from c group by document, page)
select document, page, case when page = 2 then 'continued' else 'table' end as kind, case when page = 2 then 1 else page end as head_page, case when page > 2 then 3 else 2 end as n_ratings,
  case when page > 2 and fits > 0 then 3 when page > 2 then 0 else 1 end as ratios, fits, n as rows, '' as targets from p
union all select document, 0, 'cross_reference', null, null, null, null, null, concat('S', 700 + k % 50) from c where i = 0"""
)
_SQL["chart_lines"] = (
    _CHARTED
    + """
l as (select *, i % 30 + 1 as line_no, concat('W', replace(size, 'X', 'x')) as label, concat('W', size) as canonical from c),
v as (
  select *, 1e0 as hours, case when k % 17 = 0 then 'NR' else concat(k % 7 + 1, '/8') end as as_printed, case when k % 17 <> 0 then (k % 7 + 1) / 8e0 end as v from l where k % 19 <> 0
  union all select *, case when page > 2 then 2e0 else 1.5e0 end, concat(k % 3 + 1, '-1/2'), k % 3 + 1.5e0 from l where k % 19 <> 0
  union all select *, 3e0, '3', 3e0 from l where k % 19 <> 0 and page > 2)
select document, page, line_no, label, canonical, ratio, case when page > 2 then 3 else 1 end as n_ratios, hours, as_printed, v as thickness_in, case when v is null then 'not rated' end as note from v
union all select document, page, line_no, label, canonical, null, 0, null, null, null, 'cells do not fit the layout' from l where k % 19 = 0"""
)
_PLANE = """
with c as (
  select page, key as chain_id, x0, y0, x1, y1, dashed, x1 - x0 as dx, y1 - y0 as dy, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as len,
    (degrees(atan2(y1 - y0, x1 - x0)) + 360) % 180 as ang from {slanted} where x1 <> x0 or y1 <> y0),
g as (select page, case when axis = 'v' then 'x' else 'y' end as axis, case when axis = 'v' then coord / 26 else coord / 13 + 1 end as coord, label from {grid}),"""
_SQL["slanted_crossings"] = (
    _PLANE
    + """
p as (
  select c.page, c.chain_id, ((o.x0 - c.x0) * o.dy - (o.y0 - c.y0) * o.dx) / (c.dx * o.dy - c.dy * o.dx) as t, ((o.x0 - c.x0) * c.dy - (o.y0 - c.y0) * c.dx) / (c.dx * o.dy - c.dy * o.dx) as u, o.len
  from c join c o on c.page = o.page and c.chain_id <> o.chain_id and abs(c.dx * o.dy - c.dy * o.dx) >= 1e-9
    and least(abs(c.ang - o.ang) % 180, 180 - abs(c.ang - o.ang) % 180) >= 30),
x as (
  select page, 'member' as kind, chain_id, t from p where t > 0 and t < 1 and u >= -3 / greatest(len, 1) and u <= 1 + 3 / greatest(len, 1)
  union all select c.page, 'grid', chain_id, (coord - x0) / dx from c join g on c.page = g.page and axis = 'x' and abs(dx) > 1e-6 and (coord - x0) / dx > 0 and (coord - x0) / dx < 1
  union all select c.page, 'grid', chain_id, (coord - y0) / dy from c join g on c.page = g.page and axis = 'y' and abs(dy) > 1e-6 and (coord - y0) / dy > 0 and (coord - y0) / dy < 1)
select page, kind, count(*) as n, count(distinct chain_id) as n_chains, round(sum(t), 3) as sum_t from x group by 1, 2"""
)
_SQL["slanted_cuts"] = (
    _PLANE
    + """
m as (select distinct page, x / 4 as px, y as py from {span}),
a as (
  select c.page, c.chain_id, c.len, ((px - x0) * dx + (py - y0) * dy) / (len * len) as t from c join m on c.page = m.page and abs((px - x0) * dy - (py - y0) * dx) / len <= 3),
r as (
  select distinct c.page, chain_id, len, 'x' as axis, y0 as s, dy as d from c join g on c.page = g.page and axis = 'x' and least(abs(ang - 90), 180 - abs(ang - 90)) < 2 and abs(x0 - coord) <= 1.5
  union all select distinct c.page, chain_id, len, 'y', x0, dx from c join g on c.page = g.page and axis = 'y' and least(ang, 180 - ang) < 2 and abs(y0 - coord) <= 1.5),
b as (
  select r.page, chain_id, len, (coord - s) / d as t, concat('grid intersection ', label) as why from r join g on r.page = g.page and r.axis <> g.axis where (coord - s) / d > 0 and (coord - s) / d < 1),
u as (
  select page, t, why from b
  union all select page, t, 'column symbol' from a where t > 0 and t < 1 and not exists (select 1 from b where a.page = b.page and a.chain_id = b.chain_id and abs(a.t - b.t) * a.len <= 4))
select page, why, count(*) as n, round(min(t), 6) as first, round(sum(t), 3) as sum_t from u group by 1, 2"""
)
_SQL["slanted_associate"] = (
    _PLANE
    + """
s as (select span_id, page, x / 4 as px, y as py, greatest(10, 2.5e0 * size) as reach, span_id % 4 * 45e0 as rot from {span}),
n as (
  select span_id, reach, chain_id, dashed, abs((px - x0) * dy - (py - y0) * dx) / len as off, ((px - x0) * dx + (py - y0) * dy) / (len * len) as t
  from s join c on s.page = c.page and least(abs(ang - rot) % 180, 180 - abs(ang - rot) % 180) <= 3 and abs((px - x0) * dy - (py - y0) * dx) / len <= reach),
b as (select span_id, count(*) as n, min(off) as off, arg_min(dashed, (off, chain_id)) as dashed from n where t between -0.15 and 1.15 group by span_id)
select span_id, round(off, 6) as off, coalesce(n - 1, 0) as competing,
  round(case when b.n is null then 0e0 else greatest(0.35e0, 0.9e0 - 0.2e0 * (b.n - 1)) - case when off > 0.6e0 * reach then 0.1e0 else 0e0 end - case when dashed then 0.1e0 else 0e0 end end, 6) as confidence
from s left join b using (span_id)"""
)
_SQL["column_symbols"] = """
with e as (
  select s_suppkey as k, s_suppkey % 40 as page, i, (s_suppkey // 40) % 50 * 40e0 + case i when 1 then 1 when 3 then -1 else 0 end * (s_suppkey % 5 + 6) / 2e0 as x,
    (s_suppkey // 2000) * 40e0 + case i when 0 then -1 when 2 then 1 else 0 end * (s_suppkey % 5 + 6) / 2e0 as y
  from supplier, (select unnest([0, 1, 2, 3]) as i) where s_suppkey % 7 <> 0),
f as (select page, k, arg_min(x, i) as x, arg_min(y, i) as y from e group by page, k, round_even(x / 6, 0), round_even(y / 6, 0))
select page, round(avg(x), 6) as x, round(avg(y), 6) as y, count(*) as edges from f group by page, k"""
_REQUESTS = """
with r as (
  select o_orderkey as k, lpad(cast(o_orderkey as varchar), 12, '0') as request, case o_orderkey % 5 when 0 then 'interpretation' when 1 then 'rating' when 2 then 'exposure' when 3 then 'condition' else 'design' end as what,
    cast(o_custkey as varchar) as member_id, left(o_orderpriority, 1) as scenario_id, o_orderkey % 13 = 0 as chosen, o_orderkey % 7 > 1 as resolved, o_orderdate as made from {orders}),
s as (
  select *, case when chosen then 'override' when k % 7 = 0 then 'conflict' when k % 7 = 1 then 'unknown' else 'resolved' end as status, case when chosen or resolved then (k % 20 + 1) / 16e0 end as value,
    case when chosen then 'HUMAN_OVERRIDE' when not resolved then 'ASSUMPTION' when k % 3 = 0 then 'CALCULATION' else 'FACT' end as kind,
    case when chosen then 1e0 when not resolved then 0e0 when k % 3 = 0 then 0.95e0 else 0.98e0 end as confidence from r)"""
_SQL["change_log"] = (
    _REQUESTS
    + """,
p as (select s.*, lag(request) over w as supersedes, lag(status) over w as before, row_number() over w as i from s window w as (partition by what, member_id, scenario_id order by made, request)),
closing as (
  select c.request, count(o.request) as n from p c left join p o on o.what = c.what and o.member_id = c.member_id and o.scenario_id = c.scenario_id and o.i < c.i and o.kind = 'ASSUMPTION'
    and not exists (select 1 from p m where m.what = c.what and m.member_id = c.member_id and m.scenario_id = c.scenario_id and m.chosen and m.i > o.i and m.i < c.i)
  where c.chosen group by c.request)
select p.request, supersedes, what, member_id, scenario_id, status, value, kind, confidence, before,
  case when chosen then cast(n as integer) when kind = 'ASSUMPTION' then 1 else 0 end as n_review, case when chosen and n > 0 then 'resolved' when kind = 'ASSUMPTION' then 'open' end as review
from p left join closing using (request)"""
)
_SQL["stage_freeze"] = (
    _REQUESTS
    + """,
l as (select *, row_number() over (partition by what, member_id order by made desc, request desc) as i from s where scenario_id = '1'),
c as (select * from l where i = 1)
select cast(c_custkey as varchar) as member_id, max(status) filter (what = 'interpretation') as interpretation, max(status) filter (what = 'rating') as rating, max(status) filter (what = 'exposure') as exposure,
  max(status) filter (what = 'condition') as condition, max(status) filter (what = 'design') as design, max(value) filter (what = 'design') as thickness_in
from {customer} left join c on c.member_id = cast(c_custkey as varchar) group by c_custkey"""
)
_SQL["resolve_reasons"] = f"""
with facts as (select chart_id, list_sort(list_distinct(list({_RESTRAINT.format('section')}) filter (where section is not null))) as rs from {{chart_cell}} group by chart_id),
u as (
  select q.query_id, 'ul_table' as route, {_RESTRAINT.format('c.condition')} as printed, c.hours, c.thickness_in, q.restraint, q.rating_hours, true as product_ok, true as application_ok,
    q.restraint is null or {_RESTRAINT.format('c.condition')} is null or {_RESTRAINT.format('c.condition')} = q.restraint as restraint_ok, null as products, null as application
  from {{query_set}} q join {{ul_cell}} c on q.design = c.design and q.member = c.canonical
  union all
  select q.query_id, 'chart_table', coalesce({_RESTRAINT.format('c.section')}, array_to_string(coalesce(rs, []), ', ')), c.hours, c.thickness_in, q.restraint, q.rating_hours, {_PHRASE}, c.condition not like '%half flange%',
    q.restraint is null or case when c.section is not null then {_RESTRAINT.format('c.section')} = q.restraint else len(rs) = 0 or rs is null or rs = [q.restraint] end, c.products,
    case when c.condition like '%half flange%' then 'half_flange_tip' else 'contour' end
  from {{query_set}} q join {{chart_cell}} c on q.design = c.design and q.member = c.canonical join facts f on f.chart_id = c.chart_id),
s as (
  select *, case when not product_ok then 0 when not application_ok then 1 when not restraint_ok then 3 when abs(hours - rating_hours) >= 1e-6 then 4 when thickness_in is null then 5 else 6 end as fell from u),
t as (select *, case fell when 0 then products when 1 then application when 3 then printed when 4 then cast(hours as varchar) end as said, max(fell) over (partition by query_id, route) as reached from s),
g as (
  select query_id, route, max(reached) as reached, count(*) as n, count(*) filter (fell > 3) as a3, count(*) filter (fell > 4) as a4, count(*) filter (fell > 5) as a5,
    array_to_string(list_sort(list_distinct(list(said) filter (fell = reached and said is not null))), '|') as seen from t group by 1, 2),
k as (select distinct design, 'ul_table' as route from {{ul_cell}} union select distinct design, 'chart_table' from {{chart_cell}}),
r as (select query_id, design, route from {{query_set}}, (select unnest(['ul_table', 'chart_table']) as route))
select r.query_id, r.route, case when k.design is null then 'design not in the library' when n is null then 'member not printed' when reached = 0 then 'product' when reached = 1 then 'application' when reached = 3 then 'restraint'
    when reached = 4 then 'column' when reached = 5 then 'rated' else 'found' end as reason,
  coalesce(n, 0) as n_rows, coalesce(a3, 0) as after_restraint, coalesce(a4, 0) as after_column, coalesce(a5, 0) as after_rated, coalesce(seen, '') as seen
from r left join k on r.design = k.design and r.route = k.route left join g on g.query_id = r.query_id and g.route = r.route"""
_BID = f"""
with {_ROUTES}, {_LADDER}, among as (select distinct query_id, thickness_in from cand)
select q.item_id, q.member, q.design, q.rating_hours, q.submitted_in, r.status, case when r.status = 'resolved' then r.any_value end as thickness_in,
  case when r.status = 'resolved' and r.any_value is null then 'not-rated' when r.status = 'resolved' then case when abs(r.any_value - r.submitted_in) < 1e-6 then 'match' else 'differs' end
  when r.status = 'conflict' then case when a.query_id is not null then 'match-one-route' else 'differs' end when r.status = 'review' and a.query_id is not null then 'review-match' else r.status end as verdict
from {{query_set}} q join res r on q.query_id = r.query_id left join among a on r.query_id = a.query_id and r.submitted_in = a.thickness_in
union all
select o_orderkey, concat('W', 8 + 2 * (o_orderkey % 10), 'X', 10 + o_orderkey % 30), null, null, (4 + o_orderkey % 20) / 16e0, 'no-design', null, 'no-design' from {{orders}} where o_custkey % 9 = 0 and o_orderkey % 11 <> 0"""
_SQL["report_check"] = (
    f"""
with {_ROUTES}, {_LADDER}, among as (select distinct query_id, thickness_in from cand),
v as (
  select q.*, r.status, case when r.status = 'resolved' and r.any_value is null then 'not-rated' when r.status = 'resolved' then case when abs(r.any_value - r.submitted_in) < 1e-6 then 'match' else 'differs' end
    when r.status = 'conflict' then case when a.query_id is not null then 'match-one-route' else 'differs' end when r.status = 'review' and a.query_id is not null then 'review-match' else r.status end as verdict
  from {{query_set}} q join res r on q.query_id = r.query_id left join among a on r.query_id = a.query_id and r.submitted_in = a.thickness_in)
select query_id as row_id, cond as condition, restraint, status, case when verdict = 'differs' and sides = 4 then 'differs-4-sides' when verdict = 'differs' and unmapped then 'differs-unmapped-code' else verdict end as verdict from v
union all select o_orderkey, case o_orderkey % 6 when 1 then 'Normal Weight' when 2 then 'Cellular or Corrugated Deck Lightweight' end, case when o_orderkey % 2 = 0 then 'unrestrained' end, null, 'skipped' from {{orders}} where o_orderkey % 13 = 0"""
    .replace("where (q.product", "where q.cond is null and (q.product")
    .replace("{query_set}", "{report_query}")
)
_SQL["assign_resolved"] = f"""
with {_ROUTES}, {_LADDER}
select query_id as member_id, status, case when status = 'resolved' then any_value end as thickness_in, case when status <> 'resolved' then 'ASSUMPTION' when method = 'ul_equation' then 'CALCULATION' else 'FACT' end as kind,
  case when status <> 'resolved' then 0e0 when method = 'ul_equation' then 0.95e0 else 0.98e0 end as confidence, case when status = 'conflict' then 'conflict' when status <> 'resolved' then 'unknown' end as review
from res where query_id % 4 <> 0"""
_SQL["bid_report"] = _BID.replace("{query_set}", "{bid_query}")


def _crawl_sql(depth: int, budget: int) -> str:
    url = "concat('https://Host', {0} % 7, '.example/', case when {0} % 3 = 0 then 'docs/' else 'private/' end, case when {0} % 5 = 0 then 'open/' else '' end, {0})"
    out = f"""
with k as (select distinct p_partkey as k from {{part}}),
e as (
  select {url.format('k')} as src, {url.format('t')} as dst, place from (
    select k, k * 3 % 1009 as t, 0 as place from k union all select k, k * 5 % 1013, 1 from k union all select k, k + 1, 2 from k)),
m0 as (select distinct {url.format('k')} as url, '' as src, 0 as place from k where k % 10 = 1)"""
    past = ""
    for d in range(depth + 1):
        if d:
            seen = " union all ".join(f"select url from s{i}" for i in range(d))
            out += f""",
m{d} as (
  select dst as url, min(src) as src, arg_min(place, (src, place)) as place from e
  where src in (select url from s{d - 1} where status = 'fetched') and dst not in ({seen}) group by dst)"""
        used = " union all ".join(f"select host from s{i} where status = 'fetched'" for i in range(d)) or "select null as host where false"
        out += f""",
r{d} as (
  select *, split_part(lower(url), '/', 3) as host, substr(url, 22) as path from m{d}),
t{d} as (
  select *, case host when 'host1.example' then case when starts_with(path, '/private/open/') then '/private/open/' when starts_with(path, '/private/') then '/private/' end
      when 'host2.example' then case when starts_with(path, '/docs/') then '/docs/' else '/' end when 'host3.example' then case when starts_with(path, '/docs/1') then '/docs/1' end end as rule from r{d}),
u{d} as (
  select *, case when host >= 'host5' then 'other host' when (host, rule) in (('host1.example', '/private/'), ('host2.example', '/'), ('host3.example', '/docs/1')) then 'disallowed' end as reason from t{d}),
s{d} as (
  select url, {d} as depth, u.host, rule, coalesce(reason, case when row_number() over (partition by u.host, reason order by src, place, url) + coalesce(n, 0) <= {budget} then 'fetched' else 'over budget' end) as status
  from u{d} u left join (select host, count(*) as n from ({used}) group by host) used on used.host = u.host)"""
        past += (" union all " if d else "") + f"select * from s{d}"
    return out + "\n" + past


_SQL["crawl_order"] = _crawl_sql(2, 40)
_SQL["top_classes"] = f"""
with s as ({_scores()}),
u as (select doc_id, 'chart' as doc_class, score_chart as score from s union all select doc_id, 'drawing', score_drawing from s union all select doc_id, 'license', score_license from s union all select doc_id, 'listing', score_listing from s)
select doc_id, cast(row_number() over (partition by doc_id order by score desc, doc_class) as integer) as rank, doc_class, score from u where score > 0"""

ORACLES = {name: oracle(sql) if name != "bid_verdicts" else sql for name, sql in _SQL.items()}
