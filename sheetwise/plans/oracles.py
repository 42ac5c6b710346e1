"""DuckDB formulations of the operators' rules, independent of the Spark operators; used by the registered SQL only."""

from __future__ import annotations

import re

from sheetwise.operators.fields import PLAUSIBLE, back_fields, front_fields
from sheetwise.operators.nearest import DIGIT_RADIUS
from sheetwise.plans.fixtures import _values

L, T, R, B = '"left"', '"top"', '"right"', '"bottom"'
CX, CY = f"({L} + ({R} - {L}) / 2)", f"({T} + ({B} - {T}) / 2)"


def of(table: str, expression: str) -> str:
    """``expression`` with its quoted columns taken from ``table``."""
    return re.sub(r'"(\w+)"', rf'{table}."\1"', expression)


def measure(metric: str, a: str = "a", b: str = "b") -> str:
    both = f"greatest(0e0, least({a}.{R}, {b}.{R}) - greatest({a}.{L}, {b}.{L})) * greatest(0e0, least({a}.{B}, {b}.{B}) - greatest({a}.{T}, {b}.{T}))"
    area = lambda x: f"(({x}.{R} - {x}.{L}) * ({x}.{B} - {x}.{T}))"
    if metric == "area":
        return both
    under = f"least({area(a)}, {area(b)})" if metric == "iom" else f"({area(a)} + {area(b)} - {both})"
    return f"({both}) / nullif({under}, 0)"


def suppressed(source: str, metric: str, least: float, score: str, strict: bool = False, same_class: bool = False) -> str:
    """Rows (sheet_id, det_id, rank) that greedy suppression keeps: each sheet is walked in the order of scores."""
    near = f"{measure(metric)} {'>' if strict else '>='} {least}" + (" and a.category = b.category" if same_class else "")
    return f"""select r.sheet_id, r.det_id, r.rank from (
 with recursive ranked as materialized (select *, row_number() over (partition by sheet_id order by {score} desc, ord) as rank from {source}),
 his as materialized (select b.sheet_id, b.rank, coalesce(list(a.rank) filter (where a.rank is not null), []) as h from ranked b left join ranked a on a.sheet_id = b.sheet_id and a.rank < b.rank and {near} group by b.sheet_id, b.rank),
 walk as (select sheet_id, cast(0 as bigint) as rank, cast([] as bigint[]) as kept from (select distinct sheet_id from ranked)
  union all select w.sheet_id, h.rank, case when list_has_any(h.h, w.kept) then w.kept else list_append(w.kept, h.rank) end from walk w join his h on h.sheet_id = w.sheet_id and h.rank = w.rank + 1),
 last as (select sheet_id, max_by(kept, rank) as kept from walk group by sheet_id)
 select ranked.sheet_id, ranked.det_id, ranked.rank from ranked join last using (sheet_id) where list_contains(last.kept, ranked.rank)) r"""


def nearest(digits: str, centroids: str) -> str:
    d = f"sqrt(({CX} / 3300 - cx) * ({CX} / 3300 - cx) + ({CY} / 2550 - cy) * ({CY} / 2550 - cy))"
    return f"""select sheet_id, form, name, category, det_id from (select *, row_number() over (partition by sheet_id, form, name order by dist, det_id) as r
 from (select d.*, c.name, {d} as dist from {digits} d join {centroids} c using (form)) x where dist < {DIGIT_RADIUS!r}) y where r = 1"""


def facts(matched: str) -> str:
    """Digit-box facts."""
    digit = [f"coalesce(max(category) filter (where pos = {i}), ' ')" for i in range(3)]
    value = "concat(" + ", ".join(f"case when dot = {i} and dot > 0 then '.' else '' end, case when size > {i} then {digit[i]} else '' end" for i in range(3)) + ")"
    return f"""select sheet_id, section, key, '' as subkey, case when rule = 'any' then trim({value}) else {value} end as value
from {matched} join field_table using (form, name) group by sheet_id, section, key, rule, size, dot having rule = 'any' or count(distinct pos) = size"""


def boxes(marks: str, side: str) -> str:
    d = f"sqrt(({CX} / 3300 - cx) * ({CX} / 3300 - cx) + ({CY} / 2550 - cy) * ({CY} / 2550 - cy))"
    return f"""select sheet_id, 'checkboxes' as section, name as key, '' as subkey, max_by(category, det_id) as value from (
 select *, row_number() over (partition by sheet_id, det_id order by dist, name) as r from (select m.*, c.name, {d} as dist from {marks} m join box_centroids c using (form) where form = '{side}') x) y where r = 1 group by sheet_id, name"""


MORE: dict[str, str] = {
    "field_table": _values(front_fields() + back_fields(), "form, name, section, key, rule, pos, size, dot"),
    "plausible": _values([(k, a, b) for k, (a, b) in PLAUSIBLE.items()], "indicator, least, most"),
    "code_matched": nearest("code_digits", "code_centroids"),
    "field_matched": nearest("field_digits", "field_centroids"),
    "field_facts": facts("field_matched"),
    # Legend: groups of digits at most 20 apart, by closure
    "legend_near": f"""select a.sheet_id, a.det_id, b.det_id as other from (select *, {CX} as x, {CY} as y from legend_digits) a join (select *, {CX} as x, {CY} as y from legend_digits) b
 on a.sheet_id = b.sheet_id and a.axis = b.axis and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 20""",
    "legend_reach": "select * from legend_near union select r.sheet_id, r.det_id, l.other from legend_reach r join legend_near l on l.sheet_id = r.sheet_id and l.det_id = r.other",
    "legend_members": "select d.*, c.cluster from legend_digits d join (select sheet_id, det_id, min(other) as cluster from legend_reach group by sheet_id, det_id) c using (sheet_id, det_id)",
    "legend_raw": f"""select sheet_id, axis as unit, cluster, concat(string_agg(category, '' order by {L}, det_id), '_', axis) as label, min({L}) as env_left, min({T}) as env_top, max({R}) as env_right, max({B}) as env_bottom,
 avg({CX}) as mean_x, avg({CY}) as mean_y from legend_members group by sheet_id, axis, cluster""",
    "legend_fixed": """select * replace (case when unit = 'mins' and n > 1 then concat(cast(split_part(label, '_', 1) as int) + 60 * t, '_mins') else label end as label) from (
 select *, env_left + (env_right - env_left) / 2 as env_cx, env_top + (env_bottom - env_top) / 2 as env_cy, count(*) over (partition by sheet_id, label) as n,
 row_number() over (partition by sheet_id, label order by env_left + (env_right - env_left) / 2, cluster) - 1 as t from legend_raw) x""",
    "legend_clusters": "select *, cast(split_part(label, '_', 1) as int) as value from legend_fixed",
    "legend_places": "select sheet_id, label, max_by(unit, cluster) as unit, max_by(value, cluster) as value, max_by(mean_x, cluster) as mean_x, max_by(mean_y, cluster) as mean_y from legend_clusters group by sheet_id, label",
    "quarter_hours": """select sheet_id, concat(label, '-', nxt) as name, value as start, mean_x as lo, hi from (
 select *, lead(label) over w as nxt, lead(mean_x) over w as hi from legend_places where unit = 'mins' and value % 15 = 0 window w as (partition by sheet_id order by value, label)) x where nxt is not null""",
    "row_numbers": 'select sheet_id, det_id, category, "left", "top", "right", "bottom" from field_digits where form = \'front\' union all select sheet_id, det_id, category, "left", "top", "right", "bottom" from inhaled_digits union all select sheet_id, det_id, category, "left", "top", "right", "bottom" from indicator_digits',
    "gas_bounds": f"""select sheet_id, (coalesce(a, 0) + coalesce(b, 0)) / nullif((case when a is null then 0 else 1 end) + (case when b is null then 0 else 1 end), 0) as lo, (coalesce(c, 0) + coalesce(d, 0)) / nullif((case when c is null then 0 else 1 end) + (case when d is null then 0 else 1 end), 0) as hi from (
 select sheet_id, {', '.join(f"max({CY}) filter (where category = '{n}') as {k}" for k, n in zip('abcd', ('inhaled_volatile', 'inhaled_exhaled', 'fluid_blood_product', 'total')))} from row_landmarks group by sheet_id) x""",
    "gas_digits": f"select d.* from row_numbers d join gas_bounds b using (sheet_id) where b.lo < {CY} and {CY} < b.hi",
    "gas_facts": f"""select sheet_id, 'inhaled_volatile' as section, name as key, '' as subkey, case when length(s) = 1 then concat('0.', s) else concat(s[1], '.', s[2]) end as value from (
 select d.sheet_id, q.name, string_agg(category, '' order by {CX}, det_id) as s from gas_digits d join quarter_hours q on q.sheet_id = d.sheet_id and q.lo < {CX} and {CX} < q.hi group by d.sheet_id, q.name) x where length(s) <= 2""",
    "tagged_digits": f"""select * from (select d.*, l.category as indicator, row_number() over (partition by d.sheet_id, d.det_id order by abs({of('l', CY)} - {of('d', CY)}), {of('l', CY)}, l.category) as r
 from row_numbers d join row_landmarks l on l.sheet_id = d.sheet_id and l.category in (select indicator from plausible) and {of('l', CX)} < 1650 where {of('d', T)} > 1275 and {of('d', T)} < 2422.5) x where r = 1""",
    "indicator_facts": f"""select sheet_id, 'physiological_indicators' as section, indicator as key, name as subkey, v as value from (
 select sheet_id, indicator, name, case when indicator = 'temperature' then concat(s[1:length(s) - 1], '.', s[length(s):]) else s end as v from (
  select d.sheet_id, indicator, q.name, cast(cast(string_agg(category, '' order by {CX}, det_id) as hugeint) as varchar) as s from tagged_digits d join quarter_hours q on q.sheet_id = d.sheet_id and q.lo < {CX} and {CX} < q.hi group by d.sheet_id, indicator, q.name) x) y
 join plausible p using (indicator) where try_cast(v as double) between least and most""",
    "chart": "select sheet_id, min(env_top) filter (where unit = 'mmhg') as t, max(env_bottom) filter (where unit = 'mmhg') as b, min(env_left) filter (where unit = 'mins') as l, max(env_right) filter (where unit = 'mins') as r from legend_clusters group by sheet_id",
    "chart_symbols": f"select s.* from symbols s join chart c using (sheet_id) where s.{B} > c.t and s.{T} < c.b and s.{L} > c.l and s.{R} < c.r",
    "timed_symbols": "select * from (select s.*, c.label, row_number() over (partition by s.sheet_id, s.det_id order by abs(c.env_cx - s.kp_x), c.env_cx, c.label) as r from chart_symbols s join legend_clusters c on c.sheet_id = s.sheet_id and c.unit = 'mins') x where r = 1",
    "best_symbols": "select * exclude (r, k) from (select *, row_number() over (partition by sheet_id, label, source order by confidence desc, det_id) as k from timed_symbols) x where k = 1",
    "read_symbols": """select sheet_id, det_id, label, source, least(v1, v2) + cast(trunc(abs(case when v1 <= v2 then p1 else p2 end - kp_y) / abs(p1 - p2) * 10) as int) as reading from (
 select sheet_id, det_id, any_value(label) as label, any_value(source) as source, any_value(kp_y) as kp_y, max(value) filter (where k = 1) as v1, max(env_cy) filter (where k = 1) as p1, max(value) filter (where k = 2) as v2, max(env_cy) filter (where k = 2) as p2
 from (select s.sheet_id, s.det_id, s.label, s.source, s.kp_y, c.value, c.env_cy, row_number() over (partition by s.sheet_id, s.det_id order by abs(c.env_cy - s.kp_y), c.value) as k from best_symbols s join legend_clusters c on c.sheet_id = s.sheet_id and c.unit = 'mmhg') x
 where k <= 2 group by sheet_id, det_id) y where v2 is not null""",
    "pressure_facts": "select sheet_id, 'bp_and_hr' as section, label as key, source as subkey, concat(reading, case when source = 'heart_rate' then '_bpm' else '_mmhg' end) as value from read_symbols",
    "front_facts": "select * from field_facts where section in ('codes', 'ett_size') or (section = 'timing' and key like '%\\_%' escape '\\') union all select * from gas_facts union all select * from pressure_facts union all select * from indicator_facts union all select * from front_boxes",
    "back_facts": "select * from field_facts where not (section in ('codes', 'ett_size') or (section = 'timing' and key like '%\\_%' escape '\\')) union all select * from back_boxes",
    "front_boxes": boxes("box_marks", "front_checkboxes"),
    "back_boxes": boxes("box_marks", "back_checkboxes"),
    "tile_rows": """select sheet_id, unnest(range(cast(ceil(height / (slice_h * (1 - ov_y))) as int))) as i from sheet_images""",
    "tile_cols": """select sheet_id, unnest(range(cast(ceil(width / (slice_w * (1 - ov_x))) as int))) as i from sheet_images""",
    "steps": "select *, cast(round_even(slice_w * (1 - ov_x), 0) as int) as step_x, cast(round_even(slice_h * (1 - ov_y), 0) as int) as step_y from sheet_images",
    "tiles": """select s.sheet_id, cast(r.i as int) as tile_row, cast(c.i as int) as tile_col, cast(c.i * step_x as int) as t_left, cast(r.i * step_y as int) as t_top, cast(c.i * step_x + slice_w as int) as t_right, cast(r.i * step_y + slice_h as int) as t_bottom
 from steps s join tile_rows r using (sheet_id) join tile_cols c using (sheet_id) where (r.i = 0 or (r.i - 1) * step_y + slice_h <= height) and (c.i = 0 or (c.i - 1) * step_x + slice_w <= width)""",
}


def members(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def record(source: str) -> str:
    """One JSON text per sheet."""
    q = lambda c: f"concat('\"', {c}, '\"')"
    return f"""select sheet_id, concat('{{', string_agg(concat({q('section')}, ':', v), ',' order by section), '}}') as record from (
 select sheet_id, section, concat('{{', string_agg(concat({q('key')}, ':', v), ',' order by key), '}}') as v from (
  select sheet_id, section, key, case when max(subkey) = '' then max({q('value')}) else concat('{{', string_agg(concat({q('subkey')}, ':', {q('value')}), ',' order by subkey), '}}') end as v from {source} group by sheet_id, section, key) x group by sheet_id, section) y group by sheet_id"""
