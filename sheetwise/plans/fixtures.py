"""Tables of sheets and detections derived from the given tables, as SQL that both Spark and DuckDB run.

Each entry is a query over the given tables and other entries. All work grows with ``lineitem`` (a sheet for every 40 orders) or
``embeddings``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.operators.fields import PLAUSIBLE, back_fields, front_fields

TABLES = ("lineitem", "embeddings")


def _values(rows: list[tuple], columns: str) -> str:
    text = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"select * from (values {text}) v({columns})"


def _field_centroids() -> list[tuple]:
    out = []
    for form, fields in (("front", front_fields()), ("back", back_fields())):
        for i, f in enumerate(fields):
            out.append((form, f[1], i, 60 + 40 * (i % 4), 300 + 40 * (i // 4)))
    return out


#: Front and back corner landmarks and the rows of the front, with their centres.
CORNERS = [
    ("intraoperative", "anesthesia_start", 200, 200), ("intraoperative", "units", 3100, 210), ("intraoperative", "safety_checklist", 190, 2340), ("intraoperative", "lateral", 3110, 2350),
    ("preoperative_postoperative", "patient_profile", 210, 190), ("preoperative_postoperative", "weight", 3090, 200), ("preoperative_postoperative", "signature", 200, 2330), ("preoperative_postoperative", "disposition", 3120, 2340),
]
ROWS = [("inhaled_volatile", 120, 400), ("inhaled_exhaled", 3000, 420), ("fluid_blood_product", 120, 500), ("total", 130, 520), ("drug_name", 150, 100)]
BOXES = [("front_checkboxes", f"cb{i:02d}", i, 2500 + 60 * (i % 3), 300 + 60 * (i // 3)) for i in range(12)] + [("back_checkboxes", f"pb{i:02d}", i, 2400 + 60 * (i % 4), 400 + 60 * (i // 4)) for i in range(8)]
#: A box around a centre.
BOX = 'x - {0} as "left", y - {1} as "top", x + {0} as "right", y + {1} as "bottom"'

CTE: dict[str, str] = {
    "sheets": "select distinct cast(floor(l_orderkey / 40.0) as bigint) as sheet_id from lineitem",
    "det": '''select sheet_id, det_id, det_id as ord, category, l as "left", t as "top", l + w as "right", t + h as "bottom", l + floor(w / 2) as kp_x, t + floor(h / 2) as kp_y, confidence
from (select cast(floor(l_orderkey / 40.0) as bigint) as sheet_id, ((l_orderkey * 8 + l_linenumber) * 200000 + l_partkey) * 640000 + l_suppkey * 64 + cast(l_quantity as bigint) as det_id,
 cast((l_partkey + l_linenumber) % 10 as string) as category, cast((l_partkey * 37 + l_linenumber * 101 + l_orderkey * 7) % 3200 as double) as l,
 cast((l_suppkey * 53 + l_orderkey * 17) % 2450 as double) as t, cast(20 + l_partkey % 30 as double) as w, cast(24 + l_suppkey % 20 as double) as h,
 0.5e0 + cast(l_partkey % 256 as double) / 512e0 as confidence from lineitem) q''',
    "det_dense": '''select sheet_id, det_id, ord, category, "left" % 320 as "left", "top" % 245 as "top", "left" % 320 + ("right" - "left") as "right", "top" % 245 + ("bottom" - "top") as "bottom", confidence from det''',
    "code_centroids": '''select 'front' as form, cast(i as int) as idx, concat('code_row', lpad(cast(cast(floor(i / 3.0) as int) as string), 2, '0'), '_col', cast(i % 3 as string)) as name,
 (330e0 + 66e0 * (i % 3)) / 3300e0 as cx, (255e0 + 51e0 * floor(i / 3.0)) / 2550e0 as cy from n where i < 33''',
    "code_digits": '''select 'front' as form, sheet_id, idx as det_id, idx as ord, cast((sheet_id * 7 + idx * 3) % 10 as string) as category,
 cx * 3300 - 12 + (sheet_id + idx) % 9 - 4 as "left", cy * 2550 - 15 as "top", cx * 3300 + 12 + (sheet_id + idx) % 9 - 4 as "right", cy * 2550 + 15 as "bottom",
 0.5e0 + cast((sheet_id + idx * 5) % 64 as double) / 128e0 as confidence from sheets cross join code_centroids where (sheet_id * 31 + idx * 17) % 11 <> 0''',
    "template": f'''select side, category, {BOX.format(20, 10)} from (select side, category, cast(x as double) as x, cast(y as double) as y from ({_values(CORNERS, "side, category, x, y")}) a) b''',
    "corner_landmarks": '''select sheet_id, category, "left" + dx as "left", "top" + dy as "top", "right" + dx as "right", "bottom" + dy as "bottom", 0.75e0 as confidence
from (select s.sheet_id, t.category, t."left", t."top", t."right", t."bottom", (s.sheet_id * 13 + length(t.category) * 29) % 97 - 48 as dx, (s.sheet_id * 19 + length(t.category) * 23) % 89 - 44 as dy
 from sheets s cross join template t where t.side = 'intraoperative') q''',
    "legend_digits": '''select s.sheet_id, q.det_id, q.det_id as ord, q.category, q.x + (s.sheet_id * 7 + q.k * 3) % 3 as "left", q.y + (s.sheet_id + q.k) % 2 as "top",
 q.x + (s.sheet_id * 7 + q.k * 3) % 3 + 12 as "right", q.y + (s.sheet_id + q.k) % 2 + 16 as "bottom", q.axis
from sheets s cross join (
 select a.i * 4 + b.i as det_id, a.i as k, substring(cast((a.i * 5) % 60 as string), cast(b.i + 1 as int), 1) as category, 400e0 + 66 * a.i + 14 * b.i as x, 640e0 as y, 'mins' as axis
 from n a cross join n b where a.i < 42 and b.i < length(cast((a.i * 5) % 60 as string))
 union all
 select 1000 + a.i * 4 + b.i, a.i, substring(cast(30 + a.i * 10 as string), cast(b.i + 1 as int), 1), 300e0 + 14 * b.i, 1700e0 - 50 * a.i, 'mmhg'
 from n a cross join n b where a.i < 20 and b.i < length(cast(30 + a.i * 10 as string))) q''',
    "raw_predictions": '''select vec_id as anchor_id, cast(floor(vec_id / 50.0) as bigint) as tile_id, cast(vec_id % 50 * 8 + 40 as double) as cx, cast(vec_id % 7 * 16 + 40 as double) as cy,
 cast(20 + vec_id % 5 * 4 as double) as w, cast(20 + vec_id % 3 * 4 as double) as h, embedding as scores from embeddings''',
    # Whole sheets, in the template's frame
    "field_centroids": f"select form, name, idx, x / 3300e0 as cx, y / 2550e0 as cy from ({_values(_field_centroids(), 'form, name, idx, x, y')}) a",
    "box_centroids": f"select form, name, idx, x / 3300e0 as cx, y / 2550e0 as cy from ({_values(BOXES, 'form, name, idx, x, y')}) a",
    "sheet_centroids": "select cast(sheet_id as string) as form, name, cx, cy from sheets cross join code_centroids",
    "centroids": "select form, name, cx, cy from field_centroids union all select form, name, cx, cy from box_centroids",
    "field_digits": f'''select form, sheet_id, 10000 + idx as det_id, cast((sheet_id * 7 + idx * 3) % 10 as string) as category, {BOX.format(12, 15)}
from (select form, sheet_id, idx, cx * 3300 + (sheet_id + idx) % 9 - 4 as x, cy * 2550 as y from sheets cross join field_centroids where (sheet_id * 31 + idx * 17) % 11 <> 0) q''',
    "row_landmarks": f'''select sheet_id, 20000 + idx as det_id, category, {BOX.format(30, 8)} from (
 select sheet_id, idx, category, cast(x as double) as x, cast(y as double) + sheet_id % 3 as y from sheets cross join ({_values([(c, i, x, y) for i, (c, x, y) in enumerate(ROWS)] + [(c, 100 + i, 100, 1800 + 60 * i) for i, c in enumerate(PLAUSIBLE)], "category, idx, x, y")}) v where (sheet_id + idx) % 17 <> 0) q''',
    "inhaled_digits": f'''select sheet_id, 30000 + j * 8 + m as det_id, cast((sheet_id * 3 + j * 5 + m) % 10 as string) as category, {BOX.format(6, 10)}
from (select s.sheet_id, a.i as j, b.i as m, 460e0 + 198 * a.i + 14 * b.i as x, 465e0 as y from sheets s cross join n a cross join n b where a.i < 13 and b.i < (s.sheet_id + a.i) % 4) q''',
    "indicator_digits": f'''select sheet_id, 40000 + k * 1000 + j * 8 + m as det_id, substring(v, cast(m + 1 as int), 1) as category, {BOX.format(6, 10)}
from (select s.sheet_id, a.i as j, c.i as k, b.i as m, cast((s.sheet_id * 5 + c.i * 13 + a.i * 7) % 1000 as string) as v, 440e0 + 198 * a.i + 14 * b.i as x, 1802e0 + 60 * c.i as y
 from sheets s cross join n a cross join n b cross join n c where a.i < 13 and b.i < 3 and c.i < 8 and (s.sheet_id + c.i + a.i) % 3 = 0) q where m < length(v)''',
    "symbols": f'''select sheet_id, source, 60000 + g * 1000 + i as det_id, {BOX.format(10, 10)}, x as kp_x, y as kp_y, 0.5e0 + cast((sheet_id + i * 7 + g) % 64 as double) / 128e0 as confidence
from (select s.sheet_id, a.i, g, source, 408e0 + 66 * (a.i % 40) + (s.sheet_id + a.i) % 5 as x, 740.25e0 + (s.sheet_id * 11 + a.i * 37 + g * 211) % 970 as y
 from sheets s cross join n a cross join ({_values([("systolic", 0), ("diastolic", 1), ("heart_rate", 2)], "source, g")}) v where a.i < 60 and a.i % 3 <> 2) q''',
    "box_marks": f'''select form, sheet_id, 70000 + idx * 4 + m as det_id, case when (sheet_id + idx + m) % 3 = 0 then 'checked' else 'unchecked' end as category, {BOX.format(14, 14)}
from (select form, sheet_id, idx, i as m, cx * 3300 + 5 * i + (sheet_id + idx) % 7 - 3 as x, cy * 2550 + (sheet_id + idx) % 5 - 2 as y from sheets cross join box_centroids cross join n where i <= (sheet_id + idx) % 2 and (sheet_id * 5 + idx) % 13 <> 0) q''',
    "front_plain": '''select sheet_id, 'landmarks' as source, 90000 + length(category) as det_id, category, "left", "top", "right", "bottom", cast(null as double) as kp_x, cast(null as double) as kp_y, 0.75e0 as confidence from sheets cross join template where side = 'intraoperative'
union all select sheet_id, 'landmarks', det_id, category, "left", "top", "right", "bottom", null, null, 0.75e0 from row_landmarks
union all select sheet_id, 'landmarks', det_id, category, "left", "top", "right", "bottom", null, null, 0.75e0 from legend_digits
union all select sheet_id, 'numbers', det_id, category, "left", "top", "right", "bottom", null, null, 0.75e0 from field_digits where form = 'front'
union all select sheet_id, 'numbers', det_id, category, "left", "top", "right", "bottom", null, null, 0.75e0 from inhaled_digits
union all select sheet_id, 'numbers', det_id, category, "left", "top", "right", "bottom", null, null, 0.75e0 from indicator_digits
union all select sheet_id, 'checkboxes', det_id, category, "left", "top", "right", "bottom", null, null, 0.75e0 from box_marks where form = 'front_checkboxes'
union all select sheet_id, source, det_id, source, "left", "top", "right", "bottom", kp_x, kp_y, confidence from symbols''',
    "back_plain": '''select sheet_id, 'landmarks' as source, 90000 + length(category) as det_id, category, "left", "top", "right", "bottom", cast(null as double) as kp_x, cast(null as double) as kp_y, 0.75e0 as confidence from sheets cross join template where side = 'preoperative_postoperative'
union all select sheet_id, 'numbers', det_id, category, "left", "top", "right", "bottom", null, null, 0.75e0 from field_digits where form = 'back'
union all select sheet_id, 'checkboxes', det_id, category, "left", "top", "right", "bottom", null, null, 0.75e0 from box_marks where form = 'back_checkboxes\'''',
    # Photographed: every sheet moved
    "front_det": '''select sheet_id, source, det_id, cast(det_id as bigint) as ord, category, "left" + dx as "left", "top" + dy as "top", "right" + dx as "right", "bottom" + dy as "bottom", kp_x + dx as kp_x, kp_y + dy as kp_y, confidence
from (select *, sheet_id * 13 % 97 - 48 as dx, sheet_id * 19 % 89 - 44 as dy from front_plain) q''',
    "back_det": '''select sheet_id, source, det_id, cast(det_id as bigint) as ord, category, "left" + dx as "left", "top" + dy as "top", "right" + dx as "right", "bottom" + dy as "bottom", kp_x + dx as kp_x, kp_y + dy as kp_y, confidence
from (select *, sheet_id * 17 % 83 - 41 as dx, sheet_id * 23 % 79 - 39 as dy from back_plain) q''',
    "sheet_images": "select sheet_id, 700 + cast(sheet_id % 5 as int) * 50 as width, 600 + cast(sheet_id % 4 as int) * 40 as height, 200 + cast(sheet_id % 3 as int) * 20 as slice_w, 180 as slice_h, 0.25e0 as ov_x, 0.5e0 as ov_y from sheets",
    "small_det": '''select sheet_id, det_id, ord, category, "left" % 640 as "left", "top" % 560 as "top", "left" % 640 + ("right" - "left") as "right", "top" % 560 + ("bottom" - "top") as "bottom", "left" % 640 + 5 as kp_x, "top" % 560 + 5 as kp_y, confidence from det''',
    "classes": _values([(i, str(i)) for i in range(10)], "class_id, category"),
    "vector_classes": _values([(i, f"class{i}") for i in range(64)], "class_id, category"),
}


def closure(text: str, more: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """Entries that ``text`` names, directly or through others, in an order in which each comes after what it needs."""
    every = CTE | (more or {}) | {"n": ""}
    out: dict[str, str] = {}

    def visit(part: str, above: frozenset[str]) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", part)):
            if name in every and name not in out and name not in above:
                visit(every[name], above | {name})
                out[name] = every[name]

    visit(text, frozenset())
    return list(out.items())


def _with(text: str, numbers: str, more: dict[str, str] | None = None, change: Callable[[str, str], str] = lambda k, v: v) -> str:
    ctes = [(k, numbers if k == "n" else change(k, v)) for k, v in closure(text, more)]
    return ("with recursive " if more else "with ") + ",\n".join(f"{k} as ({v})" for k, v in ctes) + f"\n{text}" if ctes else text


def duckdb_sql(text: str, more: dict[str, str] | None = None) -> str:
    """``text`` with the entries it needs, for DuckDB."""
    return _with(text, "select range as i from range(256)", more)


#: Tables of a few rows that an entry crosses with all sheets, by their names there.
FEW = {
    "code_digits": "code_centroids", "corner_landmarks": "t", "legend_digits": "q", "sheet_centroids": "code_centroids", "field_digits": "field_centroids", "row_landmarks": "v", "inhaled_digits": "a, b",
    "indicator_digits": "a, b, c", "symbols": "a, v", "box_marks": "box_centroids, n", "front_plain": "template", "back_plain": "template",
}


def _for_spark(name: str, text: str) -> str:
    """An entry's ``text`` over the dealt sheets; the few rows are sent to the sheets' tasks, where Spark would send all sheets to the tasks of a range of numbers (three of which have rows)."""
    if name == "sheets":
        return "select sheet_id from {sheets}"
    if name not in FEW:
        return text
    at = text.rindex("select ", 0, text.index("from sheets")) + len("select ")
    return f"{text[:at]}/*+ BROADCAST({FEW[name]}) */ {text[at:]}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An entry as a DataFrame. Sheets are dealt to as many partitions as a shuffle has: few bytes, but all rows of an entry come from them; by a hash, as Spark would merge partitions by the number itself."""
    sql = _with(f"select * from {name}", "select id as i from range(256)", change=_for_spark).replace('"', "`")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\bfrom {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", sql)
    if "{sheets}" in sql:
        lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        used["sheets"] = spark.sql(CTE["sheets"].replace("from lineitem", "from {lineitem}"), lineitem=lineitem).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("sheet_id"))
    return spark.sql(sql, **used) if used else spark.sql(sql)
