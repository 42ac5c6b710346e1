"""Registered queries over tables that derive from the given ones, and DuckDB SQL with the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetwise.functions import geometry as G
from sheetwise.operators import assemble, boxes, decode, fields, legend, nearest, registration, suppression, tiling
from sheetwise.plans import oracles as O
from sheetwise.plans.fixtures import duckdb_sql, load
from sheetwise.plans.oracles import CX, CY, B, L, R, T
from sheetwise.runtime import cut, forget, shared_dir
from sheetwise.schema import BOX, COCO, LABEL_STUDIO
from sheetwise.sources import files, formats, quarantine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "interpret_front"
WIDTH, HEIGHT = 3300.0, 2550.0
EDGES = f"{L}, {T}, {R}, {B}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = duckdb_sql(sql, O.MORE)
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


# Geometry --------------------------------------------------------------------------------------------------------------------

@query(f"select sheet_id, det_id, {CX} as cx, {CY} as cy, ({R} - {L}) * ({B} - {T}) as area from det")
def center_and_area(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "det").select("sheet_id", "det_id", G.center_x().alias("cx"), G.center_y().alias("cy"), G.area().alias("area"))


def _warped(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of which some have equal or swapped sides."""
    return load(spark, d, "det").withColumn("right", F.col("right") - F.col("det_id") % 3 * (F.col("right") - F.col("left"))).withColumn("kp_x", F.col("kp_x") + F.col("det_id") % 4 * 10)


WARPED = f'(select sheet_id, det_id, category, {L}, {T}, {R} - det_id % 3 * ({R} - {L}) as {R}, {B}, kp_x + det_id % 4 * 10 as kp_x, kp_y from det) q'


@query(f"select sheet_id, det_id, case when {L} < {R} and {T} < {B} then 'ok' when {L} <= {R} and {T} <= {B} then 'degenerate' else 'invalid' end as status from {WARPED}")
def validate_boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxes.validate_boxes(_warped(spark, d)).select("sheet_id", "det_id", "status")


@query(f"select sheet_id, det_id, kp_x between {L} and {R} and kp_y between {T} and {B} as keypoint_ok from {WARPED}")
def validate_keypoints(spark: SparkSession, d: str) -> DataFrame:
    return boxes.validate_keypoints(_warped(spark, d)).select("sheet_id", "det_id", "keypoint_ok")


@query(f"select sheet_id, det_id from {WARPED} where {L} < kp_x and kp_x < {R} and {T} < kp_y and kp_y < {B}")
def keypoint_inside(spark: SparkSession, d: str) -> DataFrame:
    return _warped(spark, d).where(G.keypoint_inside()).select("sheet_id", "det_id")


@query(f"select sheet_id, det_id, category, {L} - 2 as {L}, {T} - 1 as {T}, {R} + 2 as {R}, {B} + 1 as {B}, kp_x + 1 as kp_x, kp_y - 1 as kp_y from det")
def replace_geometry(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    out = boxes.with_box(load(spark, d, "det"), c("left") - 2, c("top") - 1, c("right") + 2, c("bottom") + 1)
    return boxes.with_keypoint(out, c("kp_x") + 1, c("kp_y") - 1).select("sheet_id", "det_id", "category", *BOX, "kp_x", "kp_y")


@query(f"select sheet_id, det_id, category, {L} - 3 as {L}, {T} as {T}, {R} as {R}, {B} + 3 as {B}, kp_x - 1 as kp_x, kp_y + 2 as kp_y from det")
def replace_both(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return boxes.with_box_and_keypoint(load(spark, d, "det"), (c("left") - 3, c("top"), c("right"), c("bottom") + 3), (c("kp_x") - 1, c("kp_y") + 2)).select("sheet_id", "det_id", "category", *BOX, "kp_x", "kp_y")


_NEXT = f"(select *, lead({L}) over w as l2, lead({T}) over w as t2, lead({R}) over w as r2, lead({B}) over w as b2 from det_dense window w as (partition by sheet_id order by ord))"


@query(f"""select a.sheet_id, a.det_id, {O.measure('area')} as inter, round({O.measure('iom')}, 6) as iom, round({O.measure('iou')}, 6) as iou
from {_NEXT} a join (select sheet_id, det_id, l2 as {L}, t2 as {T}, r2 as {R}, b2 as {B} from {_NEXT} x) b using (sheet_id, det_id) where a.l2 is not null""")
def overlap_measures(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("sheet_id").orderBy("ord")
    rows = load(spark, d, "det_dense").select("sheet_id", "det_id", *[F.col(c).alias("a_" + c) for c in BOX], *[F.lead(c).over(w).alias("b_" + c) for c in BOX]).where("b_left is not null")
    return rows.select("sheet_id", "det_id", G.intersection_area("a_", "b_").alias("inter"), r6(G.iom("a_", "b_")).alias("iom"), r6(G.iou("a_", "b_")).alias("iou"))


@query(f"select sheet_id, det_id, round({CX} / 3300, 6) as nx, round({CY} / 2550, 6) as ny from det")
def normalize_center(spark: SparkSession, d: str) -> DataFrame:
    return rounded(boxes.normalize_center(load(spark, d, "det"), F.lit(WIDTH), F.lit(HEIGHT)), "nx", "ny").select("sheet_id", "det_id", "nx", "ny")


@query("select sheet_id, cast(trunc(least(width * 0.3e0, height * 0.3e0)) as int) as side from sheet_images")
def tile_size(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "sheet_images").select("sheet_id", G.tile_size(F.col("width"), F.col("height"), F.lit(0.3)).alias("side"))


@query(f"select sheet_id, det_id, {L} * 0.5 as {L}, {T} * 0.25 as {T}, {R} * 0.5 as {R}, {B} * 0.25 as {B}, kp_x * 0.5 as kp_x, kp_y * 0.25 as kp_y from det")
def scale_to_image(spark: SparkSession, d: str) -> DataFrame:
    return boxes.scale_to_image(load(spark, d, "det"), F.lit(512.0), F.lit(256.0), F.lit(1024.0), F.lit(1024.0)).select("sheet_id", "det_id", *BOX, "kp_x", "kp_y")


@query("select sheet_id, det_id, confidence from det where confidence >= 0.75")
def filter_confidence(spark: SparkSession, d: str) -> DataFrame:
    return boxes.filter_confidence(load(spark, d, "det"), 0.75).select("sheet_id", "det_id", "confidence")


@query("select sheet_id, category, det_id, confidence from (select *, row_number() over (partition by sheet_id, category order by ord) as r from det where category in ('3', '7')) q where r = 1")
def landmark_by_name(spark: SparkSession, d: str) -> DataFrame:
    return boxes.landmark_by_name(load(spark, d, "det"), ["3", "7"]).select("sheet_id", "category", "det_id", "confidence")


@query("select sheet_id, det_id, case when det_id % 2 = 0 and det_id % 3 = 0 then null when det_id % 2 = 0 then kp_y when det_id % 3 = 0 then kp_x else (kp_x + kp_y) / 2 end as m from det")
def mean_ignoring_nulls(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.when(F.col("det_id") % 2 != 0, F.col("kp_x")), F.when(F.col("det_id") % 3 != 0, F.col("kp_y"))
    return load(spark, d, "det").select("sheet_id", "det_id", G.mean_ignoring_nulls(x, y).alias("m"))


# Tiles -----------------------------------------------------------------------------------------------------------------------

@query("select * from tiles")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return tiling.tile_grid(load(spark, d, "sheet_images")).select("sheet_id", "tile_row", "tile_col", "t_left", "t_top", "t_right", "t_bottom")


@query("select sheet_id, slice_w * (sheet_id % 7) > 0 and slice_w * (sheet_id % 7) <= width and slice_h <= height as tile_ok from sheet_images")
def validate_tile_params(spark: SparkSession, d: str) -> DataFrame:
    images = load(spark, d, "sheet_images").withColumn("slice_w", F.col("slice_w") * (F.col("sheet_id") % 7))
    return tiling.validate_tile_params(images).select("sheet_id", "tile_ok")


@query(f"select a.sheet_id, det_id, tile_row, tile_col from small_det a join tiles t on a.sheet_id = t.sheet_id and {L} <= t_right and {R} >= t_left and {T} <= t_bottom and {B} >= t_top")
def annotations_in_tile(spark: SparkSession, d: str) -> DataFrame:
    return tiling.annotations_in_tile(load(spark, d, "small_det"), load(spark, d, "sheet_images")).select("sheet_id", "det_id", "tile_row", "tile_col")


@query(f"""select a.sheet_id, det_id, tile_row, tile_col, greatest({L}, t_left) - t_left as {L}, greatest({T}, t_top) - t_top as {T}, least({R}, t_right) - t_left as {R}, least({B}, t_bottom) - t_top as {B}, kp_x - t_left as kp_x, kp_y - t_top as kp_y
from small_det a join tiles t on a.sheet_id = t.sheet_id and {L} < t_right and {R} > t_left and {T} < t_bottom and {B} > t_top""")
def tile_annotations(spark: SparkSession, d: str) -> DataFrame:
    return tiling.tile_annotations(load(spark, d, "small_det"), load(spark, d, "sheet_images"), touching=False).select("sheet_id", "det_id", "tile_row", "tile_col", *BOX, "kp_x", "kp_y")


@query(f"""select sheet_id, det_id, tile_row, tile_col, {L} + dx as {L}, {T} + dy as {T}, {R} + dx as {R}, {B} + dy as {B}, row_number() over (partition by sheet_id order by tile_row, tile_col, det_id) as ord from (
 select a.*, cast(det_id % 4 as int) as tile_row, cast(det_id % 5 as int) as tile_col, cast(trunc((det_id % 5) * 205 * 0.75) as int) as dx, cast(trunc((det_id % 4) * 181 * 0.5) as int) as dy from small_det a) q""")
def untile(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "small_det").drop("ord").withColumns({
        "tile_row": (F.col("det_id") % 4).cast("int"), "tile_col": (F.col("det_id") % 5).cast("int"), "pos": F.col("det_id"), "slice_w": F.lit(205), "slice_h": F.lit(181), "ov_x": F.lit(0.25), "ov_y": F.lit(0.5)
    })
    return tiling.untile(rows).select("sheet_id", "det_id", "tile_row", "tile_col", *BOX, "ord")


@query(f"""select sheet_id, det_id, {L} + dx as {L}, {T} + dy as {T}, {R} + dx as {R}, {B} + dy as {B} from (
 select a.*, cast((det_id % 5) * round_even(205 * 0.75, 0) as int) as dx, cast((det_id % 4) * round_even(181 * 0.5, 0) as int) as dy from small_det a) q""")
def untile_rounded(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "small_det").drop("ord").withColumns({
        "tile_row": (F.col("det_id") % 4).cast("int"), "tile_col": (F.col("det_id") % 5).cast("int"), "pos": F.col("det_id"), "slice_w": F.lit(205), "slice_h": F.lit(181), "ov_x": F.lit(0.25), "ov_y": F.lit(0.5)
    })
    return tiling.untile(rows, origin="round").select("sheet_id", "det_id", *BOX)


def _painted(spark: SparkSession, d: str) -> DataFrame:
    """Small one-channel images whose pixels follow from the sheet's number."""
    images = load(spark, d, "sheets").withColumns({"width": F.lit(12), "height": F.lit(9), "slice_w": F.lit(5), "slice_h": F.lit(4), "ov_x": F.lit(0.4), "ov_y": F.lit(0.25), "nChannels": F.lit(1)})
    return images.withColumn("data", F.expr("unhex(repeat(concat('0A', lpad(hex(sheet_id % 256), 2, '0'), 'FF'), 36))"))


@query("""select sheet_id, r as tile_row, c as tile_col, string_agg(case when 3 * r + y < 9 and 3 * c + x < 12 then ['0A', printf('%02X', sheet_id % 256), 'FF'][(3 * c + x) % 3 + 1] else '00' end, '' order by y, x) as pixels
from (select sheet_id, cast(a.i as int) as r, cast(b.i as int) as c, cast(e.i as int) as y, cast(f.i as int) as x from sheets cross join n a cross join n b cross join n e cross join n f where a.i < 3 and b.i < 4 and e.i < 4 and f.i < 5) q group by sheet_id, r, c""")
def tile_images(spark: SparkSession, d: str) -> DataFrame:
    return tiling.tile_images(_painted(spark, d)).select("sheet_id", "tile_row", "tile_col", F.hex("data").alias("pixels"))


# Pairs and suppression -------------------------------------------------------------------------------------------------------

@query(f"select a.sheet_id, a.ord as hi, b.ord as lo, round({O.measure('iou')}, 6) as overlap from det_dense a join det_dense b on a.sheet_id = b.sheet_id and a.ord < b.ord and {O.measure('iou')} >= 0.3")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(suppression.overlap_pairs(load(spark, d, "det_dense"), "iou", 0.3), "overlap")


@query(O.suppressed("det_dense", "iou", 0.1, "confidence", True, True).replace("r.sheet_id, r.det_id, r.rank", "r.sheet_id, r.det_id"))
def suppress_by_class(spark: SparkSession, d: str) -> DataFrame:
    return suppression.suppress_by_class(load(spark, d, "det_dense")).select("sheet_id", "det_id")


def _placed(kept: str) -> str:
    return f"select sheet_id, det_id, row_number() over (partition by sheet_id order by rank) - 1 as ord from ({kept}) k"


@query(_placed(O.suppressed("det_dense", "iou", 0.5, "confidence")))
def suppress(spark: SparkSession, d: str) -> DataFrame:
    return suppression.suppress(load(spark, d, "det_dense")).select("sheet_id", "det_id", "ord")


@query(_placed(O.suppressed("det_dense", "iom", 0.5, f"({R} - {L}) * ({B} - {T}) * confidence")))
def suppress_reassembled(spark: SparkSession, d: str) -> DataFrame:
    return suppression.suppress(load(spark, d, "det_dense"), 0.5, "iom", suppression.area_times_confidence()).select("sheet_id", "det_id", "ord")


# Nearest neighbours and intervals --------------------------------------------------------------------------------------------

@query("select sheet_id, name, category, det_id from code_matched")
def nearest_per_target(spark: SparkSession, d: str) -> DataFrame:
    return nearest.nearest_per_target(load(spark, d, "code_digits"), load(spark, d, "code_centroids"), F.lit(WIDTH), F.lit(HEIGHT)).select("sheet_id", "name", "category", "det_id")


@query("select sheet_id, name, category, det_id from code_matched where contains(name, 'row03')")
def relevant_boxes(spark: SparkSession, d: str) -> DataFrame:
    return nearest.relevant_boxes(load(spark, d, "code_digits"), load(spark, d, "code_centroids"), "row03", F.lit(WIDTH), F.lit(HEIGHT)).select("sheet_id", "name", "category", "det_id")


_DIST = f"sqrt(({CX} / 3300 - cx) * ({CX} / 3300 - cx) + ({CY} / 2550 - cy) * ({CY} / 2550 - cy))"


@query(f"select sheet_id, det_id, name from (select m.*, c.name, row_number() over (partition by sheet_id, form, det_id order by {_DIST}, c.name) as r from box_marks m join box_centroids c using (form)) q where r = 1")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    marks = load(spark, d, "box_marks").withColumn("ord", F.col("det_id"))
    return nearest.nearest_centroid(marks, load(spark, d, "box_centroids"), F.lit(WIDTH), F.lit(HEIGHT)).select("sheet_id", "det_id", "name")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    """Labelled clusters of the derived legends; axes come from the digits themselves."""
    found = cut(spark, legend.cluster_dbscan(load(spark, d, "legend_digits"), 20.0, keys=("sheet_id", "axis")))
    parts = [legend.cluster_boxes(found.where(F.col("axis") == u), u) for u in legend.UNITS]
    return cut(spark, parts[0].unionByName(parts[1]))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "symbols").withColumns({"category": F.col("source"), "ord": F.col("det_id")})


@query("select sheet_id, det_id, label from timed_symbols")
def find_timestamp(spark: SparkSession, d: str) -> DataFrame:
    clusters = _clusters(spark, d)
    return fields.find_timestamp(fields.bp_hr_area_filter(_symbols(spark, d), clusters), clusters).select("sheet_id", "det_id", "label")


@query("select sheet_id, det_id, reading from read_symbols")
def find_value(spark: SparkSession, d: str) -> DataFrame:
    clusters = _clusters(spark, d)
    best = fields.best_per_group(fields.find_timestamp(fields.bp_hr_area_filter(_symbols(spark, d), clusters), clusters), ("sheet_id", "label", "category"))
    return fields.find_value(best, clusters).select("sheet_id", "det_id", "reading")


@query("select sheet_id, label, source as category, det_id from best_symbols")
def best_per_group(spark: SparkSession, d: str) -> DataFrame:
    clusters = _clusters(spark, d)
    timed = fields.find_timestamp(fields.bp_hr_area_filter(_symbols(spark, d), clusters), clusters)
    return fields.best_per_group(timed, ("sheet_id", "label", "category")).select("sheet_id", "label", "category", "det_id")


@query("select sheet_id, det_id from chart_symbols")
def bp_hr_area_filter(spark: SparkSession, d: str) -> DataFrame:
    return fields.bp_hr_area_filter(_symbols(spark, d), _clusters(spark, d)).select("sheet_id", "det_id")


@query("select * from pressure_facts")
def heart_rate_and_blood_pressure(spark: SparkSession, d: str) -> DataFrame:
    return fields.heart_rate_and_blood_pressure(_symbols(spark, d), _clusters(spark, d))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    cols = ["sheet_id", "det_id", "category", *BOX]
    parts = [load(spark, d, "field_digits").where("form = 'front'"), load(spark, d, "inhaled_digits"), load(spark, d, "indicator_digits")]
    return parts[0].select(*cols).unionByName(parts[1].select(*cols)).unionByName(parts[2].select(*cols)).withColumn("ord", F.col("det_id").cast("long"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "row_landmarks").withColumn("ord", F.col("det_id"))


@query("select sheet_id, det_id from gas_digits")
def inhaled_volatile_region(spark: SparkSession, d: str) -> DataFrame:
    return fields.inhaled_volatile_region(_numbers(spark, d), _rows(spark, d)).select("sheet_id", "det_id")


@query("select sheet_id, name, start, round(lo, 6) as lo, round(hi, 6) as hi from quarter_hours")
def fifteen_minute_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(legend.fifteen_minute_intervals(legend.legend_locations(_clusters(spark, d))), "lo", "hi")


@query(f"select d.sheet_id, det_id, name from inhaled_digits d join quarter_hours q on q.sheet_id = d.sheet_id and q.lo < {CX} and {CX} < q.hi")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    intervals = legend.fifteen_minute_intervals(legend.legend_locations(_clusters(spark, d)))
    return nearest.in_intervals(load(spark, d, "inhaled_digits"), intervals, G.center_x()).select("sheet_id", "det_id", "name")


@query("select * from gas_facts")
def inhaled_volatile(spark: SparkSession, d: str) -> DataFrame:
    return fields.inhaled_volatile(_numbers(spark, d), legend.legend_locations(_clusters(spark, d)), _rows(spark, d))


@query("select sheet_id, det_id, indicator from tagged_digits")
def indicator_for_box(spark: SparkSession, d: str) -> DataFrame:
    lower = _numbers(spark, d).where((F.col("top") > 1275) & (F.col("top") < 2422.5))
    return fields.indicator_for_box(lower, _rows(spark, d), 3300.0).select("sheet_id", "det_id", "indicator")


@query("select * from indicator_facts")
def physiological_indicators(spark: SparkSession, d: str) -> DataFrame:
    return fields.physiological_indicators(_numbers(spark, d), legend.legend_locations(_clusters(spark, d)), _rows(spark, d), 3300.0, 2550.0)


@query(f"""select d.sheet_id, d.det_id from row_numbers d join (select sheet_id, (dx + vx) / 2 as l, (dy + uy) / 2 as t, (ux + ex) / 2 as r, (vy + ey) / 2 as b from (select sheet_id,
 {', '.join(f"max({e}) filter (where category = '{n}') as {k}{c}" for k, n in zip('duve', ('drug_name', 'units', 'inhaled_volatile', 'inhaled_exhaled')) for c, e in (('x', CX), ('y', CY)))}
 from (select sheet_id, category, {EDGES} from row_landmarks union all select sheet_id, category, {EDGES} from sheets cross join template where category = 'units') a group by sheet_id) b) e using (sheet_id)
where e.l < {CX} and {CX} < e.r and e.t < {CY} and {CY} < e.b""")
def drug_dosage_region(spark: SparkSession, d: str) -> DataFrame:
    units = load(spark, d, "front_plain").where("category = 'units'").withColumn("ord", F.col("det_id").cast("long"))
    marks = _rows(spark, d).select("sheet_id", "ord", "category", *BOX).unionByName(units.select("sheet_id", "ord", "category", *BOX))
    return fields.drug_dosage_region(_numbers(spark, d), marks).select("sheet_id", "det_id")


# Boxed digits ----------------------------------------------------------------------------------------------------------------

def _facts(spark: SparkSession, d: str, form: str) -> DataFrame:
    """All facts of a form's digit boxes, from one nearest-neighbour join."""
    digits = load(spark, d, "field_digits").where(F.col("form") == form).withColumn("ord", F.col("det_id"))
    return fields.digit_facts(nearest.nearest_per_target(digits, load(spark, d, "field_centroids"), F.lit(WIDTH), F.lit(HEIGHT)), fields.field_table(spark))


@query(O.facts("code_matched"))
def digit_codes(spark: SparkSession, d: str) -> DataFrame:
    matched = nearest.nearest_per_target(load(spark, d, "code_digits"), load(spark, d, "code_centroids"), F.lit(WIDTH), F.lit(HEIGHT))
    return fields.digit_facts(matched, fields.field_table(spark))


def _section_query(name: str, form: str, where: str, *names: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return fields.section(_facts(spark, d, form), *names)

    f.__name__ = name
    query(f"select * from field_facts where {where} and section in ({O.members(list(names))})")(f)


_front, _back = "contains(key, '_')", "not contains(key, '_')"
_section_query("drug_codes", "front", "true", "codes")
_section_query("ett_size", "front", "true", "ett_size")
_section_query("surgical_timing", "front", _front, "timing")
_section_query("time_of_assessment", "back", _back, "timing")
_section_query("age", "back", "true", "age")
_section_query("height", "back", "true", "height")
_section_query("weight", "back", "true", "weight")
_section_query("vitals", "back", "true", "preop_vitals", "pacu_vitals")
_section_query("lab_results", "back", "true", "lab_values")
_section_query("aldrete_score", "back", "true", "aldrete_score")


@query("select * from field_facts where not (section in ('codes', 'ett_size') or (section = 'timing' and contains(key, '_')))")
def preop_digit_bundle(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "back")


@query("select * from front_boxes")
def checkboxes_front(spark: SparkSession, d: str) -> DataFrame:
    marks = load(spark, d, "box_marks").where("form = 'front_checkboxes'").withColumn("ord", F.col("det_id"))
    return fields.checkboxes(marks, load(spark, d, "box_centroids"), F.lit(WIDTH), F.lit(HEIGHT), "intraoperative")


@query("select * from back_boxes")
def checkboxes_back(spark: SparkSession, d: str) -> DataFrame:
    marks = load(spark, d, "box_marks").where("form = 'back_checkboxes'").withColumn("ord", F.col("det_id"))
    return fields.checkboxes(marks, load(spark, d, "box_centroids"), F.lit(WIDTH), F.lit(HEIGHT), "preoperative")


@query(O.boxes("box_marks", "front_checkboxes").replace("r = 1 group by", "r = 1 and dist < 0.0018 group by").replace("max_by(category, det_id)", "min_by(category, det_id)"))
def checkboxes_first_near(spark: SparkSession, d: str) -> DataFrame:
    """Of the marks within a distance of a box, the first."""
    marks = load(spark, d, "box_marks").where("form = 'front_checkboxes'").withColumn("ord", F.col("det_id"))
    return fields.checkboxes(marks, load(spark, d, "box_centroids"), F.lit(WIDTH), F.lit(HEIGHT), "intraoperative", 0.0018, "best")


@query("select sheet_id, section, key, '' as subkey, case when n % 2 = 0 then 'second' else 'first' end as value from (select sheet_id, section, key, length(key) as n from field_facts where section = 'codes' or (section = 'timing' and contains(key, '_'))) q")
def merge_records(spark: SparkSession, d: str) -> DataFrame:
    rows = fields.section(_facts(spark, d, "front"), "codes", "timing")
    later = rows.where(F.length("key") % 2 == 0)
    return assemble.merge_records(rows.withColumn("value", F.lit("first")), later.withColumn("value", F.lit("second")))


# Legends ---------------------------------------------------------------------------------------------------------------------

@query("select sheet_id, det_id, cluster from legend_members")
def cluster_dbscan(spark: SparkSession, d: str) -> DataFrame:
    digits = load(spark, d, "legend_digits")
    return legend.cluster_dbscan(digits, 20.0).select("sheet_id", "det_id", F.col("cluster").cast("long"))


@query("select sheet_id, unit, cluster, label, value, env_left, env_top, env_right, env_bottom, env_cx, env_cy, round(mean_x, 6) as mean_x, round(mean_y, 6) as mean_y from legend_clusters")
def cluster_boxes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_clusters(spark, d), "mean_x", "mean_y").withColumn("cluster", F.col("cluster").cast("long"))


@query("select sheet_id, label, unit, value, round(mean_x, 6) as mean_x, round(mean_y, 6) as mean_y from legend_places")
def legend_locations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(legend.legend_locations(_clusters(spark, d)), "mean_x", "mean_y")


@query("select sheet_id, det_id, axis from legend_digits")
def isolate_legend(spark: SparkSession, d: str) -> DataFrame:
    return legend.isolate_legend(load(spark, d, "legend_digits").drop("axis"), 3300.0, 2550.0).select("sheet_id", "det_id", "axis")


@query(f"""select sheet_id, axis, round(max_by(g, s), 3) as peak from (select sheet_id, axis, i, i * 2550e0 / 9999 as g, round(sum(exp(-0.5 * ((i * 2550e0 / 9999 - v) / w) * ((i * 2550e0 / 9999 - v) / w))), 9) - i * 1e-12 as s from (
 select sheet_id, axis, {T} as v, 0.2 * stddev_samp({T}) over (partition by sheet_id, axis) as w from legend_digits) a cross join (select range as i from range(10000)) b group by sheet_id, axis, i) c group by sheet_id, axis""")
def density_peak(spark: SparkSession, d: str) -> DataFrame:
    tops = load(spark, d, "legend_digits").select("sheet_id", "axis", F.col("top").alias("v"))
    return legend.density_peak(tops, 2550.0, ("sheet_id", "axis")).select("sheet_id", "axis", F.round("peak", 3).alias("peak"))


@query(f"select sheet_id, det_id from (select *, quantile_cont({L}, 0.25) over (partition by sheet_id) as q1, quantile_cont({L}, 0.75) over (partition by sheet_id) as q3 from legend_digits) q where {L} between q1 - 0.5 * (q3 - q1) and q3 + 0.5 * (q3 - q1)")
def iqr_filter(spark: SparkSession, d: str) -> DataFrame:
    return legend.iqr_filter(load(spark, d, "legend_digits"), "left", 0.5).select("sheet_id", "det_id")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "legend_digits")
    return rows.select("sheet_id", "axis", "det_id", G.center_x().alias("x"), G.center_y().alias("y"), F.explode(F.array(*[F.lit(k) for k in (2, 3, 5)])).alias("k")).withColumn("label", (F.col("det_id") % F.col("k")).cast("int"))


_SIL = f"""(with p as (select sheet_id, axis, det_id, {CX} as x, {CY} as y, k, det_id % k as label from legend_digits cross join (values (2), (3), (5)) ks(k)),
 m as (select a.sheet_id, a.axis, a.k, a.det_id, a.label, b.label as other, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) as t, count(*) as n from p a join p b using (sheet_id, axis, k) group by all),
 e as (select sheet_id, axis, k, det_id, max(t / nullif(n - 1, 0)) filter (where label = other) as a, min(t / n) filter (where label <> other) as b, max(n) filter (where label = other) as own from m group by all)
 select sheet_id, axis, k, avg(case when own = 1 then 0 else (b - a) / greatest(a, b) end) as s from e group by all)"""


@query(f"select sheet_id, axis, k, round(s, 6) as silhouette from {_SIL} q")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return rounded(legend.silhouette(_labelled(spark, d), ("sheet_id", "axis", "k")), "silhouette")


@query(f"select sheet_id, axis, case when max(s) - max_by(s, k) >= 0.005 then min(k) filter (where s = best) else max(k) end as k from (select *, max(s) over (partition by sheet_id, axis) as best from {_SIL} q) r group by sheet_id, axis")
def select_k(spark: SparkSession, d: str) -> DataFrame:
    return legend.select_k(legend.silhouette(_labelled(spark, d), ("sheet_id", "axis", "k")), legend.BETTER["kmeans"], ("sheet_id", "axis"))


def _by_axis(spark: SparkSession, d: str, cluster: Callable[[DataFrame, list[int]], DataFrame]) -> DataFrame:
    """Each box of both axes with its cluster, named after the cluster's smallest box."""
    digits, name = load(spark, d, "legend_digits"), F.min("det_id").over(Window.partitionBy("sheet_id", "cluster")).cast("long")
    parts = [cluster(digits.where(F.col("axis") == axis), ks).select("sheet_id", "det_id", name.alias("cluster")) for axis, ks in (("mins", assemble.TIME_KS), ("mmhg", assemble.VALUE_KS))]
    return parts[0].unionByName(parts[1])


@query("select sheet_id, det_id, cast(cluster as bigint) as cluster from legend_members")
def cluster_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return _by_axis(spark, d, legend.cluster_kmeans)


@query("select sheet_id, det_id, cast(cluster as bigint) as cluster from legend_members")
def cluster_agglomerative(spark: SparkSession, d: str) -> DataFrame:
    return _by_axis(spark, d, legend.cluster_agglomerative)


# Registration ----------------------------------------------------------------------------------------------------------------

@query(f"select sheet_id, category, (select {CX} from template t where t.category = c.category) as u, (select {CY} from template t where t.category = c.category) as v from corner_landmarks c")
def register_corners(spark: SparkSession, d: str) -> DataFrame:
    marks = load(spark, d, "corner_landmarks")
    out = registration.register(marks, marks, load(spark, d, "template"), registration.CORNERS["intraoperative"])
    # Corners map onto the template's; their boxes are distorted about those centres, so the centre itself is mapped here.
    fitted = registration.fit_homography(registration.corner_pairs(marks, load(spark, d, "template"), registration.CORNERS["intraoperative"]))
    points = marks.select("sheet_id", "category", G.center_x().alias("u"), G.center_y().alias("v")).join(fitted, "sheet_id")
    mapped = registration.transform_points(points, "u", "v").select("sheet_id", "category", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))
    return mapped.join(out.select("sheet_id", "category"), ["sheet_id", "category"], "left_semi")


@query(f"select sheet_id, source, det_id, {EDGES}, kp_x, kp_y from front_plain")
def register_side(spark: SparkSession, d: str) -> DataFrame:
    out = registration.register_side(load(spark, d, "front_det"), load(spark, d, "template"), "intraoperative")
    return out.select("sheet_id", "source", F.col("det_id").cast("long"), *[F.round(c, 4).alias(c) for c in (*BOX, "kp_x", "kp_y")])


#: How strongly a sheet is tilted: a point (X, Y) of the template is photographed at (X, Y) / (1 + g X).
_TILT = "(1 + sheet_id % 7) * 1e-5"


def _back(edge: str, by: str = L) -> str:
    # To thousandths, from a place that no coordinate of the operator's precision lies on.
    return f"floor(round({edge} / (1 - {_TILT} * {by}), 6) * 1000 + 0.50025e0) / 1000"


@query(f"select sheet_id, det_id, {_back(L)} as {L}, {_back(T)} as {T}, {_back(R, R)} as {R}, {_back(B, R)} as {B}, {_back('kp_x', 'kp_x')} as kp_x, {_back('kp_y', 'kp_x')} as kp_y from det")
def register_perspective(spark: SparkSession, d: str) -> DataFrame:
    """Boxes and keypoints under a true perspective; an edge is mapped at its own two corners."""
    template = load(spark, d, "template").where("side = 'intraoperative'")
    w = 1 + F.expr(_TILT) * G.center_x()
    x, y = G.center_x() / w, G.center_y() / w
    marks = load(spark, d, "sheets").join(F.broadcast(template)).select("sheet_id", "category", (x - 20).alias("left"), (y - 10).alias("top"), (x + 20).alias("right"), (y + 10).alias("bottom"))
    out = registration.register(load(spark, d, "det"), marks, template, registration.CORNERS["intraoperative"])
    return out.select("sheet_id", "det_id", *[(F.floor(F.col(c) * 1000 + 0.50025) / 1000).alias(c) for c in (*BOX, "kp_x", "kp_y")])


@query(f"select sheet_id, cast(i as int) as i, round(100 + 290e0 * i, 3) as u, round(120 + 37e0 * (i * i % 60), 3) as v from sheets cross join n where i < 9")
def fit_homography_many(spark: SparkSession, d: str) -> DataFrame:
    """Nine pairs under a perspective give back the template's points."""
    i = F.col("i")
    points = load(spark, d, "sheets").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumns({"u": 100 + 290.0 * i, "v": 120 + 37.0 * (i * i % 60)})
    w = 1 + F.expr(_TILT) * F.col("u")
    points = points.withColumns({"x": F.col("u") / w, "y": F.col("v") / w})
    mapped = registration.transform_points(points.select("sheet_id", "i", "x", "y").join(registration.fit_homography_many(points), "sheet_id"))
    return mapped.select("sheet_id", "i", F.round("x", 3).alias("u"), F.round("y", 3).alias("v"))


# Files and formats -----------------------------------------------------------------------------------------------------------

_LINE = "printf('%d {0} {0} {0} {0}', cast(category as int), {1} / 3300, {2} / 2550, ({3} - {4}) / 3300, ({5} - {6}) / 2550)"


def _yolo_sql(p: str) -> str:
    return _LINE.format(p, CX, CY, R, L, B, T)


def _on_sheet(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "det").withColumns({"width": F.lit(3300), "height": F.lit(2550)})


@query(f"select sheet_id, det_id, {_yolo_sql('%.6f')} as line from det")
def write_yolo_boxes(spark: SparkSession, d: str) -> DataFrame:
    return formats.yolo_box_lines(_on_sheet(spark, d), load(spark, d, "classes"), 6).select("sheet_id", "det_id", "line")


@query(f"select sheet_id, det_id, category, {EDGES} from det")
def read_yolo_boxes(spark: SparkSession, d: str) -> DataFrame:
    lines = formats.yolo_box_lines(_on_sheet(spark, d), load(spark, d, "classes"), 10).select("sheet_id", "det_id", "width", "height", "line")
    return formats.parse_yolo_boxes(lines, load(spark, d, "classes")).select("sheet_id", "det_id", "category", *[F.round(c, 3).alias(c) for c in BOX])


_HIDDEN = f"select * replace (kp_x + det_id % 4 * 10 as kp_x) from det"


@query(f"select sheet_id, det_id, concat({_yolo_sql('%.6f')}, case when kp_x between {L} and {R} and kp_y between {T} and {B} then printf(' %.6f %.6f 2', kp_x / 3300, kp_y / 2550) else ' 0 0 0' end) as line from ({_HIDDEN}) q")
def write_yolo_keypoints(spark: SparkSession, d: str) -> DataFrame:
    rows = _on_sheet(spark, d).withColumn("kp_x", F.col("kp_x") + F.col("det_id") % 4 * 10)
    return formats.yolo_keypoint_lines(rows, load(spark, d, "classes"), 6, True).select("sheet_id", "det_id", "line")


@query(f"select sheet_id, det_id, category, {EDGES}, kp_x, kp_y from det")
def read_yolo_keypoints(spark: SparkSession, d: str) -> DataFrame:
    lines = formats.yolo_keypoint_lines(_on_sheet(spark, d), load(spark, d, "classes"), 10).select("sheet_id", "det_id", "width", "height", "line")
    return formats.parse_yolo_keypoints(lines, load(spark, d, "classes")).select("sheet_id", "det_id", "category", *[F.round(c, 3).alias(c) for c in (*BOX, "kp_x", "kp_y")])


@query(f"select sheet_id, det_id as ann_id, category, {EDGES} from det")
def read_coco(spark: SparkSession, d: str) -> DataFrame:
    names = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.alias("id"), i.cast("string").alias("name")))
    ann = F.struct(F.col("det_id").alias("id"), F.col("sheet_id").alias("image_id"), F.col("category").cast("int").alias("category_id"), F.array(F.col("left"), F.col("top"), F.col("right") - F.col("left"), F.col("bottom") - F.col("top")).alias("bbox"))
    texts = load(spark, d, "det").groupBy("sheet_id").agg(F.to_json(F.struct(F.collect_list(ann).alias("annotations"), names.alias("categories"))).alias("json"))
    docs = texts.select("sheet_id", F.from_json("json", COCO, {"mode": "FAILFAST"}).alias("doc"))
    return formats.parse_coco(docs).select("sheet_id", "ann_id", "category", *BOX)


@query(f"select sheet_id, concat('sheet', sheet_id, '.png') as image, category, {EDGES} from det")
def read_label_studio(spark: SparkSession, d: str) -> DataFrame:
    v = F.struct((F.col("left") / 33).alias("x"), (F.col("top") / 25.5).alias("y"), ((F.col("right") - F.col("left")) / 33).alias("width"), ((F.col("bottom") - F.col("top")) / 25.5).alias("height"), F.array("category").alias("rectanglelabels"))
    image = F.struct(F.concat(F.lit("/data/upload/1-ab-sheet"), F.col("sheet_id").cast("string"), F.lit(".png")).alias("image"))
    texts = load(spark, d, "det").groupBy("sheet_id").agg(F.to_json(F.array(F.struct(image.alias("data"), F.array(F.struct(F.collect_list(F.struct(v.alias("value"))).alias("result"))).alias("annotations")))).alias("json"))
    tasks = texts.select("sheet_id", F.explode(F.from_json("json", LABEL_STUDIO, {"mode": "FAILFAST"})).alias("task"))
    return formats.parse_label_studio(tasks).select("sheet_id", "image", "category", *[F.round(c, 6).alias(c) for c in BOX])


@query(f"select sheet_id, category, {EDGES}, kp_x, kp_y, confidence, row_number() over (partition by sheet_id order by det_id) - 1 as ord from det")
def detections_json(spark: SparkSession, d: str) -> DataFrame:
    texts = formats.detections_json(load(spark, d, "det"), "keypoint")
    return formats.parse_detections(texts, "keypoint").select("sheet_id", "category", *BOX, "kp_x", "kp_y", "confidence", "ord")


@query(f"select sheet_id, category, {EDGES}, cast(null as double) as kp_x, cast(null as double) as kp_y, confidence, row_number() over (partition by sheet_id order by det_id) - 1 as ord from det")
def detections_json_boxes(spark: SparkSession, d: str) -> DataFrame:
    texts = formats.detections_json(load(spark, d, "det"), "box")
    return formats.parse_detections(texts, "box").select("sheet_id", "category", *BOX, "kp_x", "kp_y", "confidence", "ord")


def _new_folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/sheetwise-files-{uuid.uuid4().hex}"
    forget(spark, path)
    return path


@query(f"select sheet_id, {_yolo_sql('%.6f')} as line from det")
def yolo_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines written to files of many images each, and read back with their images."""
    path = _new_folder(spark)
    rows = formats.yolo_box_lines(_on_sheet(spark, d), load(spark, d, "classes"), 6)
    formats.write_lines(rows.withColumn("image", F.col("sheet_id")), path)
    return formats.read_lines(spark, path, "long").select(F.col("image").alias("sheet_id"), "line")


@query(f"select sheet_id, category, {EDGES}, kp_x, kp_y, confidence, row_number() over (partition by sheet_id order by det_id) - 1 as ord from det")
def detections_files(spark: SparkSession, d: str) -> DataFrame:
    """JSON files of the detections of many sheets each, and read back."""
    path = _new_folder(spark)
    formats.write_detections_json(load(spark, d, "det"), path, "keypoint")
    return formats.read_keyed_detections(spark, path, "keypoint").select("sheet_id", "category", *BOX, "kp_x", "kp_y", "confidence", "ord")


@query(f"select concat(sheet_id, '.txt') as name, string_agg({_yolo_sql('%.6f')}, chr(10) order by det_id) as content from det group by sheet_id")
def yolo_image_files(spark: SparkSession, d: str) -> DataFrame:
    """A file of lines for each image, read back whole with its name."""
    path = _new_folder(spark)
    rows = formats.yolo_box_lines(_on_sheet(spark, d), load(spark, d, "classes"), 6)
    files.write_yolo_files(rows.withColumn("image", F.col("sheet_id")), path)
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("name"), F.col("value").alias("content"))


@query(f"select sheet_id, category, {EDGES}, kp_x, kp_y, confidence, row_number() over (partition by sheet_id order by det_id) - 1 as ord from det")
def detection_image_files(spark: SparkSession, d: str) -> DataFrame:
    """A JSON file of detections for each sheet, read back."""
    path = _new_folder(spark)
    files.write_detection_files(load(spark, d, "det"), path, "keypoint")
    return files.read_named_detections(spark, path, "keypoint").select("sheet_id", "category", *BOX, "kp_x", "kp_y", "confidence", "ord")


#: Lines of which some lack a field, name an unknown class or hold a word for a number; by the detection's number.
_SPOILED = f"(select *, det_id % 7 as fault, {_yolo_sql('%.9f')} as plain from det)"
_SPOIL = {0: "regexp_replace(plain, ' [^ ]*$', '')", 1: "concat('99', substr(plain, 2))", 2: "concat(plain, 'x')"}
_SPOILED_LINE = "case " + " ".join(f"when fault = {k} then {v}" for k, v in _SPOIL.items()) + " else plain end"


def _spoiled(spark: SparkSession, d: str) -> DataFrame:
    lines = formats.yolo_box_lines(_on_sheet(spark, d), load(spark, d, "classes"), 9).withColumnRenamed("line", "plain").withColumn("fault", F.col("det_id") % 7)
    return lines.select("det_id", F.concat(F.lit("sheet"), F.col("sheet_id").cast("string")).alias("origin"), "width", "height", F.expr(_SPOILED_LINE).alias("line"))


@query(f"select det_id, origin, category, {EDGES} from (select *, concat('sheet', sheet_id) as origin from {_SPOILED}) q where fault > 2")
def yolo_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Good lines among bad ones."""
    good = quarantine.check_yolo(_spoiled(spark, d), load(spark, d, "classes")).good
    return good.select("det_id", "origin", "category", *[F.round(c, 3).alias(c) for c in BOX])


@query(f"select {_SPOILED_LINE} as line, concat('sheet', sheet_id) as origin, case fault when 0 then 'fields' when 1 then 'class' else 'number' end as reason from {_SPOILED} q where fault <= 2")
def yolo_rejected(spark: SparkSession, d: str) -> DataFrame:
    """What is set aside of the same lines."""
    return quarantine.check_yolo(_spoiled(spark, d), load(spark, d, "classes")).rejects


def _spoiled_coco(spark: SparkSession, d: str) -> DataFrame:
    """A COCO document for each sheet; every fifth annotation has an unknown category, another fifth three numbers; every tenth document is cut short."""
    c = F.col
    names = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.alias("id"), i.cast("string").alias("name")))
    box = F.array(c("left"), c("top"), c("right") - c("left"), c("bottom") - c("top"))
    ann = F.struct(
        c("det_id").alias("id"), c("sheet_id").alias("image_id"), F.when(c("det_id") % 5 == 1, 77).otherwise(c("category").cast("int")).alias("category_id"), F.when(c("det_id") % 5 == 2, F.slice(box, 1, 3)).otherwise(box).alias("bbox")
    )
    texts = load(spark, d, "det").groupBy("sheet_id").agg(F.to_json(F.struct(F.collect_list(ann).alias("annotations"), names.alias("categories"))).alias("json"))
    return texts.select("sheet_id", F.concat(F.lit("doc"), c("sheet_id").cast("string")).alias("origin"), F.when(c("sheet_id") % 10 == 3, F.substring("json", 1, 40)).otherwise(c("json")).alias("json"))


@query(f"select sheet_id, det_id as ann_id, category, {EDGES} from det where det_id % 5 not in (1, 2) and sheet_id % 10 <> 3")
def coco_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Good annotations of COCO documents with bad ones."""
    return quarantine.check_coco(_spoiled_coco(spark, d)).good.select("sheet_id", "ann_id", "category", *BOX)


@query("""select origin, reason, count(*) as n from (select concat('doc', sheet_id) as origin, case when det_id % 5 = 1 then 'category' else 'box' end as reason from det where det_id % 5 in (1, 2) and sheet_id % 10 <> 3
 union all select concat('doc', sheet_id), 'document' from (select distinct sheet_id from det) s where sheet_id % 10 = 3) q group by origin, reason""")
def coco_rejected(spark: SparkSession, d: str) -> DataFrame:
    """How many annotations and documents are set aside, and why."""
    return quarantine.check_coco(_spoiled_coco(spark, d)).rejects.groupBy("origin", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("select cast(sheet_id as varchar) as form, name, cx, cy from code_centroids cross join sheets")
def read_centroids(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.map_from_entries(F.collect_list(F.struct("name", F.array("cx", "cy"))))
    return formats.parse_centroids(load(spark, d, "sheet_centroids").groupBy("form").agg(F.to_json(pairs).alias("json")))


@query("select concat('model', sheet_id) as source, concat('net', sheet_id % 7) as name, cast(640 + sheet_id % 3 * 64 as int) as imgsz, 0.25e0 as tile_size_proportion, 0.5e0 as horz_overlap_proportion, 0.5e0 as vert_overlap_proportion from sheets")
def read_model_config(spark: SparkSession, d: str) -> DataFrame:
    half = F.lit(0.5)
    conf = F.struct(F.concat(F.lit("net"), (F.col("sheet_id") % 7).cast("string")).alias("name"), (640 + F.col("sheet_id") % 3 * 64).cast("int").alias("imgsz"), F.lit(0.25).alias("tile_size_proportion"), half.alias("horz_overlap_proportion"), half.alias("vert_overlap_proportion"))
    texts = load(spark, d, "sheets").select(F.to_json(F.create_map(F.concat(F.lit("model"), F.col("sheet_id").cast("string")), conf)).alias("json"))
    return formats.parse_model_config(texts)


@query("select cast(sheet_id as varchar) as source, cast(sheet_id % 50 as int) as class_id, concat('name', sheet_id % 9) as category from sheets")
def read_classes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("sheet_id")
    texts = load(spark, d, "sheets").select(c.cast("string").alias("source"), F.to_json(F.create_map((c % 50).cast("string"), F.concat(F.lit("name"), (c % 9).cast("string")))).alias("json"))
    return formats.parse_classes(texts)


@query("""select s.sheet_id, 4 + s.sheet_id % 3 as height, 8 as width, 3 as n_channels, string_agg(printf('%02X', cast((s.sheet_id * 7 + y.i * 31 + x.i * 11) % 256 as int)), '' order by y.i, x.i) as pixels
from sheets s join n y on y.i < 4 + s.sheet_id % 3 join n x on x.i < 24 group by s.sheet_id""")
def read_images(spark: SparkSession, d: str) -> DataFrame:
    """A picture file for each sheet, written by the sink and read through Spark's image source."""
    path = _new_folder(spark)
    files.write_files(_pictures(load(spark, d, "sheets").selectExpr("sheet_id", "4 + sheet_id % 3 as height", "8 as width"), "(sheet_id * 7 + y * 31 + i * 11) % 256"), path)
    sheet = F.regexp_extract("origin", r"([0-9]+)\.bmp$", 1).cast("long").alias("sheet_id")
    return formats.read_images(spark, path).select(sheet, "height", "width", F.col("nChannels").alias("n_channels"), F.hex("data").alias("pixels"))


def _pictures(sheets: DataFrame, value: str) -> DataFrame:
    """Bitmap files ``name, content`` of rows ``sheet_id, height, width`` (a multiple of 4); ``value`` is byte ``i`` of row ``y``, three for each pixel."""
    number = lambda c: f"hex(reverse(unhex(lpad(hex({c}), 8, '0'))))"
    pixels = f"array_join(transform(sequence(height - 1, 0, -1), y -> array_join(transform(sequence(0, 3 * width - 1), i -> lpad(hex({value}), 2, '0')), '')), '')"
    head = ["'424D'", number("54 + 3 * width * height"), "'00000000'", number("54"), number("40"), number("width"), number("height"), "'01001800'", "'00000000'", number("3 * width * height"), f"'{'0' * 32}'"]
    return sheets.selectExpr("concat(sheet_id, '.bmp') as name", f"unhex(concat({', '.join(head)}, {pixels})) as content")


# Model output ----------------------------------------------------------------------------------------------------------------

@query(f"""select anchor_id, tile_id, concat('class', list_position(scores, list_max(scores)) - 1) as category, cast(list_max(scores) as double) as confidence,
 cx - w / 2 as {L}, cy - h / 2 as {T}, cx + w / 2 as {R}, cy + h / 2 as {B} from raw_predictions where list_max(scores) >= 0.3""")
def decode_boxes(spark: SparkSession, d: str) -> DataFrame:
    return decode.decode_boxes(load(spark, d, "raw_predictions"), load(spark, d, "vector_classes"), 0.3).select("anchor_id", "tile_id", "category", "confidence", *BOX)


#: Scores of an anchor.
_SCORES = 64


@query("select tile_id, row_number() over (partition by tile_id order by anchor_id) - 1 as pos, cx as r0, cy as r1, w as r2, h as r3, " + ", ".join(f"cast(scores[{i + 1}] as double) as r{i + 4}" for i in range(_SCORES)) + " from raw_predictions")
def anchors_from_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Raw output of a model, a matrix of rows for each tile, to a row for each anchor."""
    values = F.concat(F.array(*[F.col(c).cast("double") for c in ("cx", "cy", "w", "h")]), F.col("scores").cast("array<double>"))
    rows = F.array_sort(F.collect_list(F.struct("anchor_id", values.alias("v"))))
    matrix = F.expr(f"transform(sequence(0, {_SCORES + 3}), i -> transform(rows, x -> x.v[i]))")
    tiles = load(spark, d, "raw_predictions").groupBy("tile_id").agg(rows.alias("rows")).select("tile_id", matrix.alias("output"))
    return decode.anchors_from_matrix(tiles, _SCORES + 4, ("tile_id",)).withColumn("pos", F.col("pos").cast("long"))


@query(f"""select anchor_id, 'class0' as category, cast(list_max(scores) as double) as confidence, cx - w / 2 as {L}, cy - h / 2 as {T}, cx + w / 2 as {R}, cy + h / 2 as {B}, kp_x, kp_y from (
 select *, cx + anchor_id % 9 * 4 - 16 as kp_x, cy + anchor_id % 5 * 4 - 8 as kp_y from raw_predictions) q where list_max(scores) >= 0.1 and abs(kp_x - cx) < w / 2 and abs(kp_y - cy) < h / 2""")
def decode_keypoints(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "raw_predictions").withColumns({"score": F.array_max("scores"), "kp_x": F.col("cx") + F.col("anchor_id") % 9 * 4 - 16, "kp_y": F.col("cy") + F.col("anchor_id") % 5 * 4 - 8}).drop("scores")
    return decode.decode_keypoints(rows, load(spark, d, "vector_classes"), 0.1).select("anchor_id", "category", "confidence", *BOX, "kp_x", "kp_y")


_PRED = f"select sheet_id as image_id, det_id as pos, {EDGES}, confidence, cast(category as int) as class_id, kp_x + case when sheet_id % 3 = 0 and det_id % 5 = 0 then 100 else 0 end as kp_x, kp_y from det"


def _predictions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    det = load(spark, d, "det").select(F.col("sheet_id").alias("image_id"), F.col("det_id").alias("pos"), *BOX, "confidence", F.col("category").cast("int").alias("class_id"), "kp_x", "kp_y")
    moved = F.col("kp_x") + F.when((F.col("image_id") % 3 == 0) & (F.col("pos") % 5 == 0), 100).otherwise(0)
    return det.drop("kp_x", "kp_y"), load(spark, d, "classes"), det.select("image_id", "pos", moved.alias("kp_x"), "kp_y")


@query(f"select image_id, pos, cast(class_id as varchar) as category, kp_x, kp_y from ({_PRED}) q where kp_x between {L} and {R} and kp_y between {T} and {B}")
def predictions_pose(spark: SparkSession, d: str) -> DataFrame:
    b, c, k = _predictions(spark, d)
    return decode.prediction_rows_to_detections(b, c, k, "pose").select("image_id", "pos", "category", "kp_x", "kp_y")


@query(f"select image_id, pos, cast(class_id as varchar) as category, case when ok then kp_x end as kp_x, case when ok then kp_y end as kp_y from (select *, bool_and(kp_x between {L} and {R} and kp_y between {T} and {B}) over (partition by image_id) as ok from ({_PRED}) p) q")
def predictions_box(spark: SparkSession, d: str) -> DataFrame:
    b, c, k = _predictions(spark, d)
    return decode.prediction_rows_to_detections(b, c, k, "box").select("image_id", "pos", "category", "kp_x", "kp_y")


def bright_spots() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A stand-in for a detector: a box around each tile's pixels of value 255, by column."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        keys = [c for c in pdf.columns if c not in ("slice_w", "slice_h", "nChannels", "data")]
        for row in pdf.itertuples(index=False):
            tile = np.frombuffer(row.data, np.uint8).reshape(row.slice_h, row.slice_w, row.nChannels)
            for pos, x in enumerate(np.flatnonzero((tile[:, :, 0] == 255).any(axis=0))):
                out.append((*(getattr(row, k) for k in keys), pos, str(x % 10), float(x), 0.0, float(x) + 1, float(row.slice_h), 0.9))
        return pd.DataFrame(out, columns=[*keys, "pos", "category", "left", "top", "right", "bottom", "confidence"])

    return run


#: Bright columns of each tile, and which of them suppression keeps: the first tile that shows a column.
_SPOTS = """(select *, row_number() over (partition by sheet_id order by r, c, pos) - 1 as ord from (select *, row_number() over (partition by sheet_id, r, g order by c) as k from (
 select sheet_id, r, c, x, 3 * c + x as g, row_number() over (partition by sheet_id, r, c order by x) - 1 as pos from (select sheet_id, cast(a.i as int) as r, cast(b.i as int) as c, cast(f.i as int) as x from sheets cross join n a cross join n b cross join n f where a.i < 3 and b.i < 4 and f.i < 5) p
 where 3 * c + x < 12 and ((3 * c + x) % 3 = 2 or ((3 * c + x) % 3 = 1 and sheet_id % 256 = 255))) q) s where k = 1)"""


@query(f"select sheet_id, cast(x % 10 as varchar) as category, cast(g as double) as {L}, cast(3 * r as double) as {T}, g + 1e0 as {R}, 3 * r + 4e0 as {B}, 0.9e0 as confidence, ord from {_SPOTS} t")
def detect_with_tiling(spark: SparkSession, d: str) -> DataFrame:
    return decode.detect_with_tiling(_painted(spark, d), bright_spots).select("sheet_id", "category", *BOX, "confidence", "ord")


@query(f"select sheet_id, source, cast(x % 10 as varchar) as category, cast(g as double) as {L}, cast(3 * r as double) as {T}, g + 1e0 as {R}, 3 * r + 4e0 as {B}, 0.9e0 as confidence, ord from {_SPOTS} t cross join (values ('numbers'), ('checkboxes')) v(source)")
def score_side(spark: SparkSession, d: str) -> DataFrame:
    models = {"numbers": (bright_spots, False), "checkboxes": (bright_spots, False)}
    return assemble.score_side(_painted(spark, d), models).select("sheet_id", "source", "category", *BOX, "confidence", "ord")


# Whole sheets ----------------------------------------------------------------------------------------------------------------

@query("select * from front_facts")
def interpret_front(spark: SparkSession, d: str) -> DataFrame:
    return assemble.interpret_front(load(spark, d, "front_det"), load(spark, d, "centroids"), load(spark, d, "template"), "dbscan")


def _interpret_front_by(method: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return assemble.interpret_front(load(spark, d, "front_det"), load(spark, d, "centroids"), load(spark, d, "template"), method)

    f.__name__ = f"interpret_front_{method}"
    query("select * from front_facts")(f)


_interpret_front_by("kmeans")
_interpret_front_by("agglomerative")


@query("select * from back_facts")
def interpret_back(spark: SparkSession, d: str) -> DataFrame:
    return assemble.interpret_back(load(spark, d, "back_det"), load(spark, d, "centroids"), load(spark, d, "template"))


@query(f"""select sheet_id, concat('{{"intraoperative":', coalesce(f.record, '{{}}'), ',"preoperative_postoperative":', coalesce(b.record, '{{}}'), '}}') as record
from ({O.record('front_facts')}) f full join ({O.record('back_facts')}) b using (sheet_id)""")
def interpret_sheets(spark: SparkSession, d: str) -> DataFrame:
    return assemble.interpret_sheets(interpret_front(spark, d), interpret_back(spark, d))


# Images to records -----------------------------------------------------------------------------------------------------------

#: Pixels of a spelled detection, detections in a row of pixels, and rows of a tile.
LINE, IN_ROW, TILE_ROWS = 160, 2, 16


def written_detections(source: str, points: bool = False) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A stand-in for a source's model: reads the detections that stand as text in a tile's pixels.

    What a text says is relative to the pixel where it begins, so a detection's place in the image follows from the tile it was found in; one that several tiles show is found in each.
    """
    start = f"{source}|".encode()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            data = row.data
            for at in range(0, len(data), row.slice_w):
                for x in range(0, row.slice_w, LINE):
                    if data.startswith(start, at + x):
                        y = at // row.slice_w
                        _, category, confidence, *offsets = data[at + x : at + min(x + LINE, row.slice_w)].strip(b" \x00").decode().split("|")
                        where = [float(v) + (x, y)[i % 2] if v else None for i, v in enumerate(offsets)]
                        out.append((row.sheet_id, row.tile_row, row.tile_col, y * IN_ROW + x // LINE, category, *where[:4], float(confidence), *where[4:]))
        frame = pd.DataFrame(out, columns=["sheet_id", "tile_row", "tile_col", "pos", "category", *BOX, "confidence", "kp_x", "kp_y"])
        return frame.astype({"kp_x": float, "kp_y": float}) if points else frame.drop(columns=["kp_x", "kp_y"])

    return run


#: All detections but the second marks of checkboxes, which a model's suppression of duplicates would drop.
_SHOWN = "(det_id not between 70000 and 79999 or det_id % 4 = 0)"


def _photographed(spark: SparkSession, d: str, det: str) -> DataFrame:
    """One-channel images whose pixels spell all detections of a side, two in a row; tiles overlap by half in both directions."""
    rows = load(spark, d, det).where(_SHOWN)
    placed = rows.withColumn("_i", F.row_number().over(Window.partitionBy("sheet_id").orderBy("det_id", "source")) - 1)
    x, y = F.col("_i") % IN_ROW * LINE, F.floor(F.col("_i") / IN_ROW)
    offset = lambda c, o: F.coalesce((F.col(c) - o).cast("string"), F.lit(""))
    offsets = [offset(c, o) for c, o in (("left", x), ("top", y), ("right", x), ("bottom", y), ("kp_x", x), ("kp_y", y))]
    line = F.rpad(F.concat_ws("|", "source", "category", F.col("confidence").cast("string"), *offsets), LINE, " ")
    text = placed.groupBy("sheet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", line.alias("line")))), lambda z: z["line"]), "").alias("text"), F.count(F.lit(1)).alias("n"))
    height = F.greatest(F.ceil(F.col("n") / IN_ROW).cast("int"), F.lit(TILE_ROWS))
    half, width = F.lit(0.5), F.lit(IN_ROW * LINE)
    return text.select("sheet_id", width.alias("width"), height.alias("height"), F.lit(1).alias("nChannels"), F.rpad("text", height * width, " ").cast("binary").alias("data"), width.alias("slice_w"), F.lit(TILE_ROWS).alias("slice_h"), half.alias("ov_x"), half.alias("ov_y"))


def _factories(sources: tuple[str, ...]) -> dict[str, Callable]:
    return {s: partial(written_detections, s, s in assemble.KEYPOINT_SOURCES) for s in sources}


def _digitized(spark: SparkSession, d: str, nested: bool) -> DataFrame:
    front, back = _factories(assemble.FRONT_SOURCES), _factories(assemble.BACK_SOURCES)
    return assemble.digitize_sheets(_photographed(spark, d, "front_det"), _photographed(spark, d, "back_det"), front, back, load(spark, d, "centroids"), load(spark, d, "template"), nested, method="dbscan")


_FIRST_MARKS = "(select * from box_marks where det_id % 4 = 0)"
_OF_FRONT = "section in ('codes', 'ett_size') or (section = 'timing' and contains(key, '_'))"
_DIGIT_FRONT = f"(select * from front_facts where section <> 'checkboxes' union all {O.boxes(_FIRST_MARKS, 'front_checkboxes')}) ff"
_DIGIT_BACK = f"(select * from field_facts where not ({_OF_FRONT}) union all {O.boxes(_FIRST_MARKS, 'back_checkboxes')}) bf"


@query(f"""select sheet_id, concat('{{"intraoperative":', coalesce(f.record, '{{}}'), ',"preoperative_postoperative":', coalesce(b.record, '{{}}'), '}}') as record
from ({O.record(_DIGIT_FRONT)}) f full join ({O.record(_DIGIT_BACK)}) b using (sheet_id)""")
def digitize_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Images of both sides to one record a sheet, nested by side."""
    return _digitized(spark, d, True)


@query(f"""select * from (with a as materialized (select * from {_DIGIT_FRONT}), b as materialized (select * from {_DIGIT_BACK})
{O.record("(select * from b union all select * from a where (sheet_id, section) not in (select (sheet_id, section) from b)) m")}) flat""")
def digitize_sheets_flat(spark: SparkSession, d: str) -> DataFrame:
    """As digitize_sheets, in one level: a section that both sides have is the back's."""
    return _digitized(spark, d, False)


_POINTS = ", ".join(f"case when source in ({O.members(list(assemble.KEYPOINT_SOURCES))}) then {c} end as {c}" for c in ("kp_x", "kp_y"))


@query(f"""select sheet_id, 'intraoperative' as side, source, category, {EDGES}, {_POINTS}, confidence from front_det where {_SHOWN}
union all select sheet_id, 'preoperative_postoperative', source, category, {EDGES}, {_POINTS}, confidence from back_det where {_SHOWN}""")
def score_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Both sets of models over both sides' images: every detection once, at its place in the image."""
    found = assemble.score_sheets(_photographed(spark, d, "front_det"), _photographed(spark, d, "back_det"), _factories(assemble.FRONT_SOURCES), _factories(assemble.BACK_SOURCES))
    return found.select("sheet_id", "side", "source", "category", *BOX, "kp_x", "kp_y", "confidence")
