"""Readers that set bad input aside: good rows, and a table of rejects (line, origin, reason), from one reading.

What is read is parsed once and written to the shared folder with a reason for each bad row; both tables are parts of that. Origin is the column ``origin`` of the input, null where it has none.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise import schema as S
from sheetwise.functions import geometry as G
from sheetwise.operators.nearest import small
from sheetwise.runtime import cut
from sheetwise.schema import BOX
from sheetwise.sources import formats


class Checked(NamedTuple):
    good: DataFrame
    rejects: DataFrame


def _split(rows: DataFrame, names: list[str]) -> Checked:
    """``rows`` have ``_line``, ``_reason`` (null for good ones) and the columns ``names``."""
    if "origin" not in rows.columns:
        rows = rows.withColumn("origin", F.lit(None).cast("string"))
    extra = [] if "origin" in names else ["origin"]
    made = cut(rows.sparkSession, rows.select(*names, *extra, "_line", "_reason"))
    return Checked(made.where("_reason is null").select(names), made.where("_reason is not null").select(F.col("_line").alias("line"), "origin", F.col("_reason").alias("reason")))


def _number(text: Column) -> Column:
    """A finite number, or null."""
    n = text.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def _first(*reasons: tuple[Column, str]) -> Column:
    """The first reason that holds."""
    out = None
    for holds, text in reasons:
        bad = F.coalesce(holds, F.lit(True))
        out = F.when(bad, text) if out is None else out.when(bad, text)
    return out


def check_yolo(lines: DataFrame, classes: DataFrame, keypoints: bool = False) -> Checked:
    """As :func:`formats.parse_yolo_boxes` (or keypoints). Reasons: ``fields`` (too few), ``number``, ``class``, ``image size``, ``keypoint`` (outside its box)."""
    need = 7 if keypoints else 5
    field = lambda i: F.try_element_at("_f", F.lit(i))
    n = lambda i: _number(field(i))
    rows = lines.withColumns({"_line": F.col("line"), "_f": F.split(F.trim("line"), r"\s+")}).withColumn("class_id", field(1).try_cast("int"))
    rows = rows.join(small(classes.select("class_id", F.col("category"))), "class_id", "left")
    w, h = F.col("width"), F.col("height")
    edges = {"left": (n(2) - n(4) / 2) * w, "top": (n(3) - n(5) / 2) * h, "right": (n(2) + n(4) / 2) * w, "bottom": (n(3) + n(5) / 2) * h}
    rows = rows.withColumns(edges | ({"kp_x": n(6) * w, "kp_y": n(7) * h} if keypoints else {}))
    number = F.col("class_id").isNull()
    for i in range(2, need + 1):
        number = number | n(i).isNull()
    checks = [(F.size("_f") < need, "fields"), (number, "number"), (F.col("category").isNull(), "class"), (~((w > 0) & (h > 0)), "image size")]
    if keypoints:
        checks.append((~G.keypoint_within(), "keypoint"))
    names = [c for c in lines.columns if c not in ("category", "class_id")] + ["class_id", "category", *edges, *(("kp_x", "kp_y") if keypoints else ())]
    return _split(rows.withColumn("_reason", _first(*checks)), names)


_ANNOTATION = S.COCO["annotations"].dataType.elementType


def check_coco(docs: DataFrame) -> Checked:
    """COCO documents in ``json``; a bad annotation goes alone, a bad document whole. Reasons: ``document``, ``annotation`` (not of that form), ``box`` (not four numbers), ``category`` (unknown)."""
    loose = T.StructType([T.StructField("annotations", T.ArrayType(T.StringType())), S.COCO["categories"]])
    cols = [c for c in docs.columns if c != "json"]
    rows = docs.select(*cols, "json", F.from_json("json", loose).alias("doc"))
    bad = F.col("doc.annotations").isNull()
    every = F.when(bad, F.array(F.lit(None).cast("string"))).otherwise(F.col("doc.annotations"))
    rows = rows.select("*", bad.alias("_whole"), F.posexplode(every).alias("pos", "_a"))
    rows = rows.withColumns({"a": F.from_json("_a", _ANNOTATION), "_line": F.when(F.col("_whole"), F.col("json")).otherwise(F.col("_a"))})
    name = F.filter(F.col("doc.categories"), lambda c: c["id"] == F.col("a.category_id"))
    rows = rows.withColumns({"category": F.try_element_at(name, F.lit(1))["name"], "ann_id": F.col("a.id"), "image_id": F.col("a.image_id")})
    b = lambda i: F.try_element_at("a.bbox", F.lit(i))
    rows = rows.withColumns({"left": b(1), "top": b(2), "right": b(1) + b(3), "bottom": b(2) + b(4)})
    box = (F.size("a.bbox") != 4) | b(1).isNull() | b(2).isNull() | b(3).isNull() | b(4).isNull()
    reason = _first((F.col("_whole"), "document"), (F.col("ann_id").isNull() | F.col("a.category_id").isNull() | F.col("a.bbox").isNull(), "annotation"), (box, "box"), (F.col("category").isNull(), "category"))
    return _split(rows.withColumn("_reason", reason), [*cols, "pos", "ann_id", "image_id", "category", *BOX])


def check_detections(docs: DataFrame, kind: str) -> Checked:
    """JSON arrays of detections in ``json``. Reasons: ``document`` (no array), ``detection`` (not of that kind, or a value missing)."""
    if kind not in formats.KINDS:
        raise ValueError(f"kind is one of {sorted(formats.KINDS)}")
    cols = [c for c in docs.columns if c != "json"]
    rows = docs.select(*cols, "json", F.from_json("json", T.ArrayType(T.StringType())).alias("_d"))
    rows = rows.select("*", F.col("_d").isNull().alias("_whole"), F.posexplode(F.coalesce("_d", F.array(F.lit(None).cast("string")))).alias("pos", "_e"))
    rows = rows.withColumns({"d": F.from_json("_e", formats.KINDS[kind].elementType), "_line": F.when(F.col("_whole"), F.col("json")).otherwise(F.col("_e")), "ord": F.col("pos").cast("long")})
    box = "d.annotation" if kind == "box" else "d.annotation.bounding_box"
    none = F.lit(None).cast("double")
    point = {"kp_x": none, "kp_y": none} if kind == "box" else {"kp_x": F.col("d.annotation.keypoint.x"), "kp_y": F.col("d.annotation.keypoint.y")}
    rows = rows.withColumns({"category": F.col(f"{box}.category"), **{c: F.col(f"{box}.{c}") for c in BOX}, **point, "confidence": F.col("d.confidence")})
    missing = F.lit(False)
    for c in ("category", *BOX, "confidence", *(() if kind == "box" else ("kp_x", "kp_y"))):
        missing = missing | F.col(c).isNull()
    return _split(rows.withColumn("_reason", _first((F.col("_whole"), "document"), (missing, "detection"))), [*cols, "ord", "category", *BOX, "kp_x", "kp_y", "confidence"])


def read_yolo(spark: SparkSession, path: str, images: DataFrame, classes: DataFrame, keypoints: bool = False) -> Checked:
    """YOLO files, one per image, as for :func:`formats.read_yolo_boxes`; lines of an image that ``images`` lacks are rejects too."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    lines = spark.read.text(path).select(name.alias("image"), F.input_file_name().alias("origin"), F.col("value").alias("line")).where("trim(line) <> ''")
    return check_yolo(lines.join(images, "image", "left"), classes, keypoints)


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("origin"), F.col("value").alias("json"))


def read_coco(spark: SparkSession, path: str) -> Checked:
    return check_coco(_whole_files(spark, path))


def read_detections(spark: SparkSession, path: str, kind: str) -> Checked:
    return check_detections(_whole_files(spark, path), kind)
