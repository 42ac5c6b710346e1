"""Box and keypoint operators that work row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import geometry as G
from sheetwise.schema import BOX, KEYS


def validate_boxes(df: DataFrame, mode: str = "status") -> DataFrame:
    """Adds ``status``; with mode ``fail`` an invalid box ends the query instead."""
    if mode == "status":
        return df.withColumn("status", G.box_status())
    if mode != "fail":
        raise ValueError("mode is status or fail")
    return df.withColumn("left", G.raise_unless(G.box_status() != "invalid", "box edges are in the wrong order", F.col("left")))


def validate_keypoints(df: DataFrame, mode: str = "status") -> DataFrame:
    """Adds ``keypoint_ok``; with mode ``fail`` a keypoint outside its box ends the query instead."""
    if mode == "status":
        return df.withColumn("keypoint_ok", G.keypoint_within())
    if mode != "fail":
        raise ValueError("mode is status or fail")
    return df.withColumn("kp_x", G.raise_unless(G.keypoint_within(), "keypoint lies outside its box", F.col("kp_x")))


def with_box(df: DataFrame, left: Column, top: Column, right: Column, bottom: Column, check: bool = True) -> DataFrame:
    """Replace the box, keep the category."""
    out = df.withColumns(dict(zip(BOX, (left, top, right, bottom))))
    return validate_boxes(out, "fail") if check else out


def with_keypoint(df: DataFrame, x: Column, y: Column, check: bool = True) -> DataFrame:
    """Replace the keypoint, keep the box."""
    out = df.withColumns({"kp_x": x, "kp_y": y})
    return validate_keypoints(out, "fail") if check else out


def with_box_and_keypoint(df: DataFrame, box: tuple[Column, Column, Column, Column], point: tuple[Column, Column], check: bool = True) -> DataFrame:
    out = df.withColumns(dict(zip((*BOX, "kp_x", "kp_y"), (*box, *point))))
    return validate_keypoints(validate_boxes(out, "fail"), "fail") if check else out


def normalize_center(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Adds ``nx``, ``ny``: the centre over the image's width and height."""
    return df.withColumns({"nx": G.center_x() / width, "ny": G.center_y() / height})


def scale_to_image(df: DataFrame, width: Column, height: Column, net_width: Column, net_height: Column) -> DataFrame:
    """Network coordinates to image coordinates, edges and keypoint."""
    x, y = width / net_width, height / net_height
    by = {"left": x, "top": y, "right": x, "bottom": y, "kp_x": x, "kp_y": y}
    return df.withColumns({c: F.col(c) * f for c, f in by.items() if c in df.columns})


def filter_confidence(df: DataFrame, least: float = 0.5) -> DataFrame:
    return df.where(F.col("confidence") >= least)


def landmark_by_name(det: DataFrame, names: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The first detection (by ``ord``) of each of ``names`` on each sheet."""
    row = F.struct("ord", *[c for c in det.columns if c not in (*keys, "category", "ord")])
    first = det.where(F.col("category").isin(names)).groupBy(*keys, "category").agg(F.min_by(row, "ord").alias("d"))
    return first.select(*keys, "category", "d.*")


def landmark_values(det: DataFrame, wanted: dict[str, tuple[str, Column]], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row per sheet with a value of the first detection of some landmarks: output name -> (landmark, expression)."""
    names = sorted({n for n, _ in wanted.values()})
    return det.where(F.col("category").isin(names)).groupBy(*keys).agg(*[F.min_by(F.when(F.col("category") == n, e), F.when(F.col("category") == n, F.col("ord"))).alias(out) for out, (n, e) in wanted.items()])
