"""Tiles of images, and annotations cut to tiles and put back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions import geometry as G
from sheetwise.runtime import ship
from sheetwise.schema import KEYS

TILE = ("slice_w", "slice_h", "ov_x", "ov_y")


def validate_tile_params(images: DataFrame, mode: str = "status") -> DataFrame:
    """Adds ``tile_ok``: slices within the image, overlaps strictly between 0 and 1."""
    ok = F.lit(True)
    for s, o, size in (("slice_w", "ov_x", "width"), ("slice_h", "ov_y", "height")):
        ok = ok & (F.col(s) > 0) & (F.col(s) <= F.col(size)) & (F.col(o) > 0) & (F.col(o) < 1)
    if mode == "status":
        return images.withColumn("tile_ok", F.coalesce(ok, F.lit(False)))
    return images.withColumn("ov_x", G.raise_unless(ok, "tile parameters are out of range", F.col("ov_x").cast("double")))


def stride(slice_: Column, overlap: Column) -> Column:
    return F.bround(slice_ * (1 - overlap)).cast("int")


def _axis(size: Column, slice_: Column, overlap: Column) -> Column:
    """Indexes of tiles on an axis: up to the first whose far edge is beyond the image."""
    most = F.ceil(size / (slice_ * (1 - overlap))).cast("int")
    step = stride(slice_, overlap)
    return F.filter(F.sequence(F.lit(0), most - 1), lambda i: (i == 0) | ((i - 1) * step + slice_ <= size))


def tile_grid(images: DataFrame) -> DataFrame:
    """Tiles of every image (with columns width, height, slice_w, slice_h, ov_x, ov_y): tile_row, tile_col and edges ``t_left`` ..."""
    step_x, step_y = stride(F.col("slice_w"), F.col("ov_x")), stride(F.col("slice_h"), F.col("ov_y"))
    rows = images.withColumn("tile_row", F.explode(_axis(F.col("height"), F.col("slice_h"), F.col("ov_y"))))
    rows = rows.withColumn("tile_col", F.explode(_axis(F.col("width"), F.col("slice_w"), F.col("ov_x"))))
    return rows.withColumns({"t_left": F.col("tile_col") * step_x, "t_top": F.col("tile_row") * step_y}).withColumns({"t_right": F.col("t_left") + F.col("slice_w"), "t_bottom": F.col("t_top") + F.col("slice_h")})


def annotations_in_tile(ann: DataFrame, images: DataFrame, keys: tuple[str, ...] = KEYS, touching: bool = True) -> DataFrame:
    """Each annotation with each tile it overlaps.

    The tiles that a box can reach follow from its edges and the image's parameters, so a box meets its image once, and no table of tiles; the
    exact test follows. An image has one row.
    """
    dims = images.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("width", "height", *TILE)])
    cols = [c for c in ann.columns if c not in keys]
    # A hash of the few images of a task: annotations need not be sorted.
    near = ann.join(dims.hint("shuffle_hash"), list(keys))
    exists = F.lit(True)
    for lo, hi, s, o, size, out in (("top", "bottom", "_slice_h", "_ov_y", "_height", "tile_row"), ("left", "right", "_slice_w", "_ov_x", "_width", "tile_col")):
        step = stride(F.col(s), F.col(o))
        first = F.greatest(F.lit(0), F.floor((F.col(lo) - F.col(s)) / step)).cast("int")
        last = F.least(F.floor(F.col(hi) / step), F.ceil(F.col(size) / (F.col(s) * (1 - F.col(o)))) - 1).cast("int")
        near = near.withColumn(f"_{out}", F.explode(F.when(first <= last, F.sequence(first, last))))
        near = near.withColumns({f"_{lo}": F.col(f"_{out}") * step}).withColumn(f"_{hi}", F.col(f"_{lo}") + F.col(s))
        exists = exists & ((F.col(f"_{out}") == 0) | ((F.col(f"_{out}") - 1) * step + F.col(s) <= F.col(size)))
    left, top, right, bottom = G.edges()
    if touching:
        meets = (left <= F.col("_right")) & (right >= F.col("_left")) & (top <= F.col("_bottom")) & (bottom >= F.col("_top"))
    else:
        meets = (left < F.col("_right")) & (right > F.col("_left")) & (top < F.col("_bottom")) & (bottom > F.col("_top"))
    places = [F.col(f"_{c}").alias(c) for c in ("tile_row", "tile_col")]
    return near.where(exists & meets).select(*keys, *places, *cols, *[F.col(f"_{c}").alias(f"t_{c}") for c in ("left", "top", "right", "bottom")])


def shift_coords(df: DataFrame, dx: Column, dy: Column, direction: str) -> DataFrame:
    """Edges and keypoint ``to_image`` (origin added) or ``to_tile`` (origin taken off)."""
    if direction not in ("to_image", "to_tile"):
        raise ValueError("direction is to_image or to_tile")
    sign = 1 if direction == "to_image" else -1
    by = {"left": dx, "top": dy, "right": dx, "bottom": dy, "kp_x": dx, "kp_y": dy}
    return df.withColumns({c: F.col(c) + sign * d for c, d in by.items() if c in df.columns})


def tile_annotations(ann: DataFrame, images: DataFrame, keys: tuple[str, ...] = KEYS, touching: bool = True) -> DataFrame:
    """Annotations cut to each tile they overlap, in tile coordinates. A keypoint may lie outside its cut box."""
    cut = annotations_in_tile(ann, images, keys, touching).withColumns({
        "left": F.greatest("left", F.col("t_left").cast("double")), "top": F.greatest("top", F.col("t_top").cast("double")),
        "right": F.least("right", F.col("t_right").cast("double")), "bottom": F.least("bottom", F.col("t_bottom").cast("double")),
    })
    return shift_coords(cut, F.col("t_left"), F.col("t_top"), "to_tile").drop("t_left", "t_top", "t_right", "t_bottom")


def untile(df: DataFrame, keys: tuple[str, ...] = KEYS, origin: str = "floor") -> DataFrame:
    """Tile coordinates to image coordinates; ``ord`` counts row by row of tiles, then by ``pos`` in the tile.

    ``origin`` says how a tile's corner is rounded: ``floor`` cuts, ``round`` is the place where :func:`tile_grid` cuts it out.
    """
    if origin == "floor":
        dx, dy = ((F.col(i) * F.col(s) * (1 - F.col(o))).cast("int") for i, s, o in (("tile_col", "slice_w", "ov_x"), ("tile_row", "slice_h", "ov_y")))
    elif origin == "round":
        dx, dy = (F.col(i) * stride(F.col(s), F.col(o)) for i, s, o in (("tile_col", "slice_w", "ov_x"), ("tile_row", "slice_h", "ov_y")))
    else:
        raise ValueError("origin is floor or round")
    order = Window.partitionBy(*keys).orderBy("tile_row", "tile_col", "pos")
    return shift_coords(df.withColumn("ord", F.row_number().over(order).cast("long")), dx, dy, "to_image")


def tile_images(images: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Pixels of every tile, black beyond the image.

    ``images`` has the keys, the tile parameters and the fields of Spark's image source (height, width, nChannels, data).
    """
    ship(images.sparkSession)
    names = [*keys, "tile_row", "tile_col", "slice_w", "slice_h", "nChannels", "data"]
    schema = images.select(*keys).schema
    for n, kind in (("tile_row", "integer"), ("tile_col", "integer"), ("slice_w", "integer"), ("slice_h", "integer"), ("nChannels", "integer"), ("data", "binary")):
        schema = schema.add(n, kind)
    step_x, step_y = stride(F.col("slice_w"), F.col("ov_x")), stride(F.col("slice_h"), F.col("ov_y"))
    rows, cols = _axis(F.col("height"), F.col("slice_h"), F.col("ov_y")), _axis(F.col("width"), F.col("slice_w"), F.col("ov_x"))
    tile = lambda r, c: F.struct(r.alias("tile_row"), c.alias("tile_col"), (c * step_x).alias("t_left"), (r * step_y).alias("t_top"))
    # Made in the image's own row: pixels are not shuffled to meet their tiles.
    tiles = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: tile(r, c))))
    whole = images.select(*keys, "slice_w", "slice_h", "height", "width", "nChannels", "data", tiles.alias("tiles"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
                out = []
                for t in row.tiles:
                    tile = np.zeros((row.slice_h, row.slice_w, row.nChannels), np.uint8)
                    part = pixels[t["t_top"] : t["t_top"] + row.slice_h, t["t_left"] : t["t_left"] + row.slice_w]
                    tile[: part.shape[0], : part.shape[1]] = part
                    out.append((*(getattr(row, k) for k in keys), t["tile_row"], t["tile_col"], row.slice_w, row.slice_h, row.nChannels, tile.tobytes()))
                yield pd.DataFrame(out, columns=names)

    return whole.mapInPandas(run, schema)
