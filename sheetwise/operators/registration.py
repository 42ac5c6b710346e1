"""Registering a sheet to its template by a projective map of points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import geometry as G
from sheetwise.operators.nearest import small
from sheetwise.runtime import cut, ship
from sheetwise.schema import BOX, KEYS

#: Corner landmarks of each side (fixed values), in the order in which they span the unit square.
CORNERS = {
    "intraoperative": ["anesthesia_start", "units", "lateral", "safety_checklist"],
    "preoperative_postoperative": ["patient_profile", "weight", "disposition", "signature"],
}
H = tuple(f"h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))


def corner_pairs(landmarks: DataFrame, template: DataFrame, names: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row per sheet with detected and template centres of each corner, ``x1, y1, u1, v1`` ..., and ``status``.

    ``status`` is ``ok`` if each name is there exactly once.
    """
    t = small(template.where(F.col("category").isin(names)).select("category", G.center_x().alias("u"), G.center_y().alias("v")))
    met = landmarks.where(F.col("category").isin(names)).select(*keys, "category", G.center_x().alias("x"), G.center_y().alias("y")).join(t, "category")
    cols = [F.max(F.when(F.col("category") == n, F.col(c))).alias(f"{c}{i}") for i, n in enumerate(names, 1) for c in "xyuv"]
    counted = met.groupBy(*keys).agg(*cols, F.count(F.lit(1)).alias("n"), F.count_distinct("category").alias("k"))
    return counted.withColumn("status", F.when((F.col("n") == len(names)) & (F.col("k") == len(names)), "ok").otherwise("corners missing or repeated")).drop("n", "k")


def _square_to_quad(x: str, y: str) -> list[Column]:
    """Row-major projective map of the unit square (0,0), (1,0), (1,1), (0,1) to four points."""
    c = F.col
    x1, x2, x3, x4 = (c(f"{x}{i}") for i in range(1, 5))
    y1, y2, y3, y4 = (c(f"{y}{i}") for i in range(1, 5))
    dx1, dx2, dx3 = x2 - x3, x4 - x3, x1 - x2 + x3 - x4
    dy1, dy2, dy3 = y2 - y3, y4 - y3, y1 - y2 + y3 - y4
    det = dx1 * dy2 - dx2 * dy1
    g = F.try_divide(dx3 * dy2 - dx2 * dy3, det)
    h = F.try_divide(dx1 * dy3 - dx3 * dy1, det)
    return [x2 - x1 + g * x2, x4 - x1 + h * x4, x1, y2 - y1 + g * y2, y4 - y1 + h * y4, y1, g, h, F.lit(1.0)]


def fit_homography(pairs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``h11`` to ``h33`` (h33 = 1) of the map from detected to template points, in closed form; sheets that are not ``ok`` or have collinear corners are left out.

    Both quadrilaterals are images of the unit square, so the map is the template's times the adjugate of the detected one's.
    """
    ok = pairs.where("status = 'ok'")
    names = [f"{s}{i}" for s in "ab" for i in range(9)]
    # A row per sheet; written, as Spark would otherwise copy these expressions into every use of theirs.
    maps = cut(pairs.sparkSession, ok.select(*keys, *[e.alias(n) for n, e in zip(names, _square_to_quad("x", "y") + _square_to_quad("u", "v"))]))
    a = [F.col(f"a{i}") for i in range(9)]
    b = [F.col(f"b{i}") for i in range(9)]
    adj = [
        a[4] * a[8] - a[5] * a[7], a[2] * a[7] - a[1] * a[8], a[1] * a[5] - a[2] * a[4],
        a[5] * a[6] - a[3] * a[8], a[0] * a[8] - a[2] * a[6], a[2] * a[3] - a[0] * a[5],
        a[3] * a[7] - a[4] * a[6], a[1] * a[6] - a[0] * a[7], a[0] * a[4] - a[1] * a[3],
    ]
    product = maps.select(*keys, *[sum((b[3 * i + k] * adj[3 * k + j] for k in range(1, 3)), b[3 * i] * adj[j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)])
    product = cut(pairs.sparkSession, product)
    h = product.select(*keys, *[F.try_divide(F.col(f"m{i}{j}"), F.col("m22")).alias(f"h{i + 1}{j + 1}") for i in range(3) for j in range(3)])
    return h.where("h11 is not null")


def fit_homography_many(pairs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``h11`` to ``h33`` (h33 = 1) from four or more rows ``x, y, u, v`` of each sheet, by least squares; sheets with fewer, or whose points do not fix a map, are left out.

    One Arrow call for a sheet, whose points are few. Coordinates are centred and scaled before the system is solved, which keeps it well conditioned.
    """
    ship(pairs.sparkSession)
    schema = pairs.select(*keys, *[F.lit(0.0).alias(n) for n in H]).schema

    def run(table: pa.Table) -> pa.Table:
        x, y, u, v = (table.column(c).to_numpy().astype(float) for c in ("x", "y", "u", "v"))
        h = least_squares_map(x, y, u, v)
        out = table.select(list(keys)).slice(0, 1 if h is not None else 0)
        for i, n in enumerate(H):
            out = out.append_column(n, pa.array([h[i]] if h is not None else [], pa.float64()))
        return out

    rows = pairs.select(*keys, *[F.col(c).cast("double") for c in ("x", "y", "u", "v")]).dropna()
    return rows.groupBy(*keys).applyInArrow(run, schema)


def least_squares_map(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    """Row-major 3 x 3 map from (x, y) to (u, v) with its last entry 1, or None if the points do not fix one."""
    if len(x) < 4:
        return None

    def normal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scale = np.sqrt(2) / max(1e-12, np.hypot(a - a.mean(), b - b.mean()).mean())
        return np.array([[scale, 0, -scale * a.mean()], [0, scale, -scale * b.mean()], [0, 0, 1]]), scale * (a - a.mean()), scale * (b - b.mean())

    (one, x, y), (two, u, v) = normal(x, y), normal(u, v)
    zero, unit = np.zeros(len(x)), np.ones(len(x))
    rows = np.concatenate((np.stack((x, y, unit, zero, zero, zero, -u * x, -u * y, -u), axis=1), np.stack((zero, zero, zero, x, y, unit, -v * x, -v * y, -v), axis=1)))
    _, size, axes = np.linalg.svd(rows)
    if size[7] < 1e-9 * size[0]:
        return None
    h = np.linalg.inv(two) @ axes[-1].reshape(3, 3) @ one
    return None if abs(h[2, 2]) < 1e-12 else (h / h[2, 2]).ravel()


def _mapped(x: Column, y: Column) -> tuple[Column, Column]:
    h = {n: F.col(n) for n in H}
    w = h["h31"] * x + h["h32"] * y + h["h33"]
    return F.try_divide(h["h11"] * x + h["h12"] * y + h["h13"], w), F.try_divide(h["h21"] * x + h["h22"] * y + h["h23"], w)


def transform_points(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Map points by the row's h11 ... h33."""
    u, v = _mapped(F.col(x), F.col(y))
    return df.withColumns({x: u, y: v})


def transform_boxes(df: DataFrame) -> DataFrame:
    """Map boxes by their corners; left looks at the two left corners only, and so on for each edge."""
    left, top, right, bottom = G.edges()
    (tlx, tly), (trx, try_), (brx, bry), (blx, bly) = (_mapped(x, y) for x, y in ((left, top), (right, top), (right, bottom), (left, bottom)))
    return df.withColumns({"left": F.least(tlx, blx), "top": F.least(tly, try_), "right": F.greatest(trx, brx), "bottom": F.greatest(bly, bry)})


def transform_keypoints(df: DataFrame) -> DataFrame:
    """Map boxes and keypoints; a keypoint may leave its box."""
    x, y = _mapped(F.col("kp_x"), F.col("kp_y"))
    out = transform_boxes(df.withColumns({"_x": x, "_y": y}))
    return out.withColumns({"kp_x": F.col("_x"), "kp_y": F.col("_y")}).drop("_x", "_y")


def register(det: DataFrame, landmarks: DataFrame, template: DataFrame, names: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Map every detection of every sheet to the template's frame; sheets that cannot be fitted are left out.

    Coordinates are rounded to a millionth of a pixel, so that the map's rounding errors decide no tie and no comparison of what lies on whole pixels.
    """
    fitted = fit_homography(corner_pairs(landmarks, template, names, keys), keys)
    joined = det.join(fitted, list(keys))
    mapped = transform_keypoints(joined) if "kp_x" in det.columns else transform_boxes(joined)
    return mapped.withColumns({c: G.stated(F.col(c)) for c in (*BOX, *(("kp_x", "kp_y") if "kp_x" in det.columns else ()))}).select(*det.columns)


def register_side(det: DataFrame, template: DataFrame, side: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """:func:`register` with the corners of a side, found among the detections of source ``landmarks``."""
    if side not in CORNERS:
        raise ValueError(f"side is one of {sorted(CORNERS)}")
    return register(det, det.where("source = 'landmarks'"), template, CORNERS[side], keys)
