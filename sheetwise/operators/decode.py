"""Raw model output to detections, and scoring of tiles with a user's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions import geometry as G
from sheetwise.operators import session, suppression, tiling
from sheetwise.operators.nearest import small
from sheetwise.runtime import ship
from sheetwise.schema import BOX, KEYS


def decode_boxes(anchors: DataFrame, classes: DataFrame, confidence: float = 0.5) -> DataFrame:
    """Anchors ``cx, cy, w, h, scores`` to boxes: the first class with the highest score, if that reaches ``confidence``.

    ``classes`` has ``class_id, category``. The other columns of ``anchors`` stay.
    """
    kept = anchors.withColumn("confidence", F.array_max("scores").cast("double")).where(F.col("confidence") >= confidence)
    class_id = (F.array_position("scores", F.array_max("scores")) - 1).cast("int")
    boxes = kept.withColumn("class_id", class_id).withColumns(_edges())
    return boxes.join(small(classes.select("class_id", "category")), "class_id").drop("scores", "cx", "cy", "w", "h")


def _edges() -> dict:
    cx, cy, w, h = (F.col(c).cast("double") for c in ("cx", "cy", "w", "h"))
    return {"left": cx - w / 2, "top": cy - h / 2, "right": cx + w / 2, "bottom": cy + h / 2}


def decode_keypoints(anchors: DataFrame, classes: DataFrame, confidence: float = 0.5) -> DataFrame:
    """Anchors ``cx, cy, w, h, score, kp_x, kp_y`` to keypoint detections of class 0, with the keypoint strictly inside its box."""
    kept = anchors.withColumn("confidence", F.col("score").cast("double")).where(F.col("confidence") >= confidence).withColumn("class_id", F.lit(0))
    out = kept.withColumns(_edges()).withColumns({c: F.col(c).cast("double") for c in ("kp_x", "kp_y")}).where(G.keypoint_inside())
    return out.join(small(classes.select("class_id", "category")), "class_id").drop("score", "cx", "cy", "w", "h")


def anchors_from_matrix(raw: DataFrame, rows: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A model's ``(4 + n) x N`` matrix in column ``output`` to one row per anchor, with its ``pos`` and values."""
    cols = F.arrays_zip(*[F.col("output")[i].alias(f"r{i}") for i in range(rows)])
    return raw.select(*keys, F.posexplode(cols).alias("pos", "a")).select(*keys, "pos", *[F.col(f"a.r{i}").alias(f"r{i}") for i in range(rows)])


def prediction_rows_to_detections(boxes: DataFrame, classes: DataFrame, keypoints: DataFrame | None = None, flavour: str = "box", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Rows ``pos, left, top, right, bottom, confidence, class_id`` (and keypoints by position) to detections.

    Flavour ``pose`` drops rows whose keypoint is outside the box; ``box`` leaves keypoints out for a whole image if any is.
    Each row of ``boxes`` gives one at most: of several keypoints at a position the first by x, then y, counts, and repeated boxes stay repeated.
    """
    named = boxes.join(small(classes.select("class_id", "category")), "class_id")
    if keypoints is None:
        return named.withColumns({"kp_x": F.lit(None).cast("double"), "kp_y": F.lit(None).cast("double")})
    point = keypoints.groupBy(*keys, "pos").agg(F.min(F.struct("kp_x", "kp_y")).alias("_p")).select(*keys, "pos", "_p.kp_x", "_p.kp_y")
    both = named.join(point, [*keys, "pos"], "left")
    if flavour == "pose":
        return both.where(G.keypoint_within())
    if flavour != "box":
        raise ValueError("flavour is box or pose")
    valid = F.coalesce(F.min(F.coalesce(G.keypoint_within(), F.lit(False))).over(Window.partitionBy(*keys)), F.lit(False))
    return both.withColumn("_valid", valid).withColumns({c: F.when(F.col("_valid"), F.col(c)) for c in ("kp_x", "kp_y")}).drop("_valid")


def score_tiles(tiles: DataFrame, model_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], carry: tuple[str, ...], has_keypoints: bool = False, batch: int = session.BATCH) -> DataFrame:
    """Run a model over every tile.

    ``model_factory`` is called once in each Python worker, which keeps the model for all its tasks, and gives a function from a frame of up to ``batch`` tiles to a frame of detections: the tile's ``carry``
    columns, ``pos``, ``category``, box edges, ``confidence``, and keypoints if there are any.
    """
    if batch < 1:
        raise ValueError("batch must be over 0")
    ship(tiles.sparkSession)
    schema = tiles.select(*carry).schema.add("pos", "integer").add("category", "string")
    for c in (*BOX, "confidence", *(("kp_x", "kp_y") if has_keypoints else ())):
        schema = schema.add(c, "double")
    names, key = schema.names, session.session_key(model_factory)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in session.in_batches(frames, batch):
            yield session.model(key, model_factory)(pdf)[names]

    return tiles.mapInPandas(run, schema)


def score_sources(tiles: DataFrame, models: dict[str, tuple[Callable, bool]], carry: tuple[str, ...], batch: int = session.BATCH) -> DataFrame:
    """As :func:`score_tiles`, for several models (source -> factory, has keypoints) on the same tiles, which are made and sent once; adds ``source``."""
    ship(tiles.sparkSession)
    schema = tiles.select(*carry).schema.add("source", "string").add("pos", "integer").add("category", "string")
    for c in (*BOX, "confidence", "kp_x", "kp_y"):
        schema = schema.add(c, "double")
    named = [(s, session.session_key(f), f, points) for s, (f, points) in models.items()]
    names = schema.names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in session.in_batches(frames, batch):
            for source, key, factory, points in named:
                found = session.model(key, factory)(pdf).assign(source=source)
                yield (found if points else found.assign(kp_x=float("nan"), kp_y=float("nan")))[names]

    with_points = [s for s, (_, points) in models.items() if points]
    return tiles.mapInPandas(run, schema).withColumns({c: F.when(F.col("source").isin(with_points), F.col(c)) for c in ("kp_x", "kp_y")})


def placed_by_sources(images: DataFrame, models: dict[str, tuple[Callable, bool]], keys: tuple[str, ...] = KEYS, confidence: float = 0.5) -> DataFrame:
    """:func:`placed_detections` of several models, with ``source``. A worker keeps ``session.KEPT`` models, so more of them go over the tiles in turns."""
    checked = tiling.validate_tile_params(images, "fail")
    params, tiles, sources = checked.select(*keys, *tiling.TILE), tiling.tile_images(checked, keys), list(models)
    out = None
    for i in range(0, len(sources), session.KEPT):
        found = score_sources(tiles, {s: models[s] for s in sources[i : i + session.KEPT]}, (*keys, "tile_row", "tile_col"))
        placed = tiling.untile(found.where(F.col("confidence") >= confidence).join(params, list(keys)), (*keys, "source")).drop(*tiling.TILE)
        out = placed if out is None else out.unionByName(placed)
    return out


def placed_detections(images: DataFrame, model_factory: Callable, keys: tuple[str, ...] = KEYS, confidence: float = 0.5, has_keypoints: bool = False) -> DataFrame:
    """Tile images, score tiles and put detections back into the image; tiles overlap, so duplicates are still there."""
    checked = tiling.validate_tile_params(images, "fail")
    params = checked.select(*keys, *tiling.TILE)
    found = score_tiles(tiling.tile_images(checked, keys), model_factory, (*keys, "tile_row", "tile_col"), has_keypoints)
    return tiling.untile(found.where(F.col("confidence") >= confidence).join(params, list(keys)), keys).drop(*tiling.TILE)


def detect_with_tiling(images: DataFrame, model_factory: Callable, keys: tuple[str, ...] = KEYS, confidence: float = 0.5, nms_threshold: float = 0.5, has_keypoints: bool = False) -> DataFrame:
    """:func:`placed_detections` without duplicates."""
    placed = placed_detections(images, model_factory, keys, confidence, has_keypoints)
    return suppression.suppress(placed, nms_threshold, "iom", suppression.area_times_confidence(), keys)
