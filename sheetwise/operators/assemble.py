"""Whole-sheet results from detections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions import geometry as G
from sheetwise.operators import decode, fields, legend, nearest, registration, suppression
from sheetwise.runtime import cut
from sheetwise.schema import KEYS

FACT = ("section", "key", "subkey", "value")
#: Frame in which a registered sheet is interpreted, in pixels (fixed values).
WIDTH, HEIGHT = 3300.0, 2550.0
#: Candidate numbers of legend clusters (fixed values).
TIME_KS, VALUE_KS = [40, 41, 42], [18, 19, 20]
FRONT_SOURCES = ("landmarks", "numbers", "checkboxes", "systolic", "diastolic", "heart_rate")
BACK_SOURCES = ("landmarks", "numbers", "checkboxes")


def merge_records(*facts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Union of facts in which, for each key, the last table that has it wins."""
    tagged = [f.select(*keys, *FACT, F.lit(i).alias("_priority")) for i, f in enumerate(facts)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return every.groupBy(*keys, "section", "key", "subkey").agg(F.max_by("value", "_priority").alias("value"))


def merge_sections(*facts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As :func:`merge_records`, for whole sections: a later table's section replaces an earlier one's."""
    every = facts[0].withColumn("_priority", F.lit(0))
    for i, f in enumerate(facts[1:], 1):
        every = every.unionByName(f.withColumn("_priority", F.lit(i)))
    top = F.max("_priority").over(Window.partitionBy(*keys, "section"))
    return every.withColumn("_top", top).where("_priority = _top").select(*keys, *FACT)


#: A method of clustering: boxes of one axis, candidate numbers of clusters and keys to the boxes with a column ``cluster``.
Clustering = Callable[[DataFrame, list[int], tuple[str, ...]], DataFrame]


def legend_clusters(landmarks: DataFrame, method: str | Clustering = "kmeans", eps: float = 20.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Clusters of both legends' digits with labels and positions. ``method`` is ``kmeans``, ``agglomerative``, ``dbscan`` (with ``eps``) or a :data:`Clustering` of one's own."""
    digits = cut(landmarks.sparkSession, legend.isolate_legend(landmarks, WIDTH, HEIGHT, keys))
    if method == "dbscan":  # both axes at once
        both = cut(landmarks.sparkSession, legend.cluster_dbscan(digits, eps, 1, (*keys, "axis")))
        parts = {u: both.where(F.col("axis") == u) for u in legend.UNITS}
    else:
        named = {"kmeans": legend.cluster_kmeans, "agglomerative": legend.cluster_agglomerative}
        if not callable(method) and method not in named:
            raise ValueError(f"method is dbscan, one of {sorted(named)} or a function")
        cluster = method if callable(method) else named[method]
        parts = {u: cluster(digits.where(F.col("axis") == u), ks, keys) for u, ks in (("mins", TIME_KS), ("mmhg", VALUE_KS))}
        for found in parts.values():
            if "cluster" not in found.columns:
                raise ValueError("a clustering method adds the column cluster")
    return _union([legend.cluster_boxes(df, u, keys) for u, df in parts.items()])


def interpret_front(det: DataFrame, centroids: DataFrame, template: DataFrame, method: str | Clustering = "kmeans", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Facts of the front of every sheet from its detections (``source`` says which model found a row)."""
    spark = det.sparkSession
    placed = cut(spark, registration.register_side(det, template, "intraoperative", keys))
    of = lambda *names: placed.where(F.col("source").isin(list(names)))
    width, height = F.lit(WIDTH), F.lit(HEIGHT)
    clusters = cut(spark, legend_clusters(of("landmarks"), method, keys=keys))
    places = legend.legend_locations(clusters, keys)
    digits = of("numbers").withColumn("form", F.lit("front"))
    boxes = of("checkboxes").withColumn("form", F.lit("front_checkboxes"))
    parts = [
        fields.digit_facts(nearest.nearest_per_target(digits, centroids, width, height, keys=keys), fields.field_table(spark), keys),
        fields.inhaled_volatile(of("numbers"), places, of("landmarks"), keys),
        fields.heart_rate_and_blood_pressure(of("systolic", "diastolic", "heart_rate").withColumn("category", F.col("source")), clusters, keys),
        fields.physiological_indicators(of("numbers"), places, of("landmarks"), WIDTH, HEIGHT, keys),
        fields.checkboxes(boxes, centroids, width, height, "intraoperative", keys=keys),
    ]
    # Each part is written by itself: one plan over all of them is slow to run.
    return _union([cut(spark, p) for p in parts])


def interpret_back(det: DataFrame, centroids: DataFrame, template: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Facts of the back of every sheet."""
    spark = det.sparkSession
    placed = cut(spark, registration.register_side(det, template, "preoperative_postoperative", keys))
    width, height = F.lit(WIDTH), F.lit(HEIGHT)
    digits = placed.where("source = 'numbers'").withColumn("form", F.lit("back"))
    boxes = placed.where("source = 'checkboxes'").withColumn("form", F.lit("back_checkboxes"))
    return _union([
        fields.digit_facts(nearest.nearest_per_target(digits, centroids, width, height, keys=keys), fields.field_table(spark), keys),
        fields.checkboxes(boxes, centroids, width, height, "preoperative", keys=keys),
    ])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def record_json(facts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One JSON object per sheet: section -> key (-> subkey) -> value, in the order of names."""

    def member(name: str, value):  # "name":value
        quoted = F.expr(f"substring(to_json(named_struct('k', {name})), 6, length(to_json(named_struct('k', {name}))) - 6)")
        return F.concat(quoted, F.lit(":"), value)

    def joined(col):
        return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_n"), col.alias("m")))), lambda x: x["m"]), ","), F.lit("}"))

    text = F.expr("substring(to_json(named_struct('k', value)), 6, length(to_json(named_struct('k', value))) - 6)")
    level = facts.withColumns({"_n": F.col("subkey"), "_m": F.when(F.col("subkey") == "", text).otherwise(member("subkey", text))})
    inner = level.groupBy(*keys, "section", "key").agg(F.when(F.max("subkey") == "", F.max("_m")).otherwise(joined(F.col("_m"))).alias("_v"))
    inner = inner.withColumns({"_n": F.col("key"), "_m": member("key", F.col("_v"))}).groupBy(*keys, "section").agg(joined(F.col("_m")).alias("_v"))
    return inner.withColumns({"_n": F.col("section"), "_m": member("section", F.col("_v"))}).groupBy(*keys).agg(joined(F.col("_m")).alias("record"))


def interpret_sheets(front: DataFrame, back: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One JSON record per sheet, from facts of both sides, nested under ``intraoperative`` and ``preoperative_postoperative``."""
    a = record_json(front, keys).withColumnRenamed("record", "f")
    b = record_json(back, keys).withColumnRenamed("record", "b")
    both = a.join(b, list(keys), "full")
    part = lambda name, c: F.concat(F.lit(f'"{name}":'), F.coalesce(F.col(c), F.lit("{}")))
    return both.select(*keys, F.concat(F.lit("{"), part("intraoperative", "f"), F.lit(","), part("preoperative_postoperative", "b"), F.lit("}")).alias("record"))


#: Models with keypoints, and the overlap at which a model's detections are duplicates, if it is not 0.5 (fixed values).
KEYPOINT_SOURCES = ("systolic", "diastolic", "heart_rate")
DUPLICATE = {"checkboxes": 0.8}


def score_side(images: DataFrame, models: dict[str, tuple[Callable, bool]], keys: tuple[str, ...] = KEYS, config: DataFrame | None = None) -> DataFrame:
    """Detections of several models on the same images: source -> (model factory, has keypoints).

    ``config`` (as of :func:`formats.parse_model_config`) gives each source's tile side and overlaps; else the images have theirs.
    """
    rows = {r.source: r for r in config.where(F.col("source").isin(list(models))).collect()} if config is not None else {}
    if config is not None and set(rows) != set(models):
        raise ValueError(f"no configuration of {sorted(set(models) - set(rows))}")
    # Models with the same tiles share them.
    settings: dict[tuple | None, dict] = {}
    for source, model in models.items():
        r = rows.get(source)
        settings.setdefault(r and (r.tile_size_proportion, r.horz_overlap_proportion, r.vert_overlap_proportion), {})[source] = model
    parts = []
    for own, some in settings.items():
        tiled = images
        if own is not None:
            side = G.tile_size(F.col("width"), F.col("height"), F.lit(own[0]))
            tiled = images.withColumns({"slice_w": side, "slice_h": side, "ov_x": F.lit(own[1]), "ov_y": F.lit(own[2])})
        parts.append(decode.placed_by_sources(tiled, some, keys).drop("tile_row", "tile_col", "pos"))
    # All sources with the same threshold at once; written, as suppression reads its input again.
    placed = cut(images.sparkSession, _union(parts))
    kept = []
    for least in sorted({DUPLICATE.get(s, 0.5) for s in models}):
        some = placed.where(F.col("source").isin([s for s in models if DUPLICATE.get(s, 0.5) == least]))
        kept.append(suppression.suppress(some, least, "iom", suppression.area_times_confidence(), (*keys, "source")))
    return _union(kept).withColumn("det_id", F.xxhash64("source", *keys, "ord"))


def _model_set(factories: dict[str, Callable], sources: tuple[str, ...]) -> dict[str, tuple[Callable, bool]]:
    missing = [s for s in sources if s not in factories]
    if missing:
        raise ValueError(f"no model for {missing}")
    return {s: (factories[s], s in KEYPOINT_SOURCES) for s in sources}


def score_front(images: DataFrame, factories: dict[str, Callable], config: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Detections of the six models of the front."""
    return score_side(images, _model_set(factories, FRONT_SOURCES), keys, config)


def score_back(images: DataFrame, factories: dict[str, Callable], config: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Detections of the three models of the back."""
    return score_side(images, _model_set(factories, BACK_SOURCES), keys, config)


def score_sheets(front_images: DataFrame, back_images: DataFrame, front: dict[str, Callable], back: dict[str, Callable], config: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Detections of both sides, with ``side``."""
    sides = zip(("intraoperative", "preoperative_postoperative"), (score_front(front_images, front, config, keys), score_back(back_images, back, config, keys)))
    return _union([df.withColumn("side", F.lit(side)) for side, df in sides])


def digitize_sheets(
    front_images: DataFrame, back_images: DataFrame, front_models: dict[str, Callable], back_models: dict[str, Callable], centroids: DataFrame, template: DataFrame,
    nested: bool = True, config: DataFrame | None = None, method: str | Clustering = "kmeans", keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Images of both sides to records, with a model factory for each source. Not nested, a section that both sides have is the back's."""
    spark = front_images.sparkSession
    front = interpret_front(cut(spark, score_front(front_images, front_models, config, keys)), centroids, template, method, keys)
    back = interpret_back(cut(spark, score_back(back_images, back_models, config, keys)), centroids, template, keys)
    return interpret_sheets(front, back, keys) if nested else record_json(merge_sections(front, back, keys=keys), keys)
