"""Printed axis legends: isolating their digits, clustering them, labelling clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions import geometry as G
from sheetwise.operators import clusters_large, groups
from sheetwise.runtime import cut_to, ship
from sheetwise.schema import KEYS

DIGITS = [str(i) for i in range(10)]
UNITS = ("mins", "mmhg")
#: By how much the best silhouette must beat that of the largest k.
BETTER = {"kmeans": 0.005, "agglomerative": 0.003}
GRID, STEP = 10_000, 40
#: Points of a group that are clustered in one Arrow call.
IN_ONE_TASK = 2000


def dealt(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``df`` by key in as many partitions as a shuffle has: little data, but much work for each group."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# Clustering ------------------------------------------------------------------------------------------------------------------

def cluster_dbscan(points: DataFrame, eps: float, min_samples: int = 1, keys: tuple[str, ...] = KEYS, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """Adds ``cluster``: the smallest ``det_id`` of a density cluster's core points, or -1 for noise.

    Neighbours are at most ``eps`` apart, the point itself included. Groups of up to ``in_one_task`` points are clustered many at a time; the few larger ones
    over all tasks, by cells. The clusters are the same either way. A border point goes to its smallest neighbouring core's cluster.
    """
    if eps <= 0 or min_samples <= 0:
        raise ValueError("eps and min_samples must be over 0")
    spark = points.sparkSession
    counts, total, most = groups.sizes(points, keys)
    if most <= in_one_task:
        return _dbscan_groups(points, eps, min_samples, keys, total)
    large = cut_to(spark, counts.where(F.col("_n") > in_one_task).drop("_n"))[0]
    found = _dbscan_groups(points.join(large, list(keys), "left_anti"), eps, min_samples, keys, total)
    rest = points.join(large, list(keys), "left_semi")
    at = rest.select(*keys, "det_id", G.center_x().alias("x"), G.center_y().alias("y"))
    named = rest.join(clusters_large.dbscan_by_cells(at, eps, min_samples, keys), [*keys, "det_id"], "left")
    return found.unionByName(named.withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long"))))


def _dbscan(ids: np.ndarray, x: np.ndarray, y: np.ndarray, bounds: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Cluster of each point; ``bounds`` are those of groups, within which points are sorted by id."""
    # In the order of x, a point meets those after it until one is farther than eps in x alone.
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((x, group))
    gx, gy, end = x[order], y[order], bounds[1:][group]
    at, step = np.arange(len(x)), 0
    ones, others = [at[~np.isnan(x + y)]], [at[~np.isnan(x + y)]]
    while len(at):
        step += 1
        at = at[at + step < end[at]]
        at = at[gx[at + step] - gx[at] <= eps * (1 + 1e-9)]
        near = at[np.sqrt((gx[at] - gx[at + step]) ** 2 + (gy[at] - gy[at + step]) ** 2) <= eps]
        ones += [order[near], order[near + step]]
        others += [order[near + step], order[near]]
    one, other = np.concatenate(ones), np.concatenate(others)
    core = np.bincount(one, minlength=len(x)) >= min_samples
    # Points go by their place, which orders them as their ids do; links are those between cores.
    label, linked = np.arange(len(x)), core[one] & core[other]
    a, b = one[linked], other[linked]
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    # The smallest neighbouring core decides, by its own id.
    first = np.full(len(x), len(x))
    reach = core[other] & ~core[one]
    np.minimum.at(first, one[reach], other[reach])
    border = first < len(x)
    label[border] = label[first[border]]
    return np.where(core | border, ids[label], -1)


def _dbscan_groups(points: DataFrame, eps: float, min_samples: int, keys: tuple[str, ...], total: int) -> DataFrame:
    ship(points.sparkSession)
    rest = [c for c in points.columns if c not in (*keys, "det_id")]
    rows = points.select(*keys, "det_id", *rest, G.center_x().alias("_x"), G.center_y().alias("_y"))
    schema = points.select(*keys, "det_id", *rest, F.lit(0).cast("long").alias("cluster")).schema
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in groups.whole(batches, n):
            ids, x, y = (t.column(c).to_numpy() for c in ("det_id", "_x", "_y"))
            yield from t.drop_columns(["_x", "_y"]).append_column("cluster", pa.array(_dbscan(ids, x, y, bounds, eps, min_samples), pa.int64())).to_batches()

    return groups.dealt(rows, keys, total, "det_id").mapInArrow(run, schema)


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator, weights: np.ndarray | None = None) -> np.ndarray:
    """k-means++ centres of points with weights: each next one by its squared distance to those so far, the best of some draws."""
    w = np.ones(len(x)) if weights is None else weights
    draw = lambda p, n: np.searchsorted(np.cumsum(p), rng.random(n) * p.sum()).clip(max=len(x) - 1)
    chosen = [int(rng.integers(len(x))) if weights is None else int(draw(w, 1)[0])]
    least = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    draws = 2 + int(np.log(k))
    while len(chosen) < k:
        if (least * w).sum() <= 0:
            chosen.append(int(rng.integers(len(x))))
            continue
        tried = draw(least * w, draws)
        after = np.minimum(least, ((x[tried, None] - x[None]) ** 2).sum(axis=2))
        best = int((after * w).sum(axis=1).argmin())
        chosen.append(int(tried[best]))
        least = after[best]
    return x[chosen].astype(float)


#: Lloyd's rounds at most, and the tolerance at which they end (fixed values).
ROUNDS, TOLERANCE = 500, 1e-8


def _lloyd(x: np.ndarray, centres: np.ndarray, w: np.ndarray | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[float, np.ndarray, np.ndarray]:
    """(inertia, labels, centres) of Lloyd's iterations, until the centres move by less than ``tolerance`` of the points' variance."""
    w = np.ones(len(x)) if w is None else w
    stop = tolerance * x.var(axis=0).mean()
    square = lambda c: ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        labels = square(centres).argmin(axis=1)
        n = np.bincount(labels, w, len(centres))
        sums = np.stack([np.bincount(labels, x[:, d] * w, len(centres)) for d in range(x.shape[1])], axis=1)
        new = np.where(n[:, None] > 0, sums / np.where(n > 0, n, 1)[:, None], centres)
        moved = ((new - centres) ** 2).sum()
        centres = new
        if moved <= stop:
            break
    dist = square(centres)
    return float((dist.min(axis=1) * w).sum()), dist.argmin(axis=1), centres


def _best_start(x: np.ndarray, k: int, w: np.ndarray | None = None, starts: int = 20, seed: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return min((_lloyd(x, _plus_plus(x, k, rng, w), w) for _ in range(starts)), key=lambda r: r[0])


def _kmeans(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Labels of the start with the least inertia."""
    return _best_start(x, k)[1]


def _seed_centres(x: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """k centres of weighted candidates."""
    return _best_start(x, k, w)[2]


#: Points of a group of which many are clustered at once; distances between all points of a group are held.
IN_ARRAYS = 256


def _starts_of_many(x: np.ndarray, k: int, starts: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(centres, of which groups they are sound) of k-means++ for groups ``(g, n, 2)``, all starts at once; the numbers drawn are those of :func:`_plus_plus`, one start after the other.

    A group that has fewer different points than k draws more numbers; it is not sound here.
    """
    g, n, _ = x.shape
    rng, draws = np.random.default_rng(seed), 2 + int(np.log(k))
    firsts, numbers = [], []
    for _ in range(starts):
        firsts.append(int(rng.integers(n)))
        numbers.append(rng.random((k - 1, draws)))
    square = ((x[:, :, None] - x[:, None]) ** 2).sum(axis=3)
    of, sound = np.arange(g)[:, None], np.ones(g, bool)
    chosen = np.empty((g, starts, k), np.int64)
    chosen[:, :, 0] = firsts
    least = square[of, chosen[:, :, 0]]
    for i in range(1, k):
        total = least.sum(axis=2)
        sound &= (total > 0).all(axis=1)
        want = np.stack([u[i - 1] for u in numbers])[None] * total[:, :, None]
        tried = (least.cumsum(axis=2)[:, :, None] < want[..., None]).sum(axis=3).clip(max=n - 1)
        after = np.minimum(least[:, :, None], square[of[..., None], tried])
        best = after.sum(axis=3).argmin(axis=2)[..., None]
        chosen[:, :, i] = np.take_along_axis(tried, best, 2)[..., 0]
        least = np.take_along_axis(after, best[..., None], 2)[:, :, 0]
    return x[of[..., None], chosen], sound


def _kmeans_of_many(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """:func:`_kmeans` of groups ``(g, n, 2)`` of one size."""
    g, n, _ = x.shape
    if n > IN_ARRAYS:
        return np.stack([_kmeans(i, one, k) for i, one in zip(ids, x)])
    centres, sound = _starts_of_many(x, k)
    starts = centres.shape[1]
    centres = centres.reshape(-1, k, 2)
    own = np.repeat(np.arange(g), starts)
    stop = TOLERANCE * x.var(axis=1).mean(axis=1)[own]
    square = lambda rows: (x[own[rows], :, None, 0] - centres[rows, None, :, 0]) ** 2 + (x[own[rows], :, None, 1] - centres[rows, None, :, 1]) ** 2
    rows = np.arange(len(own))
    for _ in range(ROUNDS):
        place = (square(rows).argmin(axis=2) + np.arange(len(rows))[:, None] * k).ravel()
        count = np.bincount(place, minlength=len(rows) * k).reshape(-1, k, 1)
        sums = np.stack([np.bincount(place, x[own[rows], :, d].ravel(), len(rows) * k) for d in range(2)], axis=1).reshape(-1, k, 2)
        new = np.where(count > 0, sums / np.maximum(count, 1), centres[rows])
        moved = ((new - centres[rows]) ** 2).sum(axis=(1, 2))
        centres[rows] = new
        rows = rows[moved > stop[rows]]
        if not len(rows):
            break
    inertia, labels = np.empty(len(own)), np.empty((len(own), n), np.int64)
    for i in range(0, len(own), starts):
        dist = square(np.arange(i, i + starts))
        inertia[i : i + starts], labels[i : i + starts] = dist.min(axis=2).sum(axis=1), dist.argmin(axis=2)
    out = labels.reshape(g, starts, n)[np.arange(g), inertia.reshape(g, starts).argmin(axis=1)]
    for i in np.flatnonzero(~sound).tolist():
        out[i] = _kmeans(ids[i], x[i], k)
    return out


def _linkage_of_many(x: np.ndarray, ks: list[int]) -> list[np.ndarray]:
    """For each k the labels of groups ``(g, n, 2)`` after cutting the k - 1 longest edges of the minimum spanning tree; equally long ones by the places of their ends. A cluster's label is its place by its first point."""
    out = [np.empty(x.shape[:2], np.int64) for _ in ks]
    n = x.shape[1]
    for g, edges in enumerate(clusters_large.spanning_trees(x[..., 0], x[..., 1])):
        for labels, k in zip(out, ks):
            root = list(range(n))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]  # noqa: B023
                    i = root[i]  # noqa: B023
                return i

            for _, a, b in edges[: n - k]:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
            labels[g] = np.unique([find(i) for i in range(n)], return_inverse=True)[1]
    return out


def _labels_of_many(ids: np.ndarray, x: np.ndarray, ks: list[int], name: str) -> list[np.ndarray]:
    """For each k the labels of groups ``(g, n, 2)`` whose points are sorted by id."""
    return _linkage_of_many(x, ks) if name == "agglomerative" else [_kmeans_of_many(ids, x, k) for k in ks]


def _choice(scores: np.ndarray, margin: float) -> np.ndarray:
    """:func:`select_k` over rows of silhouettes by rising k: the place of the k."""
    best = scores.argmax(axis=1)
    wins = scores[np.arange(len(scores)), best] - scores[:, -1] >= margin
    return np.where(wins, best, scores.shape[1] - 1)


#: Points of a group that one task clusters.
IN_ONE_CALL = {"kmeans": 20_000, "agglomerative": 4000}


def _partition(points: DataFrame, ks: list[int], keys: tuple[str, ...], name: str, few: str = "drop", in_one_task: int | None = None) -> DataFrame:
    """``(keys, k, det_id, x, y, label)`` for every candidate k; a sheet with fewer points than k has none for it.

    With ``few`` = ``fail``, a sheet with fewer points than any of ``ks`` is an error. Groups of more than ``in_one_task`` points are clustered over all tasks.
    """
    if not ks:
        raise ValueError("at least one k is needed")
    if few not in ("drop", "fail"):
        raise ValueError("few is drop or fail")
    spark = points.sparkSession
    at = points.select(*keys, F.col("det_id").cast("long").alias("det_id"), G.center_x().alias("x"), G.center_y().alias("y"))
    within, large, total = _in_one_task(at, keys, name, in_one_task)
    schema = at.withColumns({"k": F.lit(0), "label": F.lit(0)}).schema
    columns = schema.names

    def rows(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.Table]:
        for place, k, label in _labels(t, bounds, ks, name, few):
            some = t.take(pa.array(place))
            yield some.append_column("k", pa.array(np.full(len(place), k, np.int32))).append_column("label", pa.array(label, pa.int32()))

    found = _grouped(within.select(*keys, "det_id", "x", "y"), keys, total, rows, schema)
    return found if large is None else found.unionByName(_over_tasks(large, ks, keys, name, columns))


def _in_one_task(at: DataFrame, keys: tuple[str, ...], name: str, in_one_task: int | None) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of groups that one task clusters, those of larger groups if there are any, and the number of all rows."""
    most = IN_ONE_CALL[name] if in_one_task is None else in_one_task
    counts, total, largest = groups.sizes(at, keys)
    if largest <= most:
        return at, None, total
    large = cut_to(at.sparkSession, counts.where(F.col("_n") > most).drop("_n"))[0]
    return at.join(large, list(keys), "left_anti"), at.join(large, list(keys), "left_semi"), total


def _over_tasks(large: DataFrame, ks: list[int], keys: tuple[str, ...], name: str, columns: list[str]) -> DataFrame:
    if name == "agglomerative":
        return clusters_large.linkage_over_tasks(large, ks, keys).select(columns)
    parts = [clusters_large.kmeans_over_tasks(large, k, keys, _seed_centres, ROUNDS, TOLERANCE).select(columns) for k in ks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _grouped(rows: DataFrame, keys: tuple[str, ...], total: int, f: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema) -> DataFrame:
    """``f`` over tables of whole groups, sorted by ``det_id`` within each."""
    ship(rows.sparkSession)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in groups.whole(batches, n):
            for out in f(t, bounds):
                yield from out.to_batches()

    return groups.dealt(rows, keys, total, "det_id").mapInArrow(run, schema)


def _blocks(t: pa.Table, bounds: np.ndarray, fewest: int, few: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of one size: (their rows, the ids and centres of different ones, which of these each group is). Groups with the same points, as on sheets with the same print, are clustered once."""
    ids, x, y = (t.column(c).to_numpy() for c in ("det_id", "x", "y"))
    for rows in groups.by_size(bounds, lambda n: 1):
        if rows.shape[1] < fewest and few == "fail":
            raise ValueError(f"{rows.shape[1]} points are too few for {fewest} clusters")
        points = np.concatenate([x[rows], y[rows]], axis=1)
        _, first, which = np.unique(points.view(np.uint64), axis=0, return_index=True, return_inverse=True)
        yield rows, ids[rows[first]], np.stack([x[rows[first]], y[rows[first]]], axis=2), which.ravel()


def _few_groups(n: int) -> int:
    """Groups of ``n`` points that are clustered at once: eight, of which k-means holds all starts, or fewer large ones."""
    return max(1, min(8, groups.AT_ONCE // n**2))


def _labels(t: pa.Table, bounds: np.ndarray, ks: list[int], name: str, few: str) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, k, their labels) for every k that groups have the points for."""
    for rows, ids, x, which in _blocks(t, bounds, max(ks), few):
        able = [k for k in ks if k <= rows.shape[1]]
        step = _few_groups(rows.shape[1])
        parts = [_labels_of_many(ids[i : i + step], x[i : i + step], able, name) for i in range(0, len(x), step)]
        for i, k in enumerate(able):
            yield rows.ravel(), k, np.concatenate([p[i] for p in parts])[which].ravel()


def silhouette(labelled: DataFrame, keys: tuple[str, ...] = (*KEYS, "k")) -> DataFrame:
    """Mean silhouette (Euclidean) of each group of ``keys``: columns ``x, y, label, det_id``. A cluster of one counts 0."""
    return clusters_large.silhouettes(labelled, keys).groupBy(*keys).agg(F.avg("s").alias("silhouette"))


def select_k(scores: DataFrame, margin: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The k with the best silhouette, if it beats that of the largest k by ``margin``; else the largest."""
    best = scores.groupBy(*keys).agg(F.max_by(F.struct("k", "silhouette"), F.struct(F.col("silhouette"), -F.col("k"))).alias("best"), F.max_by(F.struct("k", "silhouette"), "k").alias("last"))
    wins = F.col("best.silhouette") - F.col("last.silhouette") >= margin
    return best.select(*keys, F.when(wins, F.col("best.k")).otherwise(F.col("last.k")).alias("k"))


def _by_silhouette(points: DataFrame, ks: list[int], name: str, keys: tuple[str, ...], few: str, in_one_task: int | None) -> DataFrame:
    if not ks:
        raise ValueError("at least one k is needed")
    if few not in ("drop", "fail"):
        raise ValueError("few is drop or fail")
    spark, ks = points.sparkSession, sorted(set(ks))
    rest = [c for c in points.columns if c not in (*keys, "det_id")]
    points = points.select(*keys, "det_id", *rest)
    within, large, total = _in_one_task(points, keys, name, in_one_task)
    schema = points.withColumn("cluster", F.lit(0).cast("long")).schema

    def rows(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.Table]:
        at = t.select(["det_id"]).append_column("x", t.column("_x")).append_column("y", t.column("_y"))
        for place, ids, x, which in _blocks(at, bounds, max(ks), few):
            able = [k for k in ks if k <= place.shape[1]]
            if not able:
                continue
            chosen, step = [], _few_groups(place.shape[1])
            for i in range(0, len(x), step):
                labels, xy = _labels_of_many(ids[i : i + step], x[i : i + step], able, name), x[i : i + step]
                if len(able) == 1:  # needs no comparison
                    chosen.append(labels[0])
                    continue
                scores = np.stack([clusters_large.silhouettes_of_many(xy, label).mean(axis=1) for label in labels], axis=1)
                chosen.append(np.stack(labels)[_choice(scores, BETTER[name]), np.arange(len(xy))])
            label = np.concatenate(chosen)[which].ravel()
            yield t.drop_columns(["_x", "_y"]).take(pa.array(place.ravel())).append_column("cluster", pa.array(label, pa.int64()))

    found = _grouped(within.withColumns({"_x": G.center_x(), "_y": G.center_y()}), keys, total, rows, schema)
    if large is None:
        return found
    at = large.select(*keys, F.col("det_id").cast("long").alias("det_id"), G.center_x().alias("x"), G.center_y().alias("y"))
    every = cut_to(spark, _over_tasks(at, ks, keys, name, [*keys, "k", "det_id", "x", "y", "label"]))[0]
    if few == "fail" and not large.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < max(ks)).isEmpty():
        raise ValueError(f"a group has too few points for {max(ks)} clusters")
    chosen = every if len(ks) == 1 else every.join(select_k(silhouette(every, (*keys, "k")), BETTER[name], keys), [*keys, "k"])
    return found.unionByName(large.join(chosen.select(*keys, "det_id", F.col("label").cast("long").alias("cluster")), [*keys, "det_id"]))


def cluster_kmeans(points: DataFrame, ks: list[int], keys: tuple[str, ...] = KEYS, few: str = "drop", in_one_task: int | None = None) -> DataFrame:
    """Adds ``cluster`` by k-means on box centres (20 starts of k-means++, the least inertia counts), k chosen by silhouette. Labels are the same in every run.

    A sheet with fewer points than ``ks`` has no rows, or is an error if ``few`` is ``fail``. Groups of more than ``in_one_task`` points start from oversampled seeding, and all tasks share their rounds.
    """
    return _by_silhouette(points, ks, "kmeans", keys, few, in_one_task)


def cluster_agglomerative(points: DataFrame, ks: list[int], keys: tuple[str, ...] = KEYS, few: str = "drop", in_one_task: int | None = None) -> DataFrame:
    """Adds ``cluster`` by single linkage on box centres, k chosen by silhouette; ``few`` and ``in_one_task`` as for :func:`cluster_kmeans`. Large groups have the labels that one task would give."""
    return _by_silhouette(points, ks, "agglomerative", keys, few, in_one_task)


# Labels and positions --------------------------------------------------------------------------------------------------------

def concat_by(order: str, keys: tuple[str, ...], df: DataFrame, out: str = "digits") -> DataFrame:
    """Categories of each group, in the order of a column (then ``det_id``), as one string, with their number ``n``."""
    parts = F.array_sort(F.collect_list(F.struct(order, "det_id", "category")))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["category"]), "").alias(out), F.count(F.lit(1)).alias("n"))


def cluster_boxes(clustered: DataFrame, unit: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per cluster: envelope, mean centre, label ``<digits>_<unit>`` and ``value``; minutes get repeats repaired."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    by = (*keys, "cluster")
    parts = F.array_sort(F.collect_list(F.struct("left", "det_id", "category")))
    rows = clustered.groupBy(*by).agg(
        F.concat(F.array_join(F.transform(parts, lambda x: x["category"]), ""), F.lit(f"_{unit}")).alias("label"),
        *[f(c).alias(f"env_{c}") for f, c in ((F.min, "left"), (F.min, "top"), (F.max, "right"), (F.max, "bottom"))],
        F.avg(G.center_x()).alias("mean_x"), F.avg(G.center_y()).alias("mean_y"),
    )
    rows = rows.withColumns({"unit": F.lit(unit), "env_cx": G.center_x("env_"), "env_cy": G.center_y("env_")})
    return with_value(repair_repeated_labels(rows, keys) if unit == "mins" else rows)


def with_value(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.regexp_extract("label", r"(\d+)", 1).cast("int"))


def repair_repeated_labels(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Of equal labels, ordered by envelope centre, the n-th from 0 is 60 n minutes later; labels that occur once stay as they are."""
    same = Window.partitionBy(*keys, "label")
    turn = F.row_number().over(same.orderBy("env_cx", "cluster")) - 1
    digits = F.regexp_extract("label", r"(\d+)", 1).cast("int")
    marked = rows.withColumns({"_n": F.count(F.lit(1)).over(same), "_turn": turn})
    return marked.withColumn("label", F.when(F.col("_n") > 1, F.concat((digits + 60 * F.col("_turn")).cast("string"), F.lit("_mins"))).otherwise(F.col("label"))).drop("_n", "_turn")


def legend_locations(clusters: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Label -> mean centre; of equal labels the last cluster counts."""
    last = F.max_by(F.struct("unit", "value", "mean_x", "mean_y"), "cluster")
    return clusters.groupBy(*keys, "label").agg(last.alias("x")).select(*keys, "label", "x.*")


def fifteen_minute_intervals(legend: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Consecutive minute labels divisible by 15 as intervals ``(name, lo, hi)`` on the x axis; a missing label widens one."""
    quarter = legend.where("unit = 'mins' and value % 15 = 0")
    order = Window.partitionBy(*keys).orderBy("value", "label")
    pair = quarter.withColumns({"hi": F.lead("mean_x").over(order), "_next": F.lead("label").over(order)}).where("_next is not null")
    return pair.select(*keys, F.concat_ws("-", "label", "_next").alias("name"), F.col("value").alias("start"), F.col("mean_x").alias("lo"), "hi")


# Isolating the legend --------------------------------------------------------------------------------------------------------

def highest(v: np.ndarray, extent: float) -> float:
    """Where a Gaussian density over ``v`` is highest on ``GRID`` points of [0, extent]; the first of equals.

    Every ``STEP``-th point is tried first. The density's slope has a bound, so only points near those that come close enough to the best one can be higher.
    """
    width = 0.2 * v.std(ddof=1) if len(v) > 1 else 0.0
    if width <= 0:
        return float(v.mean()) if len(v) else float("nan")
    grid = np.linspace(0, extent, GRID)
    own, times = np.unique(v, return_counts=True)
    density = lambda at: np.exp(-0.5 * ((at[:, None] - own[None]) / width) ** 2) @ times
    coarse = np.arange(STEP // 2, GRID, STEP)
    tried = density(grid[coarse])
    rise = len(v) * np.exp(-0.5) / width * (extent / (GRID - 1)) * (STEP // 2 + 1)
    close = np.flatnonzero(tried + rise * (1 + 1e-9) >= tried.max())
    fine = np.unique(np.clip((coarse[close, None] + np.arange(-(STEP // 2) - 1, STEP // 2 + 2)).ravel(), 0, GRID - 1))
    return float(grid[fine[density(grid[fine]).argmax()]])


def density_peaks(values: DataFrame, extents: dict[str, float], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``(keys, <column>_peak, ...)``: where a Gaussian density over each column is highest on 10,000 points of [0, extent].

    The bandwidth is a fifth of the sample's standard deviation. A task goes through many groups at once; those with the same values, as on sheets with the same print, are searched once.
    """
    ship(values.sparkSession)
    schema = values.select(*keys, *[F.lit(0.0).alias(f"{c}_peak") for c in extents]).schema
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in groups.whole(batches, n):
            out = t.select(list(keys)).take(pa.array(bounds[:-1]))
            for c, extent in extents.items():
                v, there = t.column(c).fill_null(np.nan).to_numpy(), t.column(c).is_valid().to_numpy()
                known: dict[bytes, float] = {}
                peaks = []
                for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.sort(v[x:y][there[x:y]])
                    key = own.tobytes()
                    if key not in known:
                        known[key] = highest(own, extent)
                    peaks.append(known[key])
                out = out.append_column(f"{c}_peak", pa.array(peaks, pa.float64()))
            yield from out.to_batches()

    rows = values.select(*keys, *[F.col(c).cast("double").alias(c) for c in extents])
    return dealt(rows, keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def density_peak(values: DataFrame, extent: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """:func:`density_peaks` of column ``v``, as ``(keys, peak)``."""
    return density_peaks(values.select(*keys, "v"), {"v": extent}, keys).withColumnRenamed("v_peak", "peak")


def isolate_legend(landmarks: DataFrame, width: float, height: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Digit landmarks of the middle of the sheet with their ``axis``: ``mins`` along the top, ``mmhg`` down the left."""
    digits = landmarks.where(F.col("category").isin(DIGITS) & (G.center_y() > 0.2 * height) & (G.center_y() < 0.8 * height))
    peaks = density_peaks(digits, {"left": width, "top": height}, keys)
    dx, dy = G.stated(F.abs(G.center_x() - F.col("left_peak"))), G.stated(F.abs(G.center_y() - F.col("top_peak")))
    return digits.join(peaks, list(keys)).withColumn("axis", F.when(dx > dy, "mins").when(dx < dy, "mmhg")).where("axis is not null").drop("left_peak", "top_peak")


def iqr_filter(df: DataFrame, col: str, k: float = 1.5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows whose value lies within k interquartile ranges of the middle half of its group."""
    q = df.groupBy(*keys).agg(F.percentile(col, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    reach = k * (F.col("_q")[1] - F.col("_q")[0])
    return df.join(q, list(keys)).where(F.col(col).between(F.col("_q")[0] - reach, F.col("_q")[1] + reach)).drop("_q")
