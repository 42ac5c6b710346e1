"""Suppression, clustering and searches on groups that are too large for one task, against the one-task versions and brute force."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheetwise.operators import clusters_large, components, decode, legend, nearest, session, suppression

COLS = "sheet_id long, det_id long, ord long, category string, left double, top double, right double, bottom double, confidence double"


def boxes(spark, n, size, field=300, sheets=2, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = rng.uniform(-field, field), rng.uniform(0, field), rng.choice(size), rng.choice(size)
        rows.append((i % sheets, i, i, str(i % 3), x, y, x + w, y + h, rng.randrange(50) / 50))
    return spark.createDataFrame(rows, COLS)


@pytest.mark.parametrize("size", [(5.0, 20.0), (1.0, 70.0, 900.0), (3.0, 64.0, 65.0, 128.0, 129.0, 4000.0)])
def test_pairs_over_all_levels(spark, size):
    det = boxes(spark, 240, size)
    rows = det.collect()
    want = set()
    for a in rows:
        for b in rows:
            if a.sheet_id == b.sheet_id and a.ord < b.ord:
                both = max(0.0, min(a.right, b.right) - max(a.left, b.left)) * max(0.0, min(a.bottom, b.bottom) - max(a.top, b.top))
                areas = [(x.right - x.left) * (x.bottom - x.top) for x in (a, b)]
                if both / min(areas) >= 0.2:
                    want.add((a.sheet_id, a.ord, b.ord))
    got = [(r.sheet_id, r.hi, r.lo) for r in suppression.overlap_pairs(det, "iom", 0.2).collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_large_box_is_dealt_to_few_cells(spark):
    rows = [(1, i, i, "a", 10.0 * i, 5.0, 10.0 * i + 20, 30.0, 0.5) for i in range(50)] + [(1, 99, 99, "a", 3.0, 7.0, 3003.0, 2007.0, 0.9)]
    pairs = suppression.overlap_pairs(spark.createDataFrame(rows, COLS), "iom", 0.1)
    assert {r.hi for r in pairs.where("lo = 99").collect()} == set(range(50))
    levels = [r.v for r in spark.createDataFrame(rows, COLS).select(suppression.grid_level(64.0).alias("v")).distinct().collect()]
    assert sorted(levels) == [0, 6]  # cells of 4,096 px: the large box touches four at most


@pytest.mark.parametrize("in_one_task", [1_000_000, 60, 3])
def test_suppression_by_sheets_components_and_rounds(spark, in_one_task):
    det = suppression.rank_by_score(boxes(spark, 260, (5.0, 30.0)), F.col("confidence"))
    pairs = suppression.overlap_pairs(det, "iou", 0.1, order="rank")
    gone = lambda df: sorted((r.sheet_id, r["rank"]) for r in df.collect())
    assert gone(suppression.greedy(pairs, in_one_task=in_one_task)) == gone(suppression.in_rounds(pairs)) != []


@pytest.mark.parametrize("in_one_task, jobs", [(1_000_000, 12), (6_000, 240)])
def test_long_chains_take_few_jobs(spark, in_one_task, jobs):
    """Two chains of 5,000 boxes of which each overlaps the next: every other one falls, whether the sheet is gone through at once or by components, never in rounds."""
    n = 10_000
    left = F.col("id") * 6.0 + F.when(F.col("id") >= n // 2, 100.0).otherwise(0.0)
    det = spark.range(n).select(F.lit(1).cast("long").alias("sheet_id"), F.col("id").alias("rank"), left.alias("left"), F.lit(0.0).alias("top"), (left + 10).alias("right"), F.lit(10.0).alias("bottom"))
    pairs = suppression.overlap_pairs(det, "iou", 0.2, order="rank")
    context = spark.sparkContext
    context.setJobGroup(f"chain {in_one_task}", "")
    try:
        got = {r["rank"] for r in suppression.greedy(pairs, in_one_task=in_one_task).collect()}
    finally:
        done = len(context.statusTracker().getJobIdsForGroup(f"chain {in_one_task}"))
        context.setJobGroup("others", "")
    assert got == set(range(1, n, 2)) and done <= jobs


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(4)
    names = rng.sample(range(100_000), 900)
    chain, star, ring = names[:300], names[300:600], names[600:]
    links = [*zip(chain, chain[1:]), *((star[0], x) for x in star[1:]), *zip(ring, ring[1:]), (ring[-1], ring[0]), (ring[0], ring[1])]
    links = [(k, *((a, b) if rng.random() < 0.5 else (b, a))) for a, b in links for k in (1, 2)]
    got = components.components(spark.createDataFrame(links, "k long, a long, b long"), ("k",)).collect()
    assert len(got) == 1800 and {(r.k, r.node): r.component for r in got} == {(k, x): min(g) for k in (1, 2) for g in (chain, star, ring) for x in g}


# Models ----------------------------------------------------------------------------------------------------------------------

def counting(folder):
    """A model factory that leaves a file for each build, and whose model leaves its batch sizes."""

    def build():
        open(f"{folder}/build-{os.getpid()}-{len(os.listdir(folder))}-{random.random()}", "w").close()

        def run(pdf):
            open(f"{folder}/batch-{len(pdf)}-{random.random()}", "w").close()
            return pd.DataFrame({"tile": pdf["tile"], "pos": 0, "category": "a", "left": pdf["tile"] * 1.0, "top": 0.0, "right": pdf["tile"] + 1.0, "bottom": 1.0, "confidence": 0.5})

        return run

    return build


def test_one_model_for_each_worker(spark, tmp_path):
    factory = counting(str(tmp_path))
    tiles = spark.range(400).select(F.col("id").alias("tile")).repartition(40)
    for _ in range(2):
        assert decode.score_tiles(tiles, factory, ("tile",), batch=4).agg(F.sum("left")).first()[0] == 400 * 399 / 2
    files = os.listdir(tmp_path)
    builds = [f.split("-")[1] for f in files if f.startswith("build")]
    assert len(builds) == len(set(builds)) and len(builds) <= 8 < 80  # 80 tasks, at most a worker for each core
    sizes = [int(f.split("-")[1]) for f in files if f.startswith("batch")]
    assert max(sizes) == 4 and sum(sizes) == 800
    with pytest.raises(ValueError, match="batch"):
        decode.score_tiles(tiles, factory, ("tile",), batch=0)


def test_batches_keep_rows_in_order():
    frames = [pd.DataFrame({"a": range(i, i + n)}) for i, n in ((0, 3), (3, 0), (3, 11), (14, 1))]
    got = list(session.in_batches(iter(frames), 4))
    assert [len(f) for f in got] == [4, 4, 4, 3] and pd.concat(got)["a"].tolist() == list(range(15))
    assert list(session.in_batches(iter([]), 4)) == []


def test_workers_forget_the_oldest_model():
    for i in range(session.KEPT + 3):
        assert session.model(f"m{i}", lambda i=i: i) == i
    assert len(session._models) == session.KEPT and session.model(f"m{session.KEPT + 2}", lambda: -1) == session.KEPT + 2
    assert session.model("m0", lambda: -1) == -1


# Nearest centroids -----------------------------------------------------------------------------------------------------------

def brute_nearest(points, places):
    """(name, dist) by stated distance, then name."""
    out = []
    names = np.array([p[0] for p in places])
    order = np.argsort(names, kind="stable")
    xy = np.array([p[1:] for p in places])[order]
    for x, y in points:
        d = np.sqrt((xy[:, 0] - x) ** 2 + (xy[:, 1] - y) ** 2)
        i = int(np.round(d, 10).argmin())
        out.append((str(names[order][i]), round(float(d[i]), 9)))
    return out


def one_form(spark, places, points):
    centroids = spark.createDataFrame([("f", *p) for p in places], "form string, name string, cx double, cy double")
    det = spark.createDataFrame([(1, i, i, "a", "f", x * 1000 - 1, y * 1000 - 1, x * 1000 + 1, y * 1000 + 1) for i, (x, y) in enumerate(points)], "sheet_id long, det_id long, ord long, category string, form string, left double, top double, right double, bottom double")
    return det, centroids


@pytest.mark.parametrize("spread", ["even", "corners", "one line", "one place", "lattice"])
def test_nearest_centroid_on_grids(spark, spread):
    rng = random.Random(7)
    u = rng.random
    place = {
        "even": lambda: (u(), u()), "corners": lambda: rng.choice([(u() / 500, u() / 500), (1 - u() / 500, 1 - u() / 500)]), "one line": lambda: (u(), 0.5), "one place": lambda: (0.25, 0.75), "lattice": lambda: (rng.randrange(20) / 16, rng.randrange(20) / 16)
    }[spread]
    places = [(f"p{i:04d}", *place()) for i in rng.sample(range(9999), 700)]
    points = [(rng.uniform(-0.5, 1.5), rng.uniform(-0.5, 1.5)) for _ in range(150)] + [(rng.randrange(40) / 32, rng.randrange(40) / 32) for _ in range(60)] + [(30.0, -20.0)]
    det, centroids = one_form(spark, places, points)
    got = nearest.nearest_centroid(det, centroids, F.lit(1000.0), F.lit(1000.0), most=10).orderBy("det_id").collect()
    at = [((x * 1000 - 1 + (x * 1000 + 1 - (x * 1000 - 1)) / 2) / 1000, (y * 1000 - 1 + (y * 1000 + 1 - (y * 1000 - 1)) / 2) / 1000) for x, y in points]
    assert [(r.name, round(r.dist, 9)) for r in got] == brute_nearest(at, places)


def test_many_centroids_do_not_meet_all_detections(spark):
    """200,000 centroids of one form; forms without centroids have no rows, repeated detections stay."""
    rng = np.random.default_rng(3)
    xy = rng.random((200_000, 2))
    points = [tuple(p) for p in rng.random((300, 2)).tolist()] * 2
    centroids = spark.createDataFrame(pd.DataFrame({"form": "f", "name": [f"c{i:06d}" for i in range(len(xy))], "cx": xy[:, 0], "cy": xy[:, 1]})).repartition(4)
    det, _ = one_form(spark, [("a", 0.0, 0.0)], points)
    other = det.withColumn("form", F.lit("none"))
    rows = nearest.nearest_centroid(det.unionByName(other), centroids, F.lit(1000.0), F.lit(1000.0)).orderBy("det_id").collect()
    assert [(r.name, round(r.dist, 9)) for r in rows] == brute_nearest(points, [(f"c{i:06d}", *p) for i, p in enumerate(xy.tolist())])


# Clusters --------------------------------------------------------------------------------------------------------------------

def points_of(spark, xy, sheet=None):
    """Boxes of two pixels around points; ids go up with an offset between sheets."""
    frame = pd.DataFrame({"sheet_id": [1] * len(xy) if sheet is None else sheet, "det_id": range(len(xy)), "x": [p[0] for p in xy], "y": [p[1] for p in xy]})
    df = spark.createDataFrame(frame).select("sheet_id", "det_id", F.lit("a").alias("category"), (F.col("x") - 1).alias("left"), (F.col("y") - 1).alias("top"), (F.col("x") + 1).alias("right"), (F.col("y") + 1).alias("bottom"))
    return df.repartition(3)


def clouds(seed=1, n=260):
    """Two sheets: clouds of different density, a lattice with ties, loners and equal points."""
    rng = random.Random(seed)
    xy, sheet = [], []
    for s in (1, 2):
        for i in range(n):
            kind = i % 5
            p = {0: (rng.gauss(100, 4), rng.gauss(100, 4)), 1: (rng.gauss(160, 15), rng.gauss(120, 15)), 2: (300.0 + i % 12 * 4, 40.0 + i // 12 % 9 * 4), 3: (rng.uniform(0, 400), rng.uniform(0, 300)), 4: (120.0, 240.0 + i % 3)}[kind]
            xy.append(p)
            sheet.append(s)
    return xy, sheet


@pytest.mark.parametrize("eps, least", [(4.0, 1), (4.0, 3), (9.0, 5), (25.0, 12), (1000.0, 4)])
def test_density_clusters_by_cells(spark, eps, least):
    df = points_of(spark, *clouds())
    got = lambda most: {r.det_id: r.cluster for r in legend.cluster_dbscan(df, eps, least, in_one_task=most).collect()}
    assert got(10_000) == got(5)


def test_one_dense_cloud_without_all_pairs(spark):
    """50,000 points within one eps, and a second cloud just beyond it."""
    rng = np.random.default_rng(1)
    turn, far = rng.random(50_000) * 2 * np.pi, np.sqrt(rng.random(50_000)) * 4.9
    xy = np.stack([far * np.cos(turn) + 50, far * np.sin(turn) + 50], axis=1)
    xy = np.concatenate([xy, [[54.9 + 10.5 + i * 1e-3, 50.0] for i in range(40)]])
    got = {r.cluster: r.n for r in legend.cluster_dbscan(points_of(spark, xy), 10.0, 3).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 50_000, 50_000: 40}


@pytest.mark.parametrize("k", [1, 2, 7, 40])
def test_single_linkage_over_all_tasks(spark, k):
    xy, sheet = clouds(3, 150)
    df = points_of(spark, xy, sheet)
    at = df.select("sheet_id", "det_id", (F.col("left") + 1).alias("x"), (F.col("top") + 1).alias("y"))
    want = {(r.sheet_id, r.det_id): r.label for r in legend._partition(df, [k], ("sheet_id",), "agglomerative").collect()}
    got = clusters_large.linkage_over_tasks(at, [k], ("sheet_id",), block=30).collect()
    assert len(got) == len(want) and {(r.sheet_id, r.det_id): r.label for r in got} == want


def test_spanning_tree_has_one_answer():
    """On a lattice all edges tie; the tree is that of the ordered edges."""
    at = [(float(i % 4), float(i // 4)) for i in range(12)]
    root = list(range(12))
    want = []
    for d, a, b in sorted((np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1]), a, b) for a in range(12) for b in range(a + 1, 12)):
        if root[a] != root[b]:
            want.append((d, a, b))
            root = [root[a] if r == root[b] else r for r in root]
    x, y = np.array(at).T
    for order in (np.arange(12), np.arange(12)[::-1]):
        assert sorted(clusters_large.spanning_tree(order, x[order], y[order])) == want


def test_single_linkage_of_a_large_group(spark):
    """100,000 points: three wide bands that chain up, and a loner."""
    rng = np.random.default_rng(2)
    n = 100_000
    band = rng.integers(0, 3, n - 1)
    xy = np.stack([rng.random(n - 1) * 3000, band * 200 + rng.random(n - 1) * 90], axis=1)
    xy = np.concatenate([xy, [[1500.0, 900.0]]])
    rows = legend.cluster_agglomerative(points_of(spark, xy), [4]).groupBy("cluster").agg(F.count("*").alias("n"), F.min("det_id").alias("d")).collect()
    first = {b: int(np.flatnonzero(band == b)[0]) for b in range(3)} | {3: n - 1}
    size = {**{b: int((band == b).sum()) for b in range(3)}, 3: 1}
    assert {(r.d, r.n) for r in rows} == {(first[b], size[b]) for b in range(4)}


@pytest.mark.parametrize("held", [2000, 7])
def test_silhouette_against_brute_force(spark, held):
    rng = random.Random(5)
    rows = [(s, i, rng.gauss(0, 9), rng.gauss(0, 9), rng.choice([0, 0, 1, 2, 30]) if s < 3 else 1) for s in (1, 2, 3) for i in range(40)] + [(4, 0, 1.0, 1.0, 5), (5, 0, 0.0, 0.0, 1), (5, 1, 0.0, 0.0, 2)]
    got = {(r.g, r.det_id): r.s for r in clusters_large.silhouettes(spark.createDataFrame(rows, "g int, det_id long, x double, y double, label int"), ("g",), held).collect()}
    for g, i, x, y, label in rows:
        mean = {}
        for h, j, x2, y2, other in rows:
            if h == g and (j != i):
                mean.setdefault(other, []).append(((x - x2) ** 2 + (y - y2) ** 2) ** 0.5)
        own, others = mean.pop(label, None), [sum(v) / len(v) for v in mean.values()]
        a = sum(own) / len(own) if own else None
        want = 0.0 if a is None or not others or max(a, min(others)) == 0 else (min(others) - a) / max(a, min(others))
        assert abs(got[g, i] - want) < 1e-9
    plan = clusters_large.silhouettes(spark.createDataFrame(rows, "g int, det_id long, x double, y double, label int"), ("g",))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.replace("SortMergeJoin [g", "") or plan.count("Join") <= 1


def same_groups(a, b):
    """Whether two labellings of the same points have the same clusters."""
    return len({(a[i], b[i]) for i in a}) == len(set(a.values())) == len(set(b.values()))


def test_kmeans_over_all_tasks_as_in_one_call(spark):
    """Sheets of well-separated digits: oversampled seeding and shared rounds find the clusters of the one-call version."""
    rng = random.Random(8)
    xy, sheet = [], []
    for s in (1, 2, 3):
        for c in range(20):
            for i in range(2 + c % 3):
                xy.append((100 + 60 * (c % 5) + 3.0 * i, 100 + 50 * (c // 5) + rng.random()))
                sheet.append(s)
    df = points_of(spark, xy, sheet)
    got = [{r.det_id: (r.sheet_id, r.cluster) for r in legend.cluster_kmeans(df, [18, 19, 20], in_one_task=most).collect()} for most in (20_000, 5)]
    assert len(got[0]) == len(xy) and same_groups(*got)


def test_kmeans_of_a_million_points(spark):
    at = spark.range(1_000_000).select(F.lit(1).cast("long").alias("sheet_id"), F.col("id").alias("det_id"), (F.col("id") % 7 * 100 + F.rand(1) * 20).alias("left"), (F.col("id") % 3 * 90 + F.rand(2) * 20).alias("top"))
    df = at.withColumns({"right": F.col("left") + 2, "bottom": F.col("top") + 2, "category": F.lit("a")})
    found = legend.cluster_kmeans(df, [21]).groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct(F.col("det_id") % 21).alias("m")).collect()
    assert len(found) == 21 and all(r.m == 1 for r in found)


def test_too_few_points_for_the_clusters(spark):
    df = points_of(spark, [(1.0, 1.0), (5.0, 5.0), (9.0, 9.0)])
    assert legend.cluster_kmeans(df, [4]).count() == 0 and legend.cluster_kmeans(df, [3, 4]).count() == 3
    for cluster in (legend.cluster_kmeans, legend.cluster_agglomerative):
        with pytest.raises(Exception, match="3 points are too few for 4 clusters"):
            cluster(df, [3, 4], few="fail").count()
    with pytest.raises(ValueError, match="drop or fail"):
        legend.cluster_kmeans(df, [1], few="maybe")
