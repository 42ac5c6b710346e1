"""Clustering of groups that are too large for one task; the results are those of the one-task versions in :mod:`legend`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.operators import groups
from sheetwise.operators.components import components
from sheetwise.operators.nearest import BROADCAST_ROWS, small
from sheetwise.operators.suppression import overlap_pairs
from sheetwise.runtime import cut, cut_to, remove, scratch, ship


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(F.col(x1) - F.col(x2), 2) + F.pow(F.col(y1) - F.col(y2), 2))


# Density clusters ------------------------------------------------------------------------------------------------------------

#: Parts of a cell's side for which bounds are kept.
PARTS = 8


def dbscan_by_cells(at: DataFrame, eps: float, min_samples: int, keys: tuple[str, ...]) -> DataFrame:
    """``(keys, det_id, cluster)`` of points ``(keys, det_id, x, y)``; noise is left out.

    In a cell of side eps / sqrt(2) all points are neighbours, so a cell of ``min_samples`` points has core points only, and clusters are components of linked cells. Two cells are linked if the
    bounds of some of their parts are within eps; only where these leave it open, points of the parts in question meet. Points of sparse cells (fewer than ``min_samples``) count their neighbours one by one.
    """
    side = eps / np.sqrt(2.0) * (1 - 1e-9)
    part = side / PARTS
    index = lambda c, s: F.floor(F.col(c) / s)
    spark = at.sparkSession
    by = [*keys, "cx", "cy"]
    at = at.withColumns({"cx": index("x", side), "cy": index("y", side)})
    sparse = at.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < min_samples).drop("_n")
    lone = cut(spark, at.join(sparse, by, "left_semi"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    around = lone.withColumn("_s", F.explode(steps)).select(*keys, "det_id", "x", "y", (F.col("cx") + F.col("_s.i")).alias("cx"), (F.col("cy") + F.col("_s.j")).alias("cy"))
    others = at.select(*by, F.col("det_id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = distance("x", "y", "x2", "y2") <= eps
    enough = around.join(others, by).where(near).groupBy(*keys, "det_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_samples).select(*keys, "det_id")
    core = cut(spark, at.join(sparse, by, "left_anti").unionByName(lone.join(enough, [*keys, "det_id"], "left_semi")))
    # Bounds of the parts of each core cell; the cell is named after its smallest core point.
    parts = core.groupBy(*by, index("x", part).alias("px"), index("y", part).alias("py")).agg(F.min("det_id").alias("first"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")])
    bounds = F.struct("px", "py", "min_x", "max_x", "min_y", "max_y")
    cells = cut(spark, parts.groupBy(*by).agg(F.min("first").alias("cell"), F.collect_list(bounds).alias("parts")))
    half = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)])
    left = cells.withColumn("_s", F.explode(half)).select(*keys, F.col("cell").alias("a"), F.col("parts").alias("a_parts"), F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy"), (F.col("cx") + F.col("_s.i")).alias("cx"), (F.col("cy") + F.col("_s.j")).alias("cy"))
    pairs = left.join(cells.select(*by, F.col("cell").alias("b"), F.col("parts").alias("b_parts")), by)
    gap = lambda p, q, c: F.greatest(F.lit(0.0), p[f"min_{c}"] - q[f"max_{c}"], q[f"min_{c}"] - p[f"max_{c}"])
    far = lambda p, q, c: F.greatest(F.abs(p[f"max_{c}"] - q[f"min_{c}"]), F.abs(q[f"max_{c}"] - p[f"min_{c}"]))
    span = lambda f, p, q: F.sqrt(F.pow(f(p, q, "x"), 2) + F.pow(f(p, q, "y"), 2))
    sure = F.exists("a_parts", lambda p: F.exists("b_parts", lambda q: span(far, p, q) <= eps))
    pairs = cut(spark, pairs.withColumn("sure", sure))
    some = lambda p: F.filter("b_parts", lambda q: span(gap, p, q) <= eps)
    doubt = pairs.where("not sure").withColumn("_p", F.explode("a_parts")).withColumn("_q", F.explode(some(F.col("_p"))))
    doubt = doubt.select(*keys, "a", "b", "a_cx", "a_cy", "cx", "cy", F.col("_p.px").alias("a_px"), F.col("_p.py").alias("a_py"), F.col("_q.px").alias("px"), F.col("_q.py").alias("py"))
    placed = core.select(*by, index("x", part).alias("px"), index("y", part).alias("py"), "x", "y").distinct()
    first = placed.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("cx", "cy", "px", "py")], "x", "y")
    second = placed.withColumnsRenamed({"x": "x2", "y": "y2"})
    met = doubt.join(first, [*keys, "a_cx", "a_cy", "a_px", "a_py"]).join(second, [*by, "px", "py"]).where(near).select(*keys, "a", "b").distinct()
    links = pairs.where("sure").select(*keys, "a", "b").unionByName(met)
    named = components(links, keys).select(*keys, F.col("node").alias("cell"), "component")
    cluster = F.coalesce("component", "cell").alias("cluster")
    of_cell = cut(spark, cells.select(*by, "cell").join(named, [*keys, "cell"], "left").select(*by, cluster))
    cores = core.join(of_cell, by).select(*keys, "det_id", "cluster", "x", "y", "cx", "cy")
    # A border point goes to its smallest neighbouring core's cluster.
    border = around.join(core.select(*keys, "det_id"), [*keys, "det_id"], "left_anti")
    reached = border.join(cores.select(*by, F.col("det_id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cluster"), by).where(near).groupBy(*keys, "det_id").agg(F.min_by("cluster", "other").alias("cluster"))
    return cores.select(*keys, "det_id", "cluster").unionByName(reached)


# Single linkage --------------------------------------------------------------------------------------------------------------

#: Points of a block, of which a task has two.
BLOCK = 1000
#: Bits of each coordinate in the order along which blocks are cut.
ORDER_BITS = 16


def spanning_tree(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (distance, smaller id, larger id) of the minimum spanning tree; equal distances are ordered by the ids, so there is only one."""
    n = len(ids)
    if n < 2:
        return []
    left = np.ones(n, bool)
    dist, low, high = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at, edges = 0, []
    left[0] = False
    for _ in range(n - 1):
        d = np.sqrt((x - x[at]) ** 2 + (y - y[at]) ** 2)
        lo, hi = np.minimum(ids, ids[at]), np.maximum(ids, ids[at])
        closer = left & ((d < dist) | ((d == dist) & ((lo < low) | ((lo == low) & (hi < high)))))
        dist[closer], low[closer], high[closer] = d[closer], lo[closer], hi[closer]
        least = np.where(left, dist, np.inf).min()
        ties = np.flatnonzero(left & (dist == least))
        at = int(ties[0]) if len(ties) == 1 else int(ties[np.lexsort((high[ties], low[ties]))[0]])
        left[at] = False
        edges.append((float(dist[at]), int(low[at]), int(high[at])))
    return edges


def spanning_trees(x: np.ndarray, y: np.ndarray) -> list[list[tuple[float, int, int]]]:
    """The sorted edges of :func:`spanning_tree` for groups of one size, a line each, with points' places for their ids; all trees grow by an edge at a time."""
    g, n = x.shape
    every, places = np.arange(g), np.arange(n)
    left = np.ones((g, n), bool)
    left[:, 0] = False
    dist, ends = np.full((g, n), np.inf), np.zeros((g, n), np.int64)
    at, far = np.zeros(g, np.int64), n * n
    edges = [[] for _ in range(g)]
    for _ in range(n - 1):
        d = np.sqrt((x - x[every, at][:, None]) ** 2 + (y - y[every, at][:, None]) ** 2)
        code = np.minimum(places, at[:, None]) * n + np.maximum(places, at[:, None])
        closer = left & ((d < dist) | ((d == dist) & (code < ends)))
        dist, ends = np.where(closer, d, dist), np.where(closer, code, ends)
        ties = left & (dist == np.where(left, dist, np.inf).min(axis=1)[:, None])
        at = np.where(ties, ends, far).argmin(axis=1)
        left[every, at] = False
        for mine, length, code in zip(edges, dist[every, at].tolist(), ends[every, at].tolist()):
            mine.append((length, code // n, code % n))
    return [sorted(e) for e in edges]


def _along(x: Column, y: Column) -> Column:
    """Place of a point along a Z-shaped curve, from coordinates of 0..1."""
    out = F.lit(0).cast("long")
    for bit in range(ORDER_BITS):
        for shift, c in ((0, x), (1, y)):
            whole = F.floor(c * float(2**ORDER_BITS - 1)).cast("long")
            out = out.bitwiseOR(F.shiftleft(F.shiftright(whole, bit).bitwiseAND(1), 2 * bit + shift))
    return out


def minimum_forest(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The edges ``(keys, d, lo, hi)`` of the minimum spanning forest, by Boruvka's rounds: every tree takes its least edge, so at least half of the trees go in each round.

    The trees that are joined point at each other in pairs at the most, so each finds its root by following pointers, twice as far each time.
    """
    spark = edges.sparkSession
    schema = edges.select(*keys, "d", "lo", "hi").schema
    now, path = cut_to(spark, edges.select(*keys, "d", "lo", "hi", F.col("lo").alias("a"), F.col("hi").alias("b")))
    found = []
    while not now.isEmpty():
        both = now.unionByName(now.select(*keys, "d", "lo", "hi", F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_path = cut_to(spark, both.groupBy(*keys, "a").agg(F.min(F.struct("d", "lo", "hi", "b")).alias("e")).select(*keys, "a", "e.*"))
        found.append(cut(spark, least.select(*keys, "d", "lo", "hi").distinct()))
        back = least.select(*keys, F.col("a").alias("b"), F.col("b").alias("_back"))
        root = least.join(back, [*keys, "b"]).select(*keys, "a", F.when((F.col("_back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("r"))
        root, root_path = cut_to(spark, root)
        while True:
            jump = root.join(root.select(*keys, F.col("a").alias("r"), F.col("r").alias("_far")), [*keys, "r"]).select(*keys, "a", F.col("_far").alias("r"), (F.col("_far") != F.col("r")).alias("moved"))
            new, new_path = cut_to(spark, jump)
            remove(spark, root_path)
            root, root_path = new.drop("moved"), new_path
            if new.where("moved").isEmpty():
                break
        to = lambda c: root.select(*keys, F.col("a").alias(c), F.col("r").alias(f"_{c}"))  # noqa: E731, B023
        left = now.join(to("a"), [*keys, "a"]).join(to("b"), [*keys, "b"]).where("_a <> _b").select(*keys, "d", "lo", "hi", F.col("_a").alias("a"), F.col("_b").alias("b"))
        new, new_path = cut_to(spark, left)
        for p in (path, least_path, root_path):
            remove(spark, p)
        now, path = new, new_path
    out = spark.createDataFrame([], schema)
    for f in found:
        out = out.unionByName(f)
    return out


def linkage_over_tasks(at: DataFrame, ks: list[int], keys: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """``(keys, k, det_id, x, y, label)``: single linkage of large groups of points ``(keys, det_id, x, y)`` into k clusters, for each k; a cluster's label is its place by smallest ``det_id``.

    Points are cut into blocks along a space-filling curve. Blocks that lie within r of each other meet in a task, which keeps the edges up to r of their spanning tree; these hold all edges up to r of
    the group's. From them a forest is made in rounds over all tasks. If it has no more trees than clusters are asked for, longer edges need not be known, and the longest ones of the forest are cut;
    else r is widened for the groups where it has.
    """
    spark = at.sparkSession
    ship(spark)
    extent = at.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"), F.count(F.lit(1)).alias("n"))
    extent = cut(spark, extent.withColumn("side", F.when(F.col("side") > 0, F.col("side")).otherwise(1.0)))
    along = at.join(small(extent), list(keys)).withColumn("_z", _along((F.col("x") - F.col("x0")) / F.col("side"), (F.col("y") - F.col("y0")) / F.col("side")))
    total = extent.agg(F.sum("n")).first()[0]
    dealt = along.repartitionByRange(max(1, int(total // block)), *keys, "_z", "det_id").withColumn("block", F.spark_partition_id().cast("long"))
    points = cut(spark, dealt.select(*keys, "det_id", "x", "y", "block"))
    # A range may hold the ends of two groups, which are blocks apart.
    blocks = cut(spark, points.groupBy(*keys, "block").agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom")))
    sides = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))
    reach = cut(spark, blocks.groupBy(*keys).agg(F.percentile_approx(sides, 0.5).alias("r")).join(extent, list(keys)).withColumn("r", F.greatest(F.col("r"), F.col("side") / F.sqrt("n"))).select(*keys, "r", "side", "n"))
    known = None
    fewest = min(ks)
    forests = []
    while True:
        wide = blocks.join(small(reach.select(*keys, "r")), list(keys))
        grown = wide.select(*keys, F.col("block").alias("ord"), *[(F.col(c) + s * F.col("r") * 0.5000001).alias(c) for c, s in (("left", -1), ("top", -1), ("right", 1), ("bottom", 1))])
        cell = float(reach.agg(F.max("r")).first()[0])
        met = overlap_pairs(grown, "iom", 0.0, True, keys=keys, cell=2 * cell).select(*keys, F.col("hi").alias("i"), F.col("lo").alias("j")).unionByName(wide.select(*keys, F.col("block").alias("i"), F.col("block").alias("j")))
        if known is not None:  # blocks that lie in one tree have no more to add
            own = known.join(points.select(*keys, F.col("det_id").alias("node"), "block"), [*keys, "node"]).groupBy(*keys, "block").agg(F.min("component").alias("c"), F.max("component").alias("c2"))
            side = lambda c, p: own.select(*keys, F.col("block").alias(c), F.when(F.col("c") == F.col("c2"), F.col("c")).alias(p))  # noqa: E731, B023
            met = met.join(side("i", "ci"), [*keys, "i"]).join(side("j", "cj"), [*keys, "j"]).where("ci is null or cj is null or ci <> cj").select(*keys, "i", "j")
        pairs = met.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
        edges = _pair_trees(pairs.join(points, [*keys, "block"]), keys).join(small(reach.select(*keys, "r")), list(keys)).where("d <= r").drop("r")
        if known is not None:
            edges = edges.unionByName(forests[-1].join(small(reach.select(*keys)), list(keys), "left_semi"))
        forest = cut(spark, minimum_forest(edges.distinct(), keys))
        trees = reach.join(forest.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), list(keys), "left").withColumn("trees", F.col("n") - F.coalesce("m", F.lit(0)))
        trees = cut(spark, trees)
        open_ = (F.col("trees") > fewest) & (F.col("r") < 2 * F.col("side"))
        done = trees.where(~open_)
        forests.append(forest)
        ready = forest.join(small(done.select(*keys)), list(keys), "left_semi")
        finished = ready if known is None else finished.unionByName(ready)
        reach = cut(spark, trees.where(open_).withColumn("r", 4 * F.col("r")).select(*keys, "r", "side", "n"))
        if reach.isEmpty():
            break
        known = _named(forest, points.join(small(reach.select(*keys)), list(keys), "left_semi"), keys)
    finished = cut(spark, finished)
    every = extent.select(*keys, "n").join(finished.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), list(keys), "left").withColumn("trees", F.col("n") - F.coalesce("m", F.lit(0)))
    out = []
    for k in ks:
        # Of the forest's edges the k - trees longest go: k is small, and so is what is taken of each group.
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("d").desc(), F.col("lo").desc(), F.col("hi").desc()))
        left = finished.join(small(every.where(F.col("n") >= k)), list(keys)).withColumn("_place", place).where(F.col("_place") > F.lit(k) - F.col("trees"))
        named = _named(left, points.join(small(every.where(F.col("n") >= k).select(*keys)), list(keys), "left_semi"), keys)
        firsts = named.select(*keys, "component").distinct().withColumn("label", (F.row_number().over(Window.partitionBy(*keys).orderBy("component")) - 1).cast("int"))
        labelled = named.join(firsts, [*keys, "component"]).select(*keys, F.col("node").alias("det_id"), "label")
        out.append(points.join(labelled, [*keys, "det_id"]).select(*keys, F.lit(int(k)).alias("k"), "det_id", "x", "y", "label"))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def _named(forest: DataFrame, points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``(keys, node, component)`` of all points."""
    linked = components(forest.select(*keys, F.col("lo").alias("a"), F.col("hi").alias("b")), keys)
    nodes = points.select(*keys, F.col("det_id").alias("node"))
    return cut(points.sparkSession, nodes.join(linked, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node")))


def _pair_trees(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Edges of the spanning tree of each pair of blocks; ``rows`` are their points, by (keys, i, j)."""
    by = [*keys, "i", "j"]
    schema = rows.select(*keys).schema.add("d", "double").add("lo", "long").add("hi", "long")

    def run(table: pa.Table) -> pa.Table:
        edges = spanning_tree(*(table.column(c).to_numpy() for c in ("det_id", "x", "y")))
        out = table.select(list(keys)).take(pa.array(np.zeros(len(edges), np.int64)))
        for i, (name, kind) in enumerate((("d", pa.float64()), ("lo", pa.int64()), ("hi", pa.int64()))):
            out = out.append_column(name, pa.array([e[i] for e in edges], kind))
        return out

    return rows.select(*by, "det_id", "x", "y").repartition(partitions(rows), *by).groupBy(*by).applyInArrow(run, schema)


# Silhouette ------------------------------------------------------------------------------------------------------------------

#: Points whose distance sums a task holds, and points that they meet at once.
HELD, MET = 2000, 512


def silhouettes_of_many(xy: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The silhouette of each point of groups ``(g, n, 2)`` with labels ``(g, n)``; a block of points meets its group at once."""
    g, n, _ = xy.shape
    # Clusters by number within their group.
    order = label.argsort(axis=1, kind="stable")
    by = np.take_along_axis(label, order, 1)
    number = np.zeros((g, n), np.int64)
    number[:, 1:] = (by[:, 1:] != by[:, :-1]).cumsum(axis=1)
    of = np.empty_like(number)
    np.put_along_axis(of, order, number, 1)
    member = (of[:, :, None] == np.arange(number.max() + 1)).astype(float)
    count = member.sum(axis=1)
    out = np.empty((g, n))
    for i in range(0, n, MET):
        own, here = of[:, i : i + MET, None], xy[:, i : i + MET]
        total = np.sqrt((here[:, :, None, 0] - xy[:, None, :, 0]) ** 2 + (here[:, :, None, 1] - xy[:, None, :, 1]) ** 2) @ member
        n_own = np.take_along_axis(count, own[..., 0], 1)
        a = np.take_along_axis(total, own, 2)[..., 0] / np.maximum(n_own - 1, 1)
        mean = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], np.inf)
        np.put_along_axis(mean, own, np.inf, 2)
        b = mean.min(axis=2)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[:, i : i + MET] = np.where((n_own == 1) | ~np.isfinite(b) | (np.maximum(a, b) == 0), 0.0, (b - a) / np.maximum(a, b))
    return out


def silhouettes(labelled: DataFrame, keys: tuple[str, ...], held: int = HELD) -> DataFrame:
    """``(keys, det_id, s)`` for points ``(keys, det_id, x, y, label)``.

    Groups of up to ``held`` points are gone through many at a time. A larger group's points are cut into blocks of about ``held``; each block is one task's, and all points of the group stream past it in batches. Distances
    are summed by cluster in numpy, so no row stands for a pair of points.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(*keys, "det_id", "x", "y", F.col("label").cast("long").alias("label"))
    schema = labelled.select(*keys, "det_id").schema.add("s", "double")
    counts, total, most = groups.sizes(rows, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in groups.whole(batches, len(keys)):
            x, y, label = (t.column(c).to_numpy() for c in ("x", "y", "label"))
            s = np.empty(t.num_rows)
            for place in groups.by_size(bounds, lambda n: n * min(n, MET)):
                s[place] = silhouettes_of_many(np.stack([x[place], y[place]], axis=2), label[place])
            yield from t.select([*keys, "det_id"]).append_column("s", pa.array(s)).to_batches()

    if most <= held:
        return groups.dealt(rows, keys, total).mapInArrow(run, schema)
    large = counts.where(F.col("_n") > held).select(*keys, F.ceil(F.col("_n") / F.lit(held)).cast("int").alias("_b"))
    within = groups.dealt(rows.join(large, list(keys), "left_anti"), keys, total).mapInArrow(run, schema)
    return within.unionByName(_silhouettes_by_blocks(rows.join(small(large), list(keys)), keys, total * (2 + most // held), schema))


def _silhouettes_by_blocks(rows: DataFrame, keys: tuple[str, ...], total: int, schema) -> DataFrame:
    """As :func:`silhouettes`, of groups that are cut into ``_b`` blocks each; ``total`` is the number of rows that meet blocks at the most."""
    own = rows.withColumns({"_block": F.pmod(F.xxhash64("det_id"), F.col("_b")).cast("int"), "_met": F.lit(False)})
    every = rows.withColumns({"_block": F.explode(F.sequence(F.lit(0), F.col("_b") - 1)), "_met": F.lit(True)})
    by = [*keys, "_block"]
    dealt = groups.dealt(own.unionByName(every).select(*by, "_met", "det_id", "x", "y", "label"), tuple(by), total, "_met", "label", "det_id")
    n = len(by)

    class Block:
        """Points of one block, and the sums of their distances to the points of each cluster so far."""

        def __init__(self) -> None:
            self.parts, self.sums, self.counts, self.xy = [], {}, {}, None

        def meet(self, x: np.ndarray, y: np.ndarray, label: np.ndarray) -> None:
            if self.xy is None:
                self.xy = [np.concatenate([p.column(c).to_numpy() for p in self.parts]) for c in ("x", "y", "label")]
            for i in range(0, len(x), MET):
                one = slice(i, i + MET)
                d = np.sqrt((self.xy[0][:, None] - x[one]) ** 2 + (self.xy[1][:, None] - y[one]) ** 2)
                for c in np.unique(label[one]).tolist():
                    of = label[one] == c
                    self.sums[c] = self.sums.get(c, 0.0) + d[:, of].sum(axis=1)
                    self.counts[c] = self.counts.get(c, 0) + int(of.sum())

        def result(self) -> pa.RecordBatch:
            label = self.xy[2]
            names = np.array(sorted(self.sums))
            total, count = np.stack([self.sums[c] for c in names.tolist()]), np.array([self.counts[c] for c in names.tolist()])
            own = np.searchsorted(names, label)
            at = np.arange(len(label))
            n_own = count[own]
            a = total[own, at] / np.maximum(n_own - 1, 1)
            mean = total / count[:, None]
            mean[own, at] = np.inf
            b = mean.min(axis=0)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = np.where((n_own == 1) | ~np.isfinite(b) | (np.maximum(a, b) == 0), 0.0, (b - a) / np.maximum(a, b))
            rows = pa.concat_tables([pa.Table.from_batches([p]) for p in self.parts]).select([*keys, "det_id"]).append_column("s", pa.array(s)).combine_chunks()
            return rows.to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, Block()
        for b in batches:
            if not b.num_rows:
                continue
            groups = list(zip(*(b.column(i).to_pylist() for i in range(n)), b.column(n).to_pylist()))
            cuts = [0, *[i for i in range(1, len(groups)) if groups[i] != groups[i - 1]], len(groups)]
            for s, e in zip(cuts, cuts[1:]):
                if groups[s][:-1] != now:
                    if now is not None:
                        yield block.result()
                    now, block = groups[s][:-1], Block()
                piece = b.slice(s, e - s)
                if groups[s][-1]:
                    block.meet(*(piece.column(c).to_numpy() for c in ("x", "y", "label")))
                else:
                    block.parts.append(piece)
        if now is not None:
            yield block.result()

    return dealt.mapInArrow(run, schema)


# k-means ---------------------------------------------------------------------------------------------------------------------

#: Rounds of oversampling, and how many points are expected in each, in multiples of k.
SEED_ROUNDS, OVER = 5, 2


def _centre_lists(centres: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The centres of each group as one array: some multiples of k."""
    return centres.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("c", "x", "y"))).alias("_centres"))


def _nearest(points: DataFrame, centres: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Points ``(keys, det_id, x, y)`` with ``near`` (squared distance ``d``, centre ``c``): the nearest centre, of equal ones the first.

    Up to ``BROADCAST_ROWS`` centres are sent to all tasks, where numpy compares batches of points with them; more are joined as a list for each group.
    """
    known = centres.select(*keys, "c", "x", "y").limit(BROADCAST_ROWS + 1).toArrow()
    if known.num_rows > BROADCAST_ROWS:
        square = lambda z: F.pow(F.col("x") - z["x"], 2) + F.pow(F.col("y") - z["y"], 2)
        near = F.array_min(F.transform("_centres", lambda z: F.struct(square(z).alias("d"), z["c"].alias("c"))))
        return points.join(_centre_lists(centres, keys), list(keys)).withColumn("near", near).drop("_centres")
    lists: dict[tuple, list[tuple]] = {}
    for *group, c, x, y in zip(*(column.to_pylist() for column in known.sort_by("c").columns)):
        lists.setdefault(tuple(group), []).append((c, x, y))
    held = points.sparkSession.sparkContext.broadcast({g: (np.array([r[0] for r in rows], np.int64), np.array([r[1:] for r in rows])) for g, rows in lists.items()})
    schema = points.select(*keys, "det_id", "x", "y").schema
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: dict[tuple, list[int]] = {}
            for i, group in enumerate(zip(*(b.column(j).to_pylist() for j in range(n)))):
                of.setdefault(group, []).append(i)
            xy = np.stack([b.column(n + 1).to_numpy(), b.column(n + 2).to_numpy()], axis=1)
            d, c = np.full(b.num_rows, np.nan), np.zeros(b.num_rows, np.int64)
            for group, rows in of.items():
                names, at = held.value[group]
                for i in range(0, len(rows), MET):
                    own = np.array(rows[i : i + MET])
                    square = (xy[own, 0, None] - at[:, 0]) ** 2 + (xy[own, 1, None] - at[:, 1]) ** 2
                    best = square.argmin(axis=1)
                    d[own], c[own] = square[np.arange(len(own)), best], names[best]
            near = pa.StructArray.from_arrays([pa.array(d), pa.array(c)], names=["d", "c"])
            yield pa.RecordBatch.from_arrays([*b.columns, near], names=[*schema.names, "near"])

    out = T.StructType([*schema.fields, T.StructField("near", T.StructType().add("d", "double").add("c", "long"))])
    return points.select(schema.names).mapInArrow(run, out)


def kmeans_over_tasks(at: DataFrame, k: int, keys: tuple[str, ...], seed_centres, rounds: int, tolerance: float, seed: int = 0) -> DataFrame:
    """``(keys, k, det_id, x, y, label)``: k-means of large groups of points.

    Centres start from oversampled seeding: in each of ``SEED_ROUNDS`` rounds a point is taken with a chance in proportion to its squared distance from those taken so far, decided by a hash; ``seed_centres`` (x, y, weights, k)
    then picks k of these, weighted by the points nearest to them. Lloyd's rounds sum points by centre with partial aggregation until the centres move by less than ``tolerance`` of the points' variance.
    """
    spark = at.sparkSession
    ship(spark)
    with scratch(spark) as own:
        points = cut(spark, at.select(*keys, "det_id", "x", "y"))
        spread = own(points.groupBy(*keys).agg(((F.var_pop("x") + F.var_pop("y")) / 2 * tolerance).alias("stop"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k))
        points_k = points.join(small(spread.select(*keys)), list(keys), "left_semi")
        taken = own(points_k.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), F.xxhash64(F.lit(seed), "det_id")).alias("p"), F.min(F.xxhash64(F.lit(seed), "det_id")).alias("c")).select(*keys, "c", "p.x", "p.y"))
        for turn in range(SEED_ROUNDS):
            near = _nearest(points_k, taken, keys)
            cost = small(own(near.groupBy(*keys).agg(F.sum("near.d").alias("_cost"))))
            chance = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn + 1), "det_id"), F.lit(1 << 40)) / float(1 << 40)
            drawn = near.join(cost, list(keys)).where((F.col("_cost") > 0) & (chance * F.col("_cost") < OVER * k * F.col("near.d")))
            taken = own(taken.unionByName(drawn.select(*keys, F.xxhash64("det_id").alias("c"), "x", "y")).dropDuplicates([*keys, "x", "y"]))
        weights = _nearest(points_k, taken, keys).groupBy(*keys, F.col("near.c").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("w"))
        schema = taken.select(*keys, F.lit(0).cast("long").alias("c"), "x", "y").schema

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("c")
            found = seed_centres(pdf[["x", "y"]].to_numpy(), pdf["w"].to_numpy(), k)
            out = pdf[list(keys)].iloc[[0] * len(found)].reset_index(drop=True)
            return out.assign(c=np.arange(len(found)), x=found[:, 0], y=found[:, 1])[[*keys, "c", "x", "y"]]

        centres = own(taken.join(weights, [*keys, "c"]).groupBy(*keys).applyInPandas(pick, schema))
        open_ = own(spread.select(*keys, "stop"))
        for _ in range(rounds):
            some = points_k.join(small(open_.select(*keys)), list(keys), "left_semi")
            moved = _nearest(some, centres, keys).groupBy(*keys, F.col("near.c").alias("c")).agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"))
            new = own(centres.join(moved, [*keys, "c"], "left").select(*keys, "c", F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"), (F.pow(F.coalesce("_x", "x") - F.col("x"), 2) + F.pow(F.coalesce("_y", "y") - F.col("y"), 2)).alias("m")))
            far = new.groupBy(*keys).agg(F.sum("m").alias("m")).join(open_, list(keys)).where("m > stop").select(*keys, "stop")
            centres, open_ = new.drop("m"), own(far)
            if open_.isEmpty():
                break
        return cut(spark, _nearest(points_k, centres, keys).select(*keys, F.lit(int(k)).alias("k"), "det_id", "x", "y", F.col("near.c").cast("int").alias("label")))
