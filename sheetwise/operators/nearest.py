"""Nearest-neighbour and interval joins between detections and small reference tables.

Distances and places are compared at a stated precision (:func:`geometry.stated`), so that a tie is one however its coordinates were computed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions import geometry as G
from sheetwise.operators.boxes import normalize_center
from sheetwise.runtime import cut
from sheetwise.schema import KEYS

#: Largest distance between a digit and the box it fills, in normalised coordinates (a fixed value).
DIGIT_RADIUS = 0.0174507 / 2
#: Reference rows up to this many are broadcast.
BROADCAST_ROWS = 20_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough, by count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _distance() -> Column:
    """From a detection's to a centroid's centre, both of 0..1."""
    return F.sqrt(F.pow(F.col("nx") - F.col("cx"), 2) + F.pow(F.col("ny") - F.col("cy"), 2))


def nearest_per_target(det: DataFrame, centroids: DataFrame, width: Column, height: Column, radius: float = DIGIT_RADIUS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """For each sheet and centroid (form, name, cx, cy) the nearest detection within ``radius``; one may serve many centroids.

    Centroids are dealt to their grid cell and the eight around it, so an equi-join on form and cell finds all that are near enough.
    """
    cell = lambda c: F.floor(c / radius).cast("long")
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    targets = centroids.select("form", "name", "cx", "cy").withColumn("cell_x", F.explode(F.transform(near, lambda i: cell(F.col("cx")) + i))).withColumn("cell_y", F.explode(F.transform(near, lambda i: cell(F.col("cy")) + i)))
    points = normalize_center(det, width, height).withColumns({"cell_x": cell(F.col("nx")), "cell_y": cell(F.col("ny"))})
    met = points.join(small(targets), ["form", "cell_x", "cell_y"]).withColumn("dist", _distance()).where(F.col("dist") < radius)
    best = met.groupBy(*keys, "form", "name").agg(F.min_by(F.struct("category", "det_id", "ord", "dist"), F.struct(G.stated(F.col("dist"), 10).alias("d"), "ord")).alias("d"))
    return best.select(*keys, "form", "name", "d.category", "d.det_id", "d.dist")


def nearest_centroid(det: DataFrame, centroids: DataFrame, width: Column, height: Column, max_dist: float | None = None, keys: tuple[str, ...] = KEYS, most: int = BROADCAST_ROWS) -> DataFrame:
    """For each detection the nearest centroid of its form, whatever the distance unless ``max_dist`` is given; of equally near ones the first by name.

    Up to ``most`` centroids are broadcast as one list for each form, so that no row is multiplied; more are searched on a grid (:func:`nearest_on_grid`). Repeated detections stay repeated.
    """
    places, points = centroids.select("form", "name", "cx", "cy"), normalize_center(det, width, height)
    if places.limit(most + 1).count() <= most:
        lists = F.broadcast(places.groupBy("form").agg(F.collect_list(F.struct("name", "cx", "cy")).alias("_places")))
        dist = lambda c: F.sqrt(F.pow(F.col("nx") - c["cx"], 2) + F.pow(F.col("ny") - c["cy"], 2))
        first = lambda some: F.array_min(F.transform(some, lambda c: F.struct(G.stated(dist(c), 10).alias("d"), c["name"].alias("name"), dist(c).alias("dist"))))
        best = points.join(lists, "form").withColumn("n", _close("_places", dist, first, places=10))
    else:
        spark = det.sparkSession
        rows = cut(spark, points.select(*keys, "form", "det_id", "ord", "category", "nx", "ny").withColumn("_row", F.monotonically_increasing_id()))
        best = rows.join(nearest_on_grid(rows, places), "_row")
    found = best.select(*keys, "form", "det_id", "ord", "category", "n.name", "n.dist")
    return found if max_dist is None else found.where(F.col("dist") < max_dist)


#: Centroids that a cell of a form's finest grid has on average, and by how much distances of equal stated precision may differ.
IN_CELL, SLACK = 2, 1e-9


def nearest_on_grid(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``(_row, n)``: the nearest place of each row's form, for any number of places; ``rows`` have ``_row, form, nx, ny``.

    Each form has a square grid with about ``IN_CELL`` places a cell, and coarser ones of twice the side each, up to one cell. A row first meets the places of its cell and the eight around it; if the
    best is nearer than any other cell can be, that is all. The others go down from the coarsest grid: of the cells with a place they keep those that are no farther than the place that some kept cell must hold,
    then take their quarters. So a row meets few cells on each grid, wherever it lies and however the places are spread.
    """
    spark = rows.sparkSession
    form = places.groupBy("form").agg(F.min("cx").alias("x0"), F.min("cy").alias("y0"), F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).alias("side"), F.count(F.lit(1)).alias("_n"))
    levels = F.greatest(F.lit(0), F.ceil(F.log2(F.sqrt(F.col("_n") / IN_CELL)))).cast("int")
    form = cut(spark, form.withColumns({"levels": levels, "side": F.when(F.col("side") > 0, F.col("side")).otherwise(1.0)}).withColumn("cell", F.col("side") / F.pow(F.lit(2.0), F.col("levels"))).drop("_n"))
    last = F.pow(F.lit(2.0), F.col("levels")).cast("long") - 1
    index = lambda c, c0: F.least(F.floor((F.col(c) - F.col(c0)) / F.col("cell")), last)
    leaves = cut(spark, places.join(small(form), "form").select("form", "name", "cx", "cy", "levels", index("cx", "x0").alias("ix"), index("cy", "y0").alias("iy")))
    at = rows.select("_row", "form", "nx", "ny").join(small(form), "form")
    best = F.min_by(F.struct("name", "dist"), F.struct(G.stated(F.col("dist"), 10).alias("d"), "name")).alias("n")
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = at
    for i, c, c0 in (("ix", "nx", "x0"), ("iy", "ny", "y0")):
        own = F.floor((F.col(c) - F.col(c0)) / F.col("cell"))
        around = around.withColumn(i, F.explode(F.filter(F.transform(near, lambda d: own + d), lambda v: v.between(0, last))))
    first = around.join(leaves.select("form", "ix", "iy", "name", "cx", "cy"), ["form", "ix", "iy"]).withColumn("dist", _distance()).groupBy("_row").agg(best, F.first("cell").alias("cell"))
    done = cut(spark, first.where(F.col("n.dist") < F.col("cell") - SLACK).select("_row", "n"))
    # Cells with a place on every grid, by the cell of the coarser grid that holds them.
    cells = leaves.select("form", F.explode(F.sequence(F.lit(0), F.col("levels"))).alias("level"), "levels", "ix", "iy")
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("levels") - F.col("level"))).cast("long")
    cells = cut(spark, cells.select("form", "level", up("ix").alias("ix"), up("iy").alias("iy")).distinct())
    deepest = form.agg(F.max("levels")).first()[0] or 0
    kept = at.join(done, "_row", "left_anti").withColumns({"ix": F.lit(0).cast("long"), "iy": F.lit(0).cast("long")})
    for level in range(1, deepest + 1):
        deeper = cells.where(F.col("level") == level).select("form", F.expr("ix div 2").alias("ix"), F.expr("iy div 2").alias("iy"), F.col("ix").alias("jx"), F.col("iy").alias("jy"))
        grown = kept.where(F.col("levels") >= level).join(deeper, ["form", "ix", "iy"])
        size = F.col("side") / float(2**level)
        low = {c: F.col(c0) + F.col(j) * size for c, c0, j in (("nx", "x0", "jx"), ("ny", "y0", "jy"))}
        gap = lambda c: F.greatest(F.lit(0.0), low[c] - F.col(c), F.col(c) - low[c] - size)
        far = lambda c: F.greatest(F.abs(low[c] - F.col(c)), F.abs(low[c] + size - F.col(c)))
        span = lambda f: F.sqrt(F.pow(f("nx"), 2) + F.pow(f("ny"), 2))
        grown = grown.withColumns({"_gap": span(gap), "_far": span(far)}).withColumn("_least", F.min("_far").over(Window.partitionBy("_row")))
        fewer = grown.where(F.col("_gap") <= F.col("_least") + SLACK).drop("ix", "iy", "_gap", "_far", "_least").withColumnsRenamed({"jx": "ix", "jy": "iy"})
        kept = cut(spark, fewer.unionByName(kept.where(F.col("levels") < level)))
    rest = kept.join(leaves.select("form", "ix", "iy", "name", "cx", "cy"), ["form", "ix", "iy"]).withColumn("dist", _distance()).groupBy("_row").agg(best)
    return done.unionByName(rest)


def _labels(legend: DataFrame, place: str, label: str, keys: tuple[str, ...]) -> DataFrame:
    """The labels of each sheet as one array by their places, with the steps of a search by halving and whether all have a place; a printed legend has some dozens."""
    at = F.col(place).cast("double")
    rows = legend.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(at.alias("place"), F.col(label).alias("label")))).alias("_labels"), F.coalesce(F.bool_and(at.isNotNull() & ~F.isnan(at)), F.lit(False)).alias("_whole"))
    halves = F.transform(F.sequence(F.ceil(F.log2(F.size("_labels") + 1.0)).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2.0), i).cast("int"))
    return rows.withColumn("_steps", halves)


def _from_at(x: Column) -> Column:
    return F.abs(x["place"] - F.col("_at"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once: Spark would put a column's expression into each of its uses, also into the test of every item of an array."""
    return F.transform(F.array(value), f)[0]


def _close(items: str | Column, dist: Callable[[Column], Column], f: Callable[[Column], Column], k: int = 1, places: int = 6) -> Column:
    """``f`` of the items that can be among the first ``k`` by their distance at a precision of ``places``: those near enough unrounded, and those without a distance. Rounding is dear, so few items should get there."""
    far = F.transform(items, dist)
    bound = F.array_min(far) if k == 1 else F.try_element_at(F.sort_array(far), F.lit(k))
    return _let(bound, lambda m: f(F.filter(items, lambda x: F.coalesce(dist(x) <= m + 2 * 10.0**-places, F.lit(True)))))


#: Labels on either side of a point's place that are looked at first.
SIDES_OF = 2
#: Up to so many labels are all compared, which costs less than a search among them.
FEW = 16


def _around(f: Callable[[Column], Column], k: int = 1) -> Column:
    """:func:`_close` of a row's ``_labels``, found by halving: the labels next to ``_at``, or all of them if they are few, if more can be as near, or if places or ``_at`` are missing."""
    at, labels, n = F.col("_at"), F.col("_labels"), F.size("_labels")
    place = lambda i: F.get(labels, i)["place"]
    before = F.aggregate("_steps", F.lit(0), lambda p, step: F.when((p + step <= n) & (place(p + step - 1) < at), p + step).otherwise(p))
    every = _close("_labels", _from_at, f, k)

    def some(first: Column) -> Column:
        last = first + 2 * SIDES_OF + 1
        few = F.slice(labels, first + 1, F.lit(2 * SIDES_OF + 1))
        far = F.transform(few, _from_at)
        bound = F.array_min(far) if k == 1 else F.try_element_at(F.sort_array(far), F.lit(k))

        def known(m: Column) -> Column:
            m = m + 2e-6
            alone = ((first == 0) | (at - place(first - 1) > m)) & ((last >= n) | (place(last) - at > m))
            return F.when(alone, f(F.filter(few, lambda x: _from_at(x) <= m))).otherwise(every)

        return _let(bound, known)

    return F.when(n <= FEW, f(labels)).when(F.col("_whole") & at.isNotNull() & ~F.isnan(at), _let(F.greatest(before - SIDES_OF, F.lit(0)), some)).otherwise(every)


def nearest_label_1d(points: DataFrame, legend: DataFrame, at: Column, place: str, label: str = "label", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds the label whose ``place`` is closest to ``at``; sheets without labels give no rows."""
    met = points.withColumn("_at", at.cast("double")).join(_labels(legend, place, label, keys), list(keys))
    first = lambda some: F.array_min(F.transform(some, lambda x: F.struct(G.stated(_from_at(x)).alias("d"), x["place"].alias("place"), x["label"].alias("label"))))
    return met.select(*points.columns, _around(first)["label"].alias(label))


def two_nearest_1d(points: DataFrame, legend: DataFrame, at: Column, place: str, value: str = "value", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds value and place of the closest and second-closest legend value; points with fewer than two give no rows."""
    met = points.withColumn("_at", at.cast("double")).join(_labels(legend, place, value, keys), list(keys)).where(F.size("_labels") >= 2)
    first = lambda some: F.slice(F.array_sort(F.transform(some, lambda x: F.struct(G.stated(_from_at(x)).alias("d"), x["label"].alias("v"), x["place"].alias("p")))), 1, 2)
    two = met.withColumn("_two", _around(first, 2))
    return two.select(*points.columns, *[F.col("_two")[i][c].alias(f"{c}{i + 1}") for i in (0, 1) for c in "vp"])


def in_intervals(points: DataFrame, intervals: DataFrame, at: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each point with the intervals (``lo``, ``hi``, ends excluded) of its sheet that hold it."""
    met = points.withColumn("_at", G.stated(at)).join(intervals, list(keys))
    return met.where((G.stated(F.col("lo")) < F.col("_at")) & (F.col("_at") < G.stated(F.col("hi")))).drop("_at")


def names_with(centroids: DataFrame, keyword: str) -> DataFrame:
    """Centroids whose name contains a keyword."""
    return centroids.where(F.contains(F.col("name"), F.lit(keyword)))


def relevant_boxes(det: DataFrame, centroids: DataFrame, keyword: str, width: Column, height: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Digits of the boxes whose name contains a keyword."""
    return nearest_per_target(det, names_with(centroids, keyword), width, height, keys=keys)
