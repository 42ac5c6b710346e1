"""Overlapping pairs, and greedy suppression of duplicates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions import geometry as G
from sheetwise.operators.components import components
from sheetwise.operators.nearest import small
from sheetwise.runtime import cut, cut_to, forget, remove, shared_dir, ship
from sheetwise.schema import BOX, KEYS


def overlap_pairs(det: DataFrame, metric: str | Callable[[str, str], Column], least: float, strict: bool = False, by: tuple[str, ...] = (), keys: tuple[str, ...] = KEYS, order: str = "ord", cell: float = 64.0) -> DataFrame:
    """Pairs ``(hi, lo)`` of ``order`` values, hi < lo, of boxes on a sheet whose metric reaches ``least``, with ``overlap``.

    Grids have levels, each with cells twice as wide as the one before; the first has cells of ``cell``. A box belongs to the first level whose cells are no smaller than it, where it
    touches four at most, and it visits the coarser levels that any box belongs to. Two boxes meet in an equi-join on the cell, at the coarser of their levels, and count in the cell where
    their overlap begins, so no pair comes twice. ``by`` names columns that must also be equal; ``strict`` asks for more than ``least``.
    """
    measure = G.METRICS[metric] if isinstance(metric, str) else metric
    # Written, as both sides and the levels read it; Spark would estimate the exploded sides too low, hence the hint.
    boxes = cut(det.sparkSession, det.where(G.box_status() == "ok").select(*keys, *by, F.col(order).alias("o"), *BOX).withColumn("own", grid_level(cell)))
    levels = sorted(r.own for r in boxes.select("own").distinct().collect())
    at = lambda edge, size: F.floor(edge / size)
    size = F.lit(cell) * F.expr("shiftleft(1L, level)")

    def dealt(rows: DataFrame, p: str) -> DataFrame:
        rows = rows.withColumn("cell_x", F.explode(F.sequence(at(F.col("left"), size), at(F.col("right"), size)))).withColumn("cell_y", F.explode(F.sequence(at(F.col("top"), size), at(F.col("bottom"), size))))
        return rows.select(*keys, *by, "level", "cell_x", "cell_y", *[F.col(c).alias(p + c) for c in ("o", "own", *BOX)])

    coarser = boxes.withColumn("level", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("own")))) if len(levels) > 1 else boxes.withColumn("level", F.col("own"))
    visitors, owners = dealt(coarser, "a_"), dealt(boxes.withColumn("level", F.col("own")), "b_")
    pairs = visitors.join(owners.hint("merge"), [*keys, *by, "level", "cell_x", "cell_y"]).where("a_own < b_own or a_o < b_o")
    here = (at(F.greatest("a_left", "b_left"), size) == F.col("cell_x")) & (at(F.greatest("a_top", "b_top"), size) == F.col("cell_y"))
    found = pairs.where(here).withColumn("overlap", measure("a_", "b_")).where(F.col("overlap") > least if strict else F.col("overlap") >= least)
    return found.select(*keys, F.least("a_o", "b_o").alias("hi"), F.greatest("a_o", "b_o").alias("lo"), "overlap")


def grid_level(cell: float) -> Column:
    """The level of the grid that a box belongs to: 0 up to ``cell`` pixels, and one more for each doubling."""
    left, top, right, bottom = G.edges()
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(right - left, bottom - top) / cell)).cast("int"))


def rank_by_score(det: DataFrame, score: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``rank``: by score, highest first, then by ``ord``."""
    return det.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), F.col("ord"))).cast("long"))


#: Pairs of a sheet, or of a component of one, that one task goes through.
IN_ONE_TASK = 1_000_000


def greedy(pairs: DataFrame, keys: tuple[str, ...] = KEYS, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """``(keys, rank)`` that greedy suppression drops, from pairs (hi, lo) of ranks.

    What a box drops depends only on boxes that it is linked to through overlaps. So sheets of up to ``in_one_task`` pairs are gone through by rank, each in one task. Larger ones fall into
    connected components of overlapping boxes, each gone through in one task; only components that are larger themselves go in rounds over all tasks. The rows dropped are the same in all three ways.
    """
    spark = pairs.sparkSession
    now = cut(spark, pairs.select(*keys, "hi", "lo"))
    many = lambda df, by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > in_one_task).drop("_n")
    large = cut(spark, many(now, keys))
    if large.isEmpty():
        return walk(now, keys)
    wide = now.join(small(large), list(keys), "left_semi")
    linked = components(wide.select(*keys, F.col("hi").alias("a"), F.col("lo").alias("b")), keys)
    wide = cut(spark, wide.join(linked.withColumnRenamed("node", "hi"), [*keys, "hi"]))
    by = (*keys, "component")
    largest = cut(spark, many(wide, by))
    out = walk(now.join(small(large), list(keys), "left_anti"), keys).unionByName(walk(wide.join(small(largest), list(by), "left_anti"), by).drop("component"))
    return out if largest.isEmpty() else out.unionByName(in_rounds(wide.join(small(largest), list(by), "left_semi"), keys))


def walk(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """What is dropped in each group: pairs are gone through by rank, and a hi that stands drops its lo. A task holds the ranks that one group has dropped so far."""
    ship(pairs.sparkSession)
    schema = pairs.select(*by, F.col("lo").alias("rank")).schema
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dead = None, set()
        for b in batches:
            lost = []
            groups = zip(*(b.column(i).to_pylist() for i in range(n)))
            for i, (group, hi, lo) in enumerate(zip(groups, b.column(n).to_pylist(), b.column(n + 1).to_pylist())):
                if group != now:
                    now, dead = group, set()
                if hi not in dead and lo not in dead:
                    dead.add(lo)
                    lost.append(i)
            rows = b.take(pa.array(lost, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:n], rows.column(n + 1)], names=schema.names)

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select(*by, "hi", "lo").repartition(parts, *by).sortWithinPartitions(*by, "hi", "lo").mapInArrow(run, schema)


def in_rounds(pairs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As :func:`walk`, over all tasks: a round keeps every hi that is nobody's lo and drops what it suppresses.

    The number of rounds is the length of the longest chain of suppressions. What the rounds drop is one growing table, so the result needs one join however many they are.
    """
    spark = pairs.sparkSession
    now, path = cut_to(spark, pairs.select(*keys, "hi", "lo"))
    out = f"{shared_dir(spark)}/sheetwise-{uuid.uuid4().hex}"
    forget(spark, out)
    schema = now.select(*keys, F.col("lo").alias("rank")).schema
    empty = True
    while not now.isEmpty():
        under = now.select(*keys, F.col("lo").alias("hi")).distinct()
        dead = now.join(under, [*keys, "hi"], "left_anti").select(*keys, F.col("lo").alias("rank")).distinct()
        dead.write.mode("append").parquet(out)
        empty = False
        gone = spark.read.schema(schema).parquet(out)
        left = now.join(gone.withColumnRenamed("rank", "lo"), [*keys, "lo"], "left_anti").join(gone.withColumnRenamed("rank", "hi"), [*keys, "hi"], "left_anti")
        new, new_path = cut_to(spark, left.select(*keys, "hi", "lo"))
        remove(spark, path)
        now, path = new, new_path
    return spark.createDataFrame([], schema) if empty else spark.read.schema(schema).parquet(out)


def _without(ranked: DataFrame, dropped: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return ranked.join(dropped, [*keys, "rank"], "left_anti")


def suppress(det: DataFrame, least: float = 0.5, metric: str | Callable[[str, str], Column] = "iou", score: Column | None = None, keys: tuple[str, ...] = KEYS, cell: float = 64.0) -> DataFrame:
    """Greedy suppression over all categories: drops what overlaps a kept, better row by ``least`` or more.

    ``ord`` becomes the place by score, from 0.
    """
    ranked = cut(det.sparkSession, rank_by_score(det, F.col("confidence") if score is None else score, keys))
    kept = _without(ranked, greedy(overlap_pairs(ranked, metric, least, keys=keys, order="rank", cell=cell), keys), keys)
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")).cast("long") - 1).drop("rank")


def suppress_by_class(det: DataFrame, least: float = 0.1, keys: tuple[str, ...] = KEYS, cell: float = 64.0) -> DataFrame:
    """Greedy suppression within a category: drops what overlaps a kept, more confident row by IoU over ``least``. ``ord`` stays."""
    ranked = cut(det.sparkSession, rank_by_score(det, F.col("confidence"), keys))
    return _without(ranked, greedy(overlap_pairs(ranked, "iou", least, True, ("category",), keys, "rank", cell), keys), keys).drop("rank")


def area_times_confidence() -> Column:
    """Score of the reassembly step: larger and surer boxes first."""
    return G.area() * F.col("confidence")
