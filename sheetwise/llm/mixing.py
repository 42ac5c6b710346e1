"""Mixing sources to target weights by hierarchical budgeting over a domain - language - source tree.

A token budget goes from the root to the leaves. At each node it is shared among the children by weight; a child whose subtree
cannot supply its share (its tokens times ``max_epochs``) gives what it has, and the shortage goes to its siblings by
their weights. As a node is never given more than its subtree can supply, a shortage reaches the next ancestor's other
children only when all siblings are used up. Shares are rounded down to whole tokens.

A leaf takes its budget as whole epochs of all its documents, and of the next epoch a token-prefix: documents in the order
of a seeded hash of epoch, id and text, up to the last that still fits. The place where a leaf's prefix ends is found from sums over
256 hash buckets, then over the 256 within one of them, so only the places of one bucket of each leaf (1 in 65,536) are ever sorted, and rows are then
selected by comparing their own hash with that place, without a join on ids. Rows with equal id and text share a place and are summed before sorting. Where
the prefix ends within such a place, as many of its rows are taken as fit, in the order of a hash of the whole row; rows that are equal in all columns are interchangeable there, so one stands for them with
the number that is taken, and none has to be numbered.

Tokens are runs of characters other than space and \\t-\\r.

Edge cases: a null text has no tokens, and a document without tokens is taken with the prefix it falls in. A null language or source
is the leaf ``und``. Rows with the same id or without one are documents of their own; a null id sorts as
the text ``null`` and a null text as an empty one; a very long text is counted and hashed whole. Siblings with equal
capacity per weight are taken by name. Weights are whole numbers from 0; names without one have the default 1; a node of weight 0 gets nothing. An
empty table gives an empty one. Columns of the input never clash with the operator's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.runtime import cut

TOKEN = "[^\\x20\\x09-\\x0D]+"
LEVELS = ("domain", "language", "origin")
#: Leaves up to this many are broadcast; more are joined by a shuffle.
BROADCAST_LEAVES = 50_000


@dataclass
class Mix:
    """Target weights of each level by name, and the budget as ``numerator / denominator`` of all tokens."""

    domains: dict[str, int] = field(default_factory=dict)
    languages: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    numerator: int = 1
    denominator: int = 2
    max_epochs: int = 1
    seed: int = 17

    def weights(self) -> list[dict[str, int]]:
        return [self.domains, self.languages, self.sources]


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    w = F.lit(1).cast("long")
    for k, v in sorted(weights.items()):
        w = F.when(name == k, F.lit(v).cast("long")).otherwise(w)
    return w


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def turn(seed: int, epoch: Column, doc_id: Column, text_md5: Column) -> Column:
    """Place of a document in an epoch's order: a hash of its id and text, then the id."""
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.concat_ws("-", F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), name, text_md5)), name)


def share_out(nodes: DataFrame, parent: list[str], budget: str = "budget", capacity: str = "capacity", weight: str = "weight") -> DataFrame:
    """Adds ``given`` to ``nodes``: the parent's budget shared by weight, with what full nodes leave over.

    Children are taken by capacity per weight, ascending; one is full if its share of what is left exceeds its capacity, and so
    is every child before it. The others share what is then left.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("_fill").asc_nulls_last(), "_name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parent)
    d = "decimal(38,0)"
    out = (
        nodes.withColumn("_name", F.concat_ws("\u0001", *[F.col(c) for c in nodes.columns if c in LEVELS]))
        .withColumn("_fill", F.try_divide(F.col(capacity).cast("double"), F.col(weight).cast("double")))
        .withColumn("_left", F.col(budget) - F.coalesce(F.sum(capacity).over(before), F.lit(0)))
        .withColumn("_weights", F.sum(weight).over(every) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
        .withColumn("_full", F.col(capacity).cast("decimal(20,0)") * F.col("_weights").cast("decimal(18,0)") <= F.col("_left").cast("decimal(20,0)") * F.col(weight).cast("decimal(18,0)"))
        .withColumn("_rest", F.col(budget) - F.coalesce(F.sum(F.when(F.col("_full"), F.col(capacity))).over(every), F.lit(0)))
        .withColumn("_open", F.coalesce(F.sum(F.when(~F.col("_full"), F.col(weight))).over(every), F.lit(0)))
    )
    part = F.expr(f"(cast(_rest as {d}) * cast({weight} as decimal(18,0))) div nullif(_open, 0)")
    return out.withColumn("given", F.when(F.col("_full"), F.col(capacity)).otherwise(F.coalesce(part, F.lit(0))).cast("long")).drop("_name", "_fill", "_left", "_weights", "_full", "_rest", "_open")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (domain, language, origin, tokens) with ``capacity`` and ``budget``."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    total = leaves.agg(F.expr(f"cast((cast(coalesce(sum(tokens), 0) as decimal(38,0)) * {int(mix.numerator)}) div {int(mix.denominator)} as long)").alias("wanted"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("all"))
    budgets = total.select(F.least("wanted", "all").alias("budget"))
    for depth, weights in enumerate(mix.weights(), 1):
        path = list(LEVELS[:depth])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(F.col(path[-1]), weights))
        nodes = nodes.crossJoin(F.broadcast(budgets)) if depth == 1 else nodes.join(budgets, path[:-1])
        budgets = share_out(nodes, path[:-1]).select(*path, F.col("given").alias("budget"))
    return leaves.join(budgets, list(LEVELS))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_LEAVES else df


def first_beyond(rows: DataFrame, digits: int) -> DataFrame:
    """``(domain, language, origin, bucket, before)``: of each leaf, the first hash bucket of so many digits with which ``before`` and the buckets' tokens exceed ``rest``; ``before`` then counts those ahead of it."""
    by = rows.groupBy(*LEVELS, "rest", "before", F.substring("place", 1, digits).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
    running = F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    beyond = by.withColumn("upto", running).where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("x"))
    return beyond.select(*LEVELS, "x.bucket", "x.before")


def mix_sources(docs: DataFrame, mix: Mix, domain: Column, language: Column, source: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Selected rows as ``_row`` (a struct of all input columns) with domain, language, origin, n_tokens and epoch.

    A row is there once for each epoch that takes it.
    """
    spark = docs.sparkSession
    tagged = docs.select(
        F.struct("*").alias("_row"),
        F.coalesce(domain, F.lit("und")).alias("domain"), F.coalesce(language, F.lit("und")).alias("language"), F.coalesce(source, F.lit("und")).alias("origin"),
        token_count(F.col(text)).alias("n_tokens"), F.col(doc_id).alias("_id"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_text"),
    )
    slim = cut(spark, tagged.drop("_row"))
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, mix).withColumn("epochs", F.coalesce(F.expr("budget div nullif(tokens, 0)"), F.lit(0)).cast("int"))
    plan = cut(spark, plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")))
    place = turn(mix.seed, F.col("epochs"), F.col("_id"), F.col("_text"))
    wanting = slim.join(_small(plan.where("rest > 0")), list(LEVELS)).withColumns({"place": place, "before": F.lit(0).cast("long")})
    coarse = cut(spark, first_beyond(wanting, 2))
    near = wanting.drop("before").join(_small(coarse), list(LEVELS)).where(F.substring("place", 1, 2) == F.col("bucket")).drop("bucket")
    last = cut(spark, first_beyond(near, 4))
    inside = wanting.drop("before").join(_small(last), list(LEVELS)).where(F.substring("place", 1, 4) == F.col("bucket"))
    # Rows that share a place are one row here: its tokens, and how many rows.
    places = inside.groupBy(*LEVELS, "rest", "before", "place").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("each"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("place"))
    found = places.withColumn("upto", upto).groupBy(*LEVELS).agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))).alias("fits"),
        F.min(F.when(F.col("upto") > F.col("rest"), F.struct("place", F.expr("(rest - upto + n) div each").alias("room")))).alias("next"),
    )
    last = last.select(*LEVELS, F.col("bucket").alias("last_bucket"))
    ends = cut(spark, plan.join(last, list(LEVELS), "left").join(found, list(LEVELS), "left").select(
        *LEVELS, "epochs", "rest",
        # Without a last bucket, all that is left fits; without a document that fits in it, the prefix ends before the bucket.
        F.when(F.col("last_bucket").isNull(), F.lit("g")).otherwise(F.coalesce("fits", "last_bucket")).alias("ends"), F.when(F.col("next.room") > 0, F.col("next.place")).alias("within"), F.col("next.room").alias("room"),
    ))
    row = tagged.join(_small(ends), list(LEVELS)).withColumn("_place", place)
    partial = (F.col("rest") > 0) & (F.col("_place") <= F.col("ends"))
    times = F.col("epochs") + F.when(partial, 1).otherwise(0)
    taken = row.where(times > 0).select("_row", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch"))
    if ends.where("within is not null").isEmpty():
        return taken
    # Of the rows that share the place where a prefix ends, those that fit: equal rows are counted, the others ordered by a hash of all they hold.
    same = row.where(F.col("_place") == F.col("within")).groupBy(*LEVELS, "n_tokens", "epochs", "room", F.sha2(F.to_json("_row"), 256).alias("_hash")).agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*LEVELS).orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = same.withColumn("_take", F.least("_n", F.col("room") - ahead)).where("_take > 0")
    return taken.unionByName(some.select("_row", *LEVELS, "n_tokens", F.col("epochs").alias("epoch"), F.explode(F.sequence(F.lit(1).cast("long"), "_take")).alias("_i")).drop("_i"))
