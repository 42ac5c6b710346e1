"""Exact deduplication against a persistent digest index, bucketed and sorted by hash.

The index is a Parquet table ``(digest, keep_id)`` clustered and sorted by digest. New documents are grouped by
the SHA-256 of their normalised text, a sort-merge anti-join finds the digests that the index lacks, and those are
appended. The index side of that join needs no shuffle, as its buckets are the join's partitions. An append that
is lost with its driver can be repeated: what was committed is found again by the anti-join. Each append adds a sorted file to every bucket; :meth:`DigestIndex.compact` makes them
one file each again, so that a bucket is sorted as a whole.

Edge cases: null text counts as empty; a very long text is hashed whole. Bytes that are no UTF-8 are hashed as they are. No two ids can tie: of equal ids, all
rows are kept. Rows with a null id are grouped too; a group of null ids only has a null
``keep_id``, and none of its rows is kept. Repeated rows (same id, same text) have the same result each, and count
each towards ``group_size``. Empty tables append nothing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.runtime import cut

#: White space that normalisation turns into one space.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text after each run of white space has become one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " "), 256)


class DigestIndex:
    """A digest index in table ``name``; with ``path``, the table is external and outlives the session's catalog.

    ``buckets`` must be the same each time an existing index is opened; another number is an error.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, path: str | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets
        where = f"LOCATION '{path}'" if path else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS {where}"
        )
        has = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}.get("Num Buckets")
        if has != str(int(buckets)):
            raise ValueError(f"index {name} has {has} buckets, not {buckets}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the index; with a ``path`` its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def compact(self) -> None:
        """Rewrite each bucket as one sorted file, from a copy in the shared folder that stays until the application ends."""
        held = cut(self.spark, self.rows())
        held.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name, overwrite=True)

    def append_new(self, groups: DataFrame) -> None:
        """Append the rows of ``groups`` (digest, keep_id; each digest once) whose digest the index lacks."""
        fresh = groups.select("digest", "keep_id").join(self.rows().hint("merge"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append the digests of ``docs`` that the index lacks; returns ``(doc_id, digest)`` of each row, written."""
        rows = cut(self.spark, docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest")))
        # Written, as Spark would else join before it groups, and all rows of a hot digest would meet in one task.
        self.append_new(cut(self.spark, rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))))
        return rows

    def deduplicate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add ``docs`` to the index; returns a row per document.

        Columns: ``doc_id, keep_id, group_size, kept, text_sha256``. ``keep_id`` is the id that the index holds for the
        text: that of an earlier batch, else the smallest of this one. ``group_size`` counts the rows of this batch.
        """
        rows = self.add(docs, id_col, text_col)
        groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        # Written, so that Spark shuffles both sides of the last join and can split a digest with a large part of all rows.
        known = cut(self.spark, groups.select("digest", "group_size").join(self.rows().hint("merge"), "digest"))
        return rows.join(known.hint("merge"), "digest").select(
            "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256")
        )

    def over_batches(self, *added: DataFrame) -> DataFrame:
        """As :meth:`deduplicate`, for what :meth:`add` returned for several batches of one corpus, as if they had been one.

        The smallest id of all of a group's rows and of the index stays, and ``group_size`` counts all rows.
        """
        every = added[0]
        for rows in added[1:]:
            every = every.unionByName(rows)
        groups = every.groupBy("digest").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("group_size"))
        known = groups.join(self.rows().hint("merge"), "digest").select("digest", "group_size", F.least("keep_id", "_least").alias("keep_id"))
        known = cut(self.spark, known)
        kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
        return every.join(known.hint("merge"), "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))
