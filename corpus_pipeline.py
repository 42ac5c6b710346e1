"""A corpus pipeline of five stages; each works on all that the one before kept.

Texts that are null, empty or without letters go in the first stage; long ones are worked on whole. Null sources, languages and ids are groups of their own in
mixing; extra columns pass through all stages but the last; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm import fm_index, lang_bloom, near_texts, queries
from sheetwise.runtime import cut

#: A document is rejected if it has no letters, or if its language holds less than this share of its n-grams.
MIN_COVERAGE = 0.3


def _row():
    return F.struct("*").alias("_row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language. The filters are learned from the stage's own rows that have a label."""
    found = lang_bloom.identify_language(docs, queries.language_model(docs), [_row()])
    return found.where((F.col("lang_pred") != lang_bloom.UND) & (F.col("coverage") >= MIN_COVERAGE)).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8 or more), and of its repeated rows (same id and text) one.

    Rows without an id stay: no component is named after them.
    """
    kept = near_texts.near_duplicate_texts(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.join(kept.hint("merge"), docs["doc_id"] == kept["_kept"], "left_semi")
    # The join has dealt the rows by id already, so this adds no shuffle.
    return named.dropDuplicates(["doc_id", "text"]).union(docs.where(docs["doc_id"].isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark phrase occurs."""
    found = fm_index.find_contamination(docs, queries.table(spark, sf_dir, "benchmark"), [_row()])
    return found.where(F.size("spans") == 0).select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each source, the documents that its budget takes."""
    return queries.mixed(docs, queries.PIPELINE_MIX).select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left and reads it back from the token store."""
    return queries.tokens_of(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder before the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(spark, docs)
    return docs


#: Learned language filters, bit distances over words and byte-level BPE have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None
