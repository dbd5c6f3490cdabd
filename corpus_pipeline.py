"""From raw documents to token ids, one written table per stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesmend.llm import cuckoo, minhash, mixing, pieces, quality
from seriesmend.plans.staging import delete_folder, shared_folder, staging_scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host isn't condemned.

    A null text has no words and goes; a null source is a host of its own; repeated rows
    are judged alike.  Long texts are read whole.  Empty tables and other columns pass.
    """
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose texts differ in white space at most.

    The one with the longest text stays, of equals the smallest doc_id, null last; a null
    text counts as empty.  Empty tables and other columns pass.
    """
    return cuckoo.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, that of the smallest doc_id.

    Documents without words are duplicates of none.  A group without doc_ids keeps one row.
    Empty tables and other columns pass.
    """
    return minhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one cut per source ends its budget.

    Null sources are a source of their own, a null or empty text has no words and is not
    taken; equal or null doc_ids are ordered by a hash of the text; repeated rows are taken
    one by one.  An empty table gives an empty one.  Other columns are kept.
    """
    return mixing.taken_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text, and whether they decode to it.

    A null or empty text has no ids; repeated rows stay; other columns end here.
    """
    encoded = pieces.encode_checked(docs.select("doc_id", "lang", "source", "text"))
    return encoded.withColumn("n_ids", F.size("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("SentencePiece ids", piece_ids),
]

# the last stage's token ids cannot be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again.

    What a stage has staged, and the stage before it, is deleted once it is written.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, step) in enumerate(STAGES):
        with staging_scope(spark):
            step(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            delete_folder(spark, f"{folder}/{n - 1}")
    return docs
