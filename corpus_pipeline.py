"""A training corpus from raw documents: five stages, each an operator of lodestrata.llm over all that its predecessor kept.

For all stages: an empty table gives an empty result, columns other than those of documents are ignored, texts are taken
whole however long. What each does with null texts, null or repeated ids and ties is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common, jaccard_join, language_id, line_dedup, mixing, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Fitted models, rolling hashes and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go; ``lang`` becomes the predicted language.

    Null texts and texts without letters are rejected; repeated rows and ids are judged one by one; a null ``lang`` isn't
    learned from.
    """
    common.prepare(spark)
    found = language_id.identify(docs.select(*COLUMNS)).where(~F.col("rejected"))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated runs of two lines or more go from the texts; a document that loses all its lines goes.

    Chunks that a rolling hash over the lines cuts are matched first and then extended line by line to whole runs.
    The smallest id keeps a run, null ids come last, and rows that share the smallest id all keep it. A null text stays null.
    """
    common.prepare(spark)
    left = line_dedup.run_dedup(docs.select(*COLUMNS))
    left = left.where((F.col("n_removed") == 0) | F.col("text").rlike(common.WORD))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates the document with the smallest id stays.

    Of rows that repeat that id one stays; groups of null ids only stay whole; documents without words are no duplicates.
    """
    common.prepare(spark)
    return jaccard_join.near_dedup(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row for every copy that the mixture takes, in training order.

    Null sources are one source; documents without words, null texts among them, are never taken; equal positions are
    ordered by copy and id.
    """
    return mixing.curriculum(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: a row for every piece, with its sequence and offset.

    A null text is an empty one, of one token; repeated rows and null ids are documents of their own.
    """
    common.prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.durable(docs)
    return docs
