"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet and rereads it as the next one's documents. All stages but the last
return the columns of documents, whatever others there are and whatever they are
called; the last says where each piece of a document goes.

What awkward rows come to, here and in the stages' operators: an empty table gives
an empty one; rows without an id, a text or a source are rows like others unless a
stage says so; texts are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import jaccard, line_dedup, mixing, packing, quality
from gleaner.llm.shared import ensure_checkpoint_dir, read_table, remove


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither head of the classifier rejects.

    Null and empty texts have the intercept for a score; scores of 0 are kept.
    Repeated rows are judged alike. Without labels of both classes all stay.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the first occurrence of each line only, by document id.

    A document of which nothing is left goes, and so does a repeated row. Null
    texts and those of blank lines stay. ``n_chars`` follows the text. Documents
    without an id come last.
    """
    return line_dedup.drop_repeated_lines(docs, removed=None)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id.

    Rows without an id or a word are in no group and stay; repeated rows of the id
    that stays are all kept.
    """
    return jaccard.keep_one(docs)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities.

    Null sources and languages are values of their own; texts without a token are
    drawn with the overall probability; of repeated rows all or none are drawn.
    """
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, bin_id, position, n_tokens of every piece.

    Texts without a word have no piece; longer ones than a sequence have several.
    Ties in length go by id; repeated rows are packed row by row.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", new_lines),
    ("jaccard_join", one_of_each_group),
    ("mixing", to_target_weights),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    The stages' tables lie in the shared checkpoint folder, each until the next one
    is written; the last one stays, as the result is read from it.
    """
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        at = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs


#: The classifier and best-fit packing are no SQL; a test compares with a brute-force version.
ORACLE_SQL = None
