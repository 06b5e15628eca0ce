"""A training-data pipeline over ``documents``: each stage is one operator of ``arcweave.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.common import Scratch
from arcweave.llm.minhash import without_near_duplicates
from arcweave.llm.mixing import mixed_documents
from arcweave.llm.packing import pack_documents
from arcweave.llm.quality import fit_quality, score_documents
from arcweave.llm.superkmer import substring_dedup

#: A document goes if the quality network gives it less than this.
LEAST_SCORE = 0.5
#: Words of a passage that is cut if it occurs twice.
PASSAGE = 35


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network, fitted on the labelled ones, does not reject.

    Each row is judged by its text alone: null and empty texts as no bytes, equal texts
    alike, rows with one id or a null id each for itself.  With labels of one kind, or
    none that match, every score is the share of label 1, smoothed by one of each kind,
    so without any nothing goes.  An empty table stays empty.
    """
    net = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, net, score_col="__score").filter(F.col("__score") >= LEAST_SCORE).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8), that with the least id.

    Equal rows become one; rows of one id with different texts are judged by their own.
    Rows without words, or with a null id, stay.  An empty table stays empty.
    """
    return without_near_duplicates(docs, k=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere; those of which nothing is left go.

    All copies of a passage are cut, also within a document and from equal rows;
    ``n_chars`` follows the text.  Rows without words stay (a null text as an empty one).  Ids may repeat
    or be null.  An empty table stays empty.
    """
    # Under names of their own, so that no column of the table meets one that the operator adds.
    at = {c: f"col{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*at.values())
    cut = substring_dedup(rows, k=PASSAGE, id_col=at["doc_id"], text_col=at["text"], carry_text=False).filter("n_removed = 0 or n_removed < n_words")
    cut = cut.withColumnRenamed("kept_text", at["text"])
    if "n_chars" in at:
        n = F.col(at["n_chars"])
        cut = cut.withColumn(at["n_chars"], F.when(F.col("n_removed") > 0, F.char_length(at["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(n))
    return cut.select(*at.values()).toDF(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights: one row a repetition, documents taken in part cut.

    A null source is a source of its own.  Rows without words are in no mix; ties in the
    seeded order go by id, size and text.  An empty table stays empty.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in bins of a fixed number of words.

    Every row is packed, repetitions each for itself (as copies, in different bins);
    null ids are kept.  An empty table gives an empty result.
    """
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substrings", substrings), ("mixing", mixing), ("packing", packing)]

#: A trained network and a best-fit heuristic take part: SQL cannot say it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
