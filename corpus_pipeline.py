"""Documents to token ids: toxic ones go, repeated lines and near copies go, test items go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before
kept; its result is written as Parquet in the shared folder and read again. All but
the last return the columns of documents; n_chars follows text where a stage
changes it. Null and empty texts pass every stage (near duplicates: one of them
stays); an empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix.llm import bpe, common, decontaminate, linededup, nearcopies, toxicity

#: The similarity stage takes five words to a shingle; documents are near copies from that Jaccard similarity of their shingle sets on.
SHINGLE, SHARE = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is at the cut or above; learned from the labels outside the held-out part."""
    labels = common.table(spark, sf_dir, "labels").where(common.id_mod("doc_id", 4) != 2)
    return toxicity.score(docs, toxicity.fit(docs, labels), "_score").where(F.col("_score") < toxicity.CUT).drop("_score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later repeats of runs of lines; documents that lose all their words that way go."""
    return linededup.dedup_lines(docs, drop_emptied=True, length_col="n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least id."""
    return nearcopies.one_of_each(docs, shingle=SHINGLE, share=SHARE)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a test item."""
    return decontaminate.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With token ids, their number, and the hashes of ids and decoded text."""
    return bpe.encode(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("encoding", encode)]

#: Classifier, winnowing and merges are not for SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
