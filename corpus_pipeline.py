"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.llm import decontaminate, linededup, minhash, pieces, toxicity
from vigia.llm.storage import new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; the model learns from the input's labels.

    Null and empty texts score near 0 and stay; rows with a null id are scored like others; repeated rows stay or go together.  The score stands in a
    column of a free name, so that all of the input's columns come out as they are.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = linededup.free_names(docs.columns, "toxicity_score")
    scored = toxicity.score_toxicity(docs, model, score)
    return scored.where(scored[score] < toxicity.THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the line windows that an earlier one (or an earlier place) holds.

    A null text stays null; a null id comes before all others; rows that repeat an id are ordered by their texts' hash.  The counts of lines stand in
    columns of free names, so that all of the input's other columns come out as they are.
    """
    counts = linededup.free_names(docs.columns, "n_lines", "n_removed")
    return linededup.remove_repeated_lines(docs, counts=tuple(counts)).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates; rows that repeat its id stay with it.

    Texts without words, null ones included, and rows with a null id are near to nothing and stay.
    """
    gone = minhash.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and a null id changes nothing."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, text``: the pieces of each document and the text decoded from them; a null text has no pieces and is read back empty."""
    return pieces.round_trip(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", drop_contaminated), ("pieces", encode_pieces)]

#: Toxicity scores and sampled merges are no SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; an empty table passes through as one, other columns stay until the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
