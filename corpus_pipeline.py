"""From raw documents to a training mix: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents, the
last one what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from percepta.llm import decontaminate, line_dedup, minhash, mixing, toxicity
from percepta.shared import fresh_path

#: The toxicity model, the duplicates' representatives and the windows are learned or hashed: SQL can't express run().
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, as they are.

    Null and empty texts have no toxic segment and stay, unless all labelled documents are toxic; texts of any length are
    scored whole. Equal texts and repeated rows score alike; null or repeated ids are rows like any other. An empty
    table stays empty; extra columns stay, whatever their names.
    """
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxic_apart(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; all stay, also those of which nothing is left.

    n_chars is counted again where lines went. Null texts stay null, null sources are a source of their own, repeated rows all stay; an
    empty table stays empty; extra columns stay, but n_lines and n_dropped are the stage's own and go.
    """
    cleaned = line_dedup.drop_boilerplate_lines(docs)
    cut = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", cut).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id: five-word shingles, similarity 0.8.

    Null and empty texts link with nothing and stay; of repeated rows one stays; unrelated texts stay under null or equal ids. Long
    texts count whole; an empty table stays empty; extra columns stay, whatever their names.
    """
    return minhash.one_of_each(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item, as they are.

    Null and empty texts and items match nothing; long texts are searched whole; repeated rows stay or go together; null ids are rows like
    any other; without documents or items nothing goes. Extra columns stay, whatever their names.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, by source targets; a row for each row of docs.

    Null and empty texts have size 0; null sources are a source, the last one; repeated rows tie and are taken by their
    sizes; an empty table stays empty; extra columns go.
    """
    return mixing.mix(docs, share=1.5, weights=(3.0, 1.0, 2.0), most_epochs=2)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("minhash_near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("mix_sources", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
