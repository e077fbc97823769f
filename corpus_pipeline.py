"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, source mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; ``run`` writes each stage's rows
as Parquet into the shared folder and reads them again for the next. All stages but the last return the columns of
documents; the last adds size, source_size, target and taken, and keeps the documents of which the mix takes words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citylattice.llm import decontaminate, language, minhash, mixing, pii
from citylattice.llm.arrow import session
from citylattice.session import cut


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those that resemble no language learnt from the table, go."""
    session(spark)
    return language.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    session(spark)
    return minhash.keep_one(docs, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    session(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; every document stays."""
    session(spark)
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets; documents of which no word is taken go."""
    session(spark)
    return mixing.mix(docs).where(F.col("taken") > 0)


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("decontamination", no_benchmark), ("personal_data", no_personal_data), ("mixing", mixed)]

#: The language and near-duplicate stages have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
