"""Queries of the corpus operators and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citylattice.llm import decontaminate, mixing, neighbours


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from citylattice.llm.arrow import session

    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citylattice.llm.decontaminate import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citylattice.llm.mixing import report

    return report(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citylattice.llm.pii import report

    return report(_table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citylattice.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citylattice.llm.minhash import report

    return report(_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citylattice.llm.language import report

    return report(_table(spark, sf_dir, "documents"))


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citylattice.llm.urls import report

    return report(_table(spark, sf_dir, "pages"))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citylattice.llm.lattice import report

    return report(_table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citylattice.llm.repeats import report

    return report(_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citylattice.llm.licenses import report

    return report(_table(spark, sf_dir, "documents"))


QUERIES = {"op5_licenses": op5_licenses, "op4_repeats": op4_repeats, "op3_lattice": op3_lattice, "op1_urls": op1_urls, "op2_language": op2_language, "op6_minhash": op6_minhash, "op8_neighbours": op8_neighbours, "op9_pii": op9_pii, "op7_mix": op7_mix, "op10_decontaminate": op10_decontaminate}
ORACLES: dict[str, str] = {"op7_mix": mixing.ORACLE, "op10_decontaminate": decontaminate.ORACLE, "op8_neighbours": neighbours.ORACLE}
