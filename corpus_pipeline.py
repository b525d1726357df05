"""From documents to packed training sequences.

Empty tables give empty ones; rows with a null text or id, repeated rows and very long texts go through like others, each stage as its operator defines it;
further columns of documents are kept up to the last stage, whatever their names.

Stages: toxic documents go; repeated lines go, but for one of each group; one document of each group of near
duplicates stays; documents that hold benchmark passages go; the rest is packed into sequences. Every
stage takes all rows that its predecessor kept, with the columns of documents, and its result is a written
table before the next one starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from massloom.llm.decontam import decontaminate
from massloom.llm.lines import dedup_lines
from massloom.llm.minhash import drop_near_duplicates
from massloom.llm.packing import pack
from massloom.llm.toxicity import drop_toxic
from massloom.llm.workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers  # its files are needed here only

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", packing),
]

#: Classifiers, near duplicates and packing have no SQL; tests/llm holds the operators against brute force, and the stages against what a plain reading of odd rows says.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
