"""A training corpus from raw documents: quality, near duplicates, decontamination, personal data, mix.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what it decides
takes effect in the rows that it returns. Extra columns stay, whatever their names. An empty table gives an
empty result in each stage. Texts of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontam, jaccard, mixing, pii, quality
from sparkloom.llm.common import Cuts, documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled ones among them. Null and empty texts
    have the score of the model's bias alone; repeated rows are judged each; rows with a null id are not learned from."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a Jaccard similarity of 0.8 on shingles of five words, that of
    least id (null ids last). Null, empty and blank texts link with nothing and stay; of repeated rows one stays."""
    return jaccard.keep_one_of_each(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and empty texts stay; repeated rows are judged each."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the texts are replaced by the names of their kinds, and n_chars is renewed. No row
    goes; null and empty texts stay as they are."""
    return pii.redact_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, with the number of copies and words taken. Null and empty texts
    have no words to take; a null source is a source; rows equal in id and text tie."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The classifier's learned scores and the components have no SQL; tests/llm runs the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    cuts, docs = Cuts(spark, "pipeline"), documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cuts.write(docs)
            cuts.drop(before)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
