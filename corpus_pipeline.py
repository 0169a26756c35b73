"""Documents to packed sequences: classify, drop near copies, cut repeated passages, drop leaked items, pack.

Each stage works on all that the one before has kept, and all but the last return the columns of
documents.  ``run`` writes every stage's rows as Parquet in the shared folder and reads them again, so a lost
executor never sends the job back to its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.decontaminate import without_leaks
from quillspark.llm.line_crf import good_documents
from quillspark.llm.minhash_dedup import one_of_each_group
from quillspark.llm.packing import pack
from quillspark.llm.scratch import cut
from quillspark.llm.substring_dedup import repeated_passages, without_passages

#: The chain of stages holds a trained field, hashes and alignments, which SQL can't express.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # op10 links at 85; a stage on word shingles at 80
    return one_of_each_group(docs, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_passages(docs, repeated_passages(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
