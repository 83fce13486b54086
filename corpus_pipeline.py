"""The corpus pipeline: five operators of quillgraph.llm, one after the other, over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that the stage
before it kept, and what it decides takes effect in the rows that it returns. All but the last
return the columns of documents; the last adds copy_no, the number of a document's copy. Nulls,
empty tables, repeated rows and extra columns are treated as the operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import op01_simhash, op02_quality, op03_linededup, op04_mixing, op08_decontamination, packing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are content for the most part; the others go."""
    return op02_quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; a document that loses all its words goes."""
    return op03_linededup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id."""
    return op01_simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return op08_decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources at equal weights, with copy_no."""
    return op04_mixing.mixed(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("decontamination", decontaminate), ("mixing", mix)]

#: SQL can't decode a trained random field (stage 1) or hash words to signatures (stage 3).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each but the last is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packing.use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _drop(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


def _drop(spark: SparkSession, path: str) -> None:
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
