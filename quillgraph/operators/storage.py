"""Shared folders, checkpoints and numbering without a task that sees all rows."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def use_checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster, spark.checkpoint.dir; only where it is unset, as in tests, a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillgraph-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows from shared storage, with the lineage cut. A checkpoint computes its rows twice, so they are kept on disk meanwhile."""
    use_checkpoints(df.sparkSession)
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        return kept.checkpoint(eager=True)
    finally:
        kept.unpersist()


def removed(spark: SparkSession, place: str) -> None:
    """Remove a shared folder; those two levels down, which hold most of a notebook's files, by a task each."""
    inside = lambda at: [e.path for e in os.scandir(at) if e.is_dir(follow_symlinks=False)]
    deep = [d for c in inside(place) for d in inside(c)] if os.path.isdir(place) else []
    if len(deep) > 1:
        spark.createDataFrame([(d,) for d in deep], "place string").repartition(len(deep)).foreach(lambda row: shutil.rmtree(row["place"], ignore_errors=True))
    shutil.rmtree(place, ignore_errors=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors reach; a plain path where the checkpoints have one."""
    place = f"{use_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"
    return place.removeprefix("file://") if place.startswith("file:///") else place.removeprefix("file:") if place.startswith("file:/") else place


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with a column that numbers its rows from ``start`` + 1 in an order.

    Rows are cut into ranges of the order; a range's rows are counted, and each is numbered by itself from the sum of those before,
    so that no task sorts all. Rows that tie are in either order.
    """
    part = f"{name}_part"
    cut = checkpointed(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    before, at = {}, start
    for row in sorted(cut.groupBy(part).count().collect()):
        before[row[0]], at = at, at + row[1]
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("long")
    firsts = cut.sparkSession.createDataFrame(list(before.items()), f"{part} int, {part}_first long")
    return cut.withColumn(name, nth).join(F.broadcast(firsts), part).withColumn(name, F.col(name) + F.col(f"{part}_first")).drop(part, f"{part}_first")
