"""Reading the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``, dealt out if it came in fewer partitions than there are cores: one file is one task otherwise."""
    d = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return d if d.rdd.getNumPartitions() >= cores else d.repartition(max(cores, 2))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)


def lit_array(items: list[str]):
    return F.array(*map(F.lit, items))
