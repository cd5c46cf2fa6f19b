"""Reading the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Deal rows over tasks by a unique key when the source has fewer splits than cores.

    The tables of the small folders are one file with one row group each, so a scan is one task. Where the scan already has as
    many splits as the cluster has cores, the frame is returned as it is, without a shuffle.
    """
    spark = df.sparkSession
    cores = parts or spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
