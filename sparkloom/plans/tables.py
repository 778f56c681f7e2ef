"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of texts: work on a row costs far more than moving it.
TEXTS = ("documents",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that is too small to have splits for more than a few cores is dealt out, as its single row group would keep one core busy."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


#: Tables are dealt out if they have a split for less than this part of the cores.
FEW = 1 / 8


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files together make a split for a few of them alone; larger tables stay as they are read, as moving them would cost more."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if cores > 1 and size < cores * split * FEW else df
