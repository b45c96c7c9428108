"""Counts of what a job leaves out: joins that report what they lose, statistics of a dataset, units that were skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_counting(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of left joined with right, and one row of n_rows, n_joined and n_missing (rows of left that right lacks)."""
    known = right.select(key).distinct().withColumn("_known", F.lit(True))
    told = left.join(known, key, "left").agg(F.count("*").alias("n_rows"), F.count("_known").alias("n_joined"), F.count_if(F.col("_known").isNull()).alias("n_missing"))
    return left.join(right, key), told


def dataset_statistics(df: DataFrame, split: str, label: str, positive: Column, size: str) -> DataFrame:
    """Per split: rows, dropped (without label), distinct labels, the share of positive ones among labelled rows, and the sum of sizes of these."""
    known = F.col(label).isNotNull()
    return df.groupBy(split).agg(F.count_if(known).alias("n_rows"), F.count_if(~known).alias("n_dropped"), F.countDistinct(label).alias("n_labels"), F.avg(F.when(known, positive.cast("double"))).alias("positive"), F.sum(F.when(known, F.col(size))).cast("bigint").alias("total_size"))


def skipped(df: DataFrame, key: str, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that no reason holds for, and key and reason of all others: the first reason that holds."""
    reason = F.coalesce(*[F.when(c, F.lit(name)) for name, c in reasons.items()])
    marked = df.withColumn("_reason", reason)
    return marked.filter(F.col("_reason").isNull()).drop("_reason"), marked.filter(F.col("_reason").isNotNull()).select(key, F.col("_reason").alias("reason"))


def skipped_report(kept: DataFrame, left_out: DataFrame) -> DataFrame:
    """reason and n of the rows left out, and one row (reason null) with the number of those kept."""
    return left_out.groupBy("reason").agg(F.count("*").alias("n")).unionByName(kept.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("reason"), "n"))
