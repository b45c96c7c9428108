"""The two table operators that are naturally incremental, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.warehouse import latest_cells
from rankloom.sources import fasta_columns, versions

#: Versions of a table that stay readable.
KEEP = 3


def collect_results(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, write_keys: list[str], order: str, keep: int = KEEP):
    """A query that keeps a table of the last write of each full key from a folder of JSON lines. A batch adds its own rows to the table as a new version (rankloom.sources.versions), so it costs as much as its keys; a repeated batch is not added again, a late row counts by its order, and versions older than the last keep are dropped. latest_version() reads it."""
    rows = spark.readStream.schema(schema).json(source)

    def batch(df: DataFrame, number: int) -> None:
        # Writes of one cell under several keys are all kept: which of them counts is decided by who reads.
        versions.add(df.sparkSession, table, df, write_keys, order, checkpoint, number)
        versions.expire(df.sparkSession, table, keep)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, table: str, write_keys: list[str], cell_keys: list[str], date: str, order: str) -> DataFrame:
    """The latest row of each cell in the newest version of a table that collect_results keeps."""
    rows = versions.read(spark, table, write_keys, order)
    if rows is None:
        raise ValueError(f"no version of {table}")
    return latest_cells(rows, cell_keys, date).drop("first_seen", "_part")


def filter_corpus(spark: SparkSession, source: str, stop: DataFrame, target: str, checkpoint: str):
    """A query that passes on the FASTA records of a folder whose id is not on the stop list (a column id)."""
    rows = spark.readStream.option("lineSep", "\n>").text(source).filter(F.trim("value") != "").select(*fasta_columns(F.col("value")))
    kept = rows.join(stop.select("id"), "id", "left_anti").select("id", "seq")
    return kept.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
