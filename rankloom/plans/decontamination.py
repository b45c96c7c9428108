"""Decontamination from end to end: a corpus without the rows that leak into tasks, its stop list, and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import sources
from rankloom.functions import kmers
from rankloom.operators import similarity


@dataclass
class Written:
    """Where the parts are."""

    corpus: str
    stop_list: str
    report: str


def decontaminated(spark: SparkSession, corpus: str, tasks: dict[str, str], target: str, identity: float = 0.3, coverage: float = 0.8, k: int = 5) -> Written:
    """Reads a corpus and the tasks' sequences (FASTA), finds the corpus rows that some task's row hits with both limits reached, and writes below target: corpus (FASTA, without them), stop_list (their ids in order) and report (JSON: leaking rows and their share, per task and in all).

    The hits are kept as a table between the three, so sequences are compared once.
    """
    rows = sources.read_fasta(spark, corpus).select("id", "seq")
    every = None
    for task, path in tasks.items():
        own = sources.read_fasta(spark, path).select(F.concat_ws("|", F.lit(task), "id").alias("id"), "seq")
        every = own if every is None else every.unionByName(own)
    cut = lambda df: df.select("id", kmers(F.col("seq"), k).alias("kmers"))
    hits = similarity.shared_kmer_hits(cut(every), cut(rows)).withColumn("task", F.substring_index("query_id", "|", 1))
    good = hits.filter((F.col("containment") >= identity) & (F.least("qcov", "tcov") >= coverage)).select("task", "query_id", "target_id", "containment")
    good.write.mode("overwrite").parquet(f"{target}/hits")
    good = spark.read.parquet(f"{target}/hits")
    stop = good.select(F.col("target_id").alias("id")).distinct()
    out = Written(f"{target}/corpus", f"{target}/stop_list", f"{target}/report")
    sources.write_fasta(rows.join(stop, "id", "left_anti"), out.corpus)
    sources.write_stop_list(stop, out.stop_list)
    similarity.contamination(good, rows, "task").write.mode("overwrite").json(out.report)
    return out


def report_of(spark: SparkSession, written: Written) -> DataFrame:
    """task (null: all), n_leaking, percent."""
    return spark.read.schema("task string, n_leaking bigint, percent double").json(written.report)
