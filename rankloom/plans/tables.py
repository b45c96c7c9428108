"""How the supplied tables are read as inputs of the operators, and small helpers of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as variants: grp, measured, score, y."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_extendedprice").alias("measured"), F.col("l_quantity").alias("score"), (F.col("l_discount") > 0.05).cast("int").alias("y"))


ASSAY = "a AS (SELECT l_suppkey AS grp, l_extendedprice AS measured, l_quantity AS score, (l_discount > 0.05)::INT AS y FROM lineitem)"


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as groups: grp, protein (nation), category (region)."""
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("grp"), F.col("n_nationkey").alias("protein"), F.col("n_regionkey").alias("category"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as predictions: doc_id, y (quality), p (longer than 1000), score (length)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"), F.col("n_chars").alias("score"))


PREDICTIONS = "q AS (SELECT doc_id, quality AS y, (n_chars > 1000)::INT AS p, n_chars AS score FROM labels JOIN documents USING (doc_id))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vector, label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as result rows: row_no, model, task, day, split, metric, value."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_no"), F.concat(F.lit("org/model-"), F.col("user_id") % 5).alias("model"), F.col("event_type").alias("task"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(k % 2 == 0, "test").otherwise("validation").alias("split"), F.when(k % 3 == 0, "MSE").otherwise("AUC").alias("metric"), "value")


RESULTS = "r AS (SELECT event_id AS row_no, 'org/model-' || (user_id % 5) AS model, event_type AS task, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN (props->>'$.k')::INT % 2 = 0 THEN 'test' ELSE 'validation' END AS split, CASE WHEN (props->>'$.k')::INT % 3 = 0 THEN 'MSE' ELSE 'AUC' END AS metric, value FROM events)"


def spread(df: DataFrame) -> DataFrame:
    """Rows for costly work on each of them: where the input has fewer partitions than there are cores (a file of one row group is one task), they are dealt out; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles to so many digits, so that sums in another order compare as equal; no negative zeros."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
