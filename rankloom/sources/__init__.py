"""Readers and writers of sequences, hits, splits, records and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HITS_RANKED = "query string, target string, fident double, alnlen int, evalue double, bits double"
HITS_COVERED = "test_id string, corpus_id string, fident double, qcov double, tcov double, evalue double"


def fasta_columns(value) -> list:
    """id and seq of a record's text: the header up to its first white space, and all other lines joined."""
    body = F.regexp_replace(F.split(F.regexp_replace(value, r"^\s*>", ""), "\n", 2)[1], r"\s", "")
    head = F.split(F.regexp_replace(value, r"^\s*>", ""), "\n", 2)[0]
    return [F.split(F.trim(head), r"\s+")[0].alias("id"), F.coalesce(body, F.lit("")).alias("seq"), F.trim(head).alias("header")]


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, seq and header of every record; files are split between records."""
    return spark.read.option("lineSep", "\n>").text(path).filter(F.trim("value") != "").select(*fasta_columns(F.col("value")))


def write_fasta(df: DataFrame, path: str, key: str = "id", sequence: str = "seq") -> None:
    """A record per row."""
    df.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.col(sequence))).write.text(path)


def write_stop_list(df: DataFrame, path: str, key: str = "id") -> None:
    """The distinct ids in order."""
    df.select(F.col(key).cast("string")).distinct().orderBy(key).write.text(path)


def header_fields(df: DataFrame, header: str) -> DataFrame:
    """fields: the header's tokens `K=V` as a map; other tokens have no value."""
    return df.withColumn("fields", F.str_to_map(header, F.lit(" "), F.lit("=")))


def header_split(df: DataFrame, header: str) -> DataFrame:
    """split of a header's tokens SET and VALIDATION: test, else validation where that is true, else train."""
    at = lambda key: F.lower(F.try_element_at("fields", F.lit(key)))
    return header_fields(df, header).withColumn("split", F.when(at("SET") == "test", "test").when(at("VALIDATION") == "true", "validation").otherwise("train")).drop("fields")


def read_variants(spark: SparkSession, path: str, columns: list[str], assay: str | None = None, value=None) -> DataFrame:
    """The columns wanted of a variant table in parquet, of one assay where its column and value are given: both reach the scan."""
    rows = spark.read.parquet(path)
    return (rows if assay is None else rows.filter(F.col(assay) == value)).select(*columns)


def read_reference(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An assay reference: delimited text with a header, read with a given schema."""
    return spark.read.option("header", True).schema(schema).csv(path)


def stop_union(*lists: DataFrame, key: str = "id") -> DataFrame:
    """The distinct ids of several stop lists."""
    out = lists[0].select(key)
    for other in lists[1:]:
        out = out.unionByName(other.select(key))
    return out.distinct()


def newest_named(df: DataFrame, name: str, path: str, time: str, legacy: str = "_results") -> DataFrame:
    """The rows of the newest of the files that are called name, or name and the legacy ending (without their type)."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return newest(df.filter(stem.isin(name, name + legacy)).withColumn("_name", F.lit(name)), ["_name"], path, time).drop("_name")


def read_label_list(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """fields: the white-space divided fields of each line; comments and short lines go."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    return lines.select(F.split(F.trim("value"), r"\s+").alias("fields")).filter(F.size("fields") >= least)


def read_hits(spark: SparkSession, path: str, schema: str = HITS_COVERED) -> DataFrame:
    """A table of search hits; lines with fields missing go."""
    hits = spark.read.schema(schema).option("sep", "\t").option("mode", "DROPMALFORMED").csv(path)
    return hits.dropna()


def load_splits(spark: SparkSession, files: dict[str, str], columns: list[str], fmt: str = "parquet") -> DataFrame:
    """The given columns of each split's own files, and split. Splits may have different other columns."""
    out = None
    for name, path in files.items():
        reader = spark.read.format(fmt)
        part = (reader.option("header", True) if fmt == "csv" else reader).load(path).select(*columns).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; lines that can't be read go."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    parsed = F.from_json("value", T.StructType([*kind.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parsed.alias("_r"))
    return rows.filter(F.col("_r").isNotNull() & F.col("_r._bad").isNull()).select("_r.*").drop("_bad")


def append_records(df: DataFrame, path: str) -> None:
    """Adds rows as JSON lines."""
    df.write.mode("append").json(path)


def read_score_files(spark: SparkSession, path: str, most: float = 900.0) -> DataFrame:
    """file, n, n_scored, mean, sd (population) and side of JSON files of scores, an array of numbers each, or an object with the scores under `z-score` or zscore (or of records with them); values that are no finite numbers below most don't count.

    side is train or test where the file's name says so; of files whose name says neither, the larger half (by values) is train, the others test.
    """
    kinds = ("array<string>", "struct<`z-score`:array<string>,zscore:array<string>>", "array<struct<`z-score`:string,zscore:string>>")
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    trimmed = F.ltrim("value")
    objects = F.from_json("value", kinds[2])
    named = F.from_json("value", kinds[1])
    records = F.transform(objects, lambda x: F.coalesce(x["z-score"], x["zscore"]))
    values = F.when(trimmed.startswith("{"), F.coalesce(named["z-score"], named["zscore"])).when(trimmed.rlike(r"^\[\s*\{"), records).otherwise(F.from_json("value", kinds[0]))
    rows = text.select("file", values.alias("v"))
    numbers = F.filter(F.transform("v", lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x < most))
    each = rows.select("file", F.coalesce(F.size("v"), F.lit(0)).alias("n"), F.explode_outer(numbers).alias("x"))
    per = each.groupBy("file", "n").agg(F.count("x").alias("n_scored"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    name = F.lower("file")
    said = F.when(name.contains("test"), "test").when(name.contains("train"), "train")
    unsaid = per.filter(said.isNull()).agg(F.percentile("n", 0.5).alias("_half"))
    # One row.
    return per.crossJoin(F.broadcast(unsaid)).withColumn("side", F.coalesce(said, F.when(F.col("n") >= F.col("_half"), "train").otherwise("test"))).drop("_half")


def write_split(df: DataFrame, path: str, name: str) -> DataFrame:
    """Writes rows as a split of their own below path and returns them as they were written."""
    df.write.mode("overwrite").parquet(f"{path}/split={name}")
    return df.sparkSession.read.parquet(f"{path}/split={name}")


def newest(df: DataFrame, keys: list[str], path: str, time: str) -> DataFrame:
    """The rows of each key's newest file."""
    last = df.groupBy(*keys).agg(F.max_by(path, F.struct(time, path)).alias(path))
    return df.join(last, [*keys, path], "left_semi")


def with_file(df: DataFrame) -> DataFrame:
    """Rows with the path and time of the file they come from."""
    return df.withColumns({"file_path": F.col("_metadata.file_path"), "file_time": F.col("_metadata.file_modification_time")})


def append_results(spark: SparkSession, new: DataFrame, path: str, recovery: str, keys: list[str], order: str) -> str:
    """Adds rows to a result table in versions and returns the path written. Rows of one key (which includes the day) replace each other, the last by order stays. Old rows are not read for it; if the table's manifest, or files that are due to be merged, can't be read, the new rows go to the recovery path instead, and the table stays as it is. Two writers at once both get in."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    from rankloom.sources import versions

    try:
        versions.add(spark, path, new, keys, order)
    except (PySparkException, Py4JJavaError, ValueError, KeyError):
        new.write.mode("append").parquet(recovery)
        return recovery
    return path


def read_results(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The rows of a result table that append_results keeps."""
    from rankloom.sources import versions

    rows = versions.read(spark, path, keys, order)
    if rows is None:
        raise ValueError(f"no version of {path}")
    return rows.drop("first_seen", "_part")
