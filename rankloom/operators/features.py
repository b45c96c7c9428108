"""Features of sequences and vectors: k-mers, pooling, diversity, distinct embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Letters of texts that are counted at once.
LETTERS = 1 << 21


def kmer_frequencies(df: DataFrame, key: str, sequence: str, k: int, alphabet: str) -> DataFrame:
    """key, kmer, freq: the share of each k-mer among the row's; none for rows without. A row's k-mers are counted where the row is: as numbers of the alphabet's base, those of many rows by one sort; nothing is shuffled."""
    if k < 1:
        raise ValueError("k must be positive")
    base = len(alphabet)
    if base**k >= 1 << 40:
        raise ValueError(f"{base} letters to the power {k} are too many k-mers")
    code = np.full(256, -1, np.int64)
    for place, letter in enumerate(alphabet):
        code[ord(letter)] = code[ord(letter.lower())] = place
    kind = df.schema[key].dataType

    def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, k-mer and its share, for the distinct k-mers of each row."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        letters = code[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
        at = at - at[0]
        n = max(0, len(letters) - k + 1)
        number, whole = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k):
            part = letters[j : j + n]
            number = number * base + part
            whole &= part >= 0
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        # No k-mer goes on into the next row.
        whole &= row[:n] == row[k - 1 :][:n] if n else whole
        keys, counts = np.unique(row[:n][whole] * base**k + number[whole], return_counts=True)
        own, number = keys // base**k, keys % base**k
        return own, number, counts / np.bincount(own, counts, minlength=len(at) - 1)[own] if len(keys) else counts.astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.array(list(alphabet))
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("s")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            for part in np.split(np.arange(batch.num_rows), np.searchsorted(sizes, np.arange(LETTERS, int(sizes[-1]) if len(sizes) else 0, LETTERS))):
                if len(part):
                    rows = batch.slice(int(part[0]), len(part))
                    own, number, share = counted(rows.column("s"))
                    seen, place = np.unique(number, return_inverse=True)
                    text = letters[(seen[:, None] // base ** np.arange(k - 1, -1, -1)) % base] if len(seen) else np.zeros((0, k), str)
                    names = pa.array(["".join(x) for x in text], pa.string())
                    yield pa.RecordBatch.from_arrays([rows.column("k").take(pa.array(own)), names.take(pa.array(place)), pa.array(share)], [key, "kmer", "freq"])

    rows = df.select(F.col(key).alias("k"), F.col(sequence).cast("string").alias("s"))
    return rows.mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("kmer", T.StringType()), T.StructField("freq", T.DoubleType())]))


def require_width(alphabet: str, k: int, rows: int, most_bytes: int = 16 << 30) -> int:
    """The number of k-mers of an alphabet; an error where k is not positive or a dense table would be too large."""
    if k < 1:
        raise ValueError("k must be positive")
    width = len(alphabet) ** k
    if width * rows * 4 > most_bytes:
        raise ValueError(f"{rows} rows of {width} columns need more than {most_bytes} bytes")
    return width


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "mean", mask: Column | None = None) -> DataFrame:
    """The mean of each key's vectors, part by part; mask: of the rows for which it holds (keys without any are left out)."""
    parts = (df if mask is None else df.filter(mask)).select(*keys, F.posexplode(vector).alias("_i", "_x"))
    per = parts.groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(out))


def joined_blocks(blocks: list[DataFrame], keys: list[str], vectors: list[str], out: str = "vector") -> DataFrame:
    """keys and out: the vectors of several tables, one after the other, of the keys that all of them have."""
    joined = blocks[0].select(*keys, F.col(vectors[0]).alias("_0"))
    for k, (block, v) in enumerate(zip(blocks[1:], vectors[1:], strict=True), 1):
        joined = joined.join(block.select(*keys, F.col(v).alias(f"_{k}")), keys)
    return joined.select(*keys, F.concat(*[f"_{k}" for k in range(len(blocks))]).alias(out))


def diversity(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One less the mean cosine of all pairs of a key's vectors, from the sum of unit vectors: 1 - (|sum|^2 - sum of squares) / (n (n - 1)); 0 for fewer than two."""
    from rankloom.functions import unit

    u = df.select(key, F.posexplode(unit(F.col(vector))).alias("_i", "_x"))
    per = u.groupBy(key, "_i").agg(F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q"), F.count("*").alias("_n"))
    t = per.groupBy(key).agg(F.sum(F.col("_s") * F.col("_s")).alias("_a"), F.sum("_q").alias("_b"), F.max("_n").alias("n"))
    return t.select(key, "n", F.when(F.col("n") < 2, 0.0).otherwise(1 - (F.col("_a") - F.col("_b")) / (F.col("n") * (F.col("n") - 1))).alias("diversity"))


def span_distance(df: DataFrame, pairs: DataFrame, metric: str = "cosine") -> DataFrame:
    """pair_id and the distance of two pooled spans. df: protein, pos, vec; pairs: pair_id and for both sides a, b: protein_<s>, start_<s>, end_<s> (end exclusive). An empty span counts as the whole."""
    sides = []
    for s in ("a", "b"):
        x = pairs.select("pair_id", F.col(f"protein_{s}").alias("protein"), F.col(f"start_{s}").alias("start"), F.col(f"end_{s}").alias("end"))
        inside = (F.col("end") <= F.col("start")) | ((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
        sides.append(mean_vectors(x.join(df, "protein").filter(inside), ["pair_id"], "vec", f"m_{s}"))
    both = sides[0].join(sides[1], "pair_id")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    product = total(F.zip_with("m_a", "m_b", lambda x, y: x * y))
    norm = lambda c: F.sqrt(total(F.transform(c, lambda x: x * x)))
    if metric == "cosine":
        d = 1 - product / F.greatest(F.lit(1e-12), norm("m_a") * norm("m_b"))
    else:
        d = F.sqrt(total(F.zip_with("m_a", "m_b", lambda x, y: (x - y) * (x - y))))
    return both.select("pair_id", d.alias("distance"))


def pair_vectors(pairs: DataFrame, vectors: DataFrame, left: str, right: str, out: str = "vector") -> DataFrame:
    """pairs with the vectors of both members, one after the other. vectors: id, vector."""
    for side in (left, right):
        pairs = pairs.join(vectors.select(F.col("id").alias(side), F.col("vector").alias(f"_{side}")), side)
    return pairs.withColumn(out, F.concat(f"_{left}", f"_{right}")).drop(f"_{left}", f"_{right}")


def cosine_to(variants: DataFrame, vectors: DataFrame, variant: str, wild: str, out: str = "cosine") -> DataFrame:
    """variants with the cosine of each one's vector and its wild type's; 0 where either is zero. vectors: id, vector."""
    from rankloom.functions import dot, unit

    for side in (variant, wild):
        variants = variants.join(vectors.select(F.col("id").alias(side), unit(F.col("vector")).alias(f"_{side}")), side)
    return variants.withColumn(out, dot(F.col(f"_{variant}"), F.col(f"_{wild}"))).drop(f"_{variant}", f"_{wild}")


def embed_residues(df: DataFrame, key: str, sequence: str, embedder: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """key, pos, vec: a vector for each position of each sequence. embedder: makes the function once per task; it gives a list of vectors for each sequence."""
    schema = f"{key} {dict(df.dtypes)[key]}, pos int, vec array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = embedder()
        for x in frames:
            for k, rows in zip(x[key], f(x[sequence].tolist()), strict=True):
                yield pd.DataFrame({key: [k] * len(rows), "pos": range(len(rows)), "vec": [list(map(float, v)) for v in rows]})

    return df.select(key, sequence).mapInPandas(run, schema)


def profile_rows(df: DataFrame, key: str, sequence: str, scorer: Callable[[], Callable[[str, list[int]], list]], alphabet: str) -> DataFrame:
    """wt_id, pos, symbol, logp for the positions (an array column) of each sequence. scorer: makes the function once per task; it gives a row of log probabilities in the alphabet's order for each position."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = scorer()
        for x in frames:
            for k, s, places in zip(x[key], x[sequence], x["positions"], strict=True):
                places = list(map(int, places))
                rows = [(k, p, a, float(v)) for p, values in zip(places, f(s, places), strict=True) for a, v in zip(alphabet, values, strict=True)]
                yield pd.DataFrame(rows, columns=["wt_id", "pos", "symbol", "logp"])

    return df.select(key, sequence, "positions").mapInPandas(run, f"wt_id {dict(df.dtypes)[key]}, pos int, symbol string, logp double")


#: Buckets of a cache table.
CACHE_BUCKETS = 64


def embed_cached(df: DataFrame, sequence: str, embedder: Callable[[], Callable[[list[str]], list]], table: str, model: str, buckets: int = CACHE_BUCKETS) -> DataFrame:
    """df with embedding, from a cache table that is filled on the way: sequences that it lacks are embedded once and added in the same run, so the next run embeds none of them. The key is the sha2 of the model's name and settings and the sequence; vectors of another configuration are never taken.

    The table is bucketed by key: it is joined where it lies, and only df is shuffled.
    """
    spark = df.sparkSession
    key = F.sha2(F.concat_ws("|", F.lit(model), F.col(sequence)), 256)
    keyed = df.withColumn("_key", key)
    held = spark.table(table).select(F.col("key").alias("_key")) if spark.catalog.tableExists(table) else None
    todo = keyed.filter(F.col(sequence).isNotNull()).select("_key", F.col(sequence).alias("_s")).dropDuplicates(["_key"])
    if held is not None:
        todo = todo.join(held.hint("merge"), "_key", "left_anti")
    made = todo.mapInPandas(_embedded(embedder), "_key string, embedding array<float>").withColumnRenamed("_key", "key")
    made.write.format("parquet").bucketBy(buckets, "key").sortBy("key").mode("append").saveAsTable(table)
    spark.catalog.refreshTable(table)
    # Two runs at once may both have added a key: one row of each counts.
    cache = spark.table(table).groupBy(F.col("key").alias("_key")).agg(F.first("embedding").alias("embedding"))
    return keyed.join(cache.hint("merge"), "_key", "left").drop("_key")


def _embedded(embedder: Callable[[], Callable[[list[str]], list]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = embedder()
        for x in frames:
            yield pd.DataFrame({"_key": x["_key"], "embedding": [list(map(float, v)) for v in f(x["_s"].tolist())]})

    return run


def embed_distinct(df: DataFrame, sequence: str, embedder: Callable[[], Callable[[list[str]], list]], cache: DataFrame | None = None, model: str = "") -> DataFrame:
    """df with embedding: each distinct sequence is embedded once, or taken from a cache of key and embedding. The key is the sha2 of the model's name and settings and the sequence, so that a vector of another configuration is never taken. embedder: makes the function once per task."""
    keyed = df.withColumn("_key", F.sha2(F.concat_ws("|", F.lit(model), F.col(sequence)), 256))
    todo = keyed.select("_key", F.col(sequence).alias("_s")).dropDuplicates(["_key"])
    if cache is not None:
        todo = todo.join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")
    made = todo.mapInPandas(_embedded(embedder), "_key string, embedding array<float>")
    if cache is not None:
        made = made.unionByName(cache.select(F.col("key").alias("_key"), F.col("embedding").cast("array<float>").alias("embedding")))
    return keyed.join(made, "_key", "left").drop("_key")
