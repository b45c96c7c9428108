"""Operator 6: toxicity by a character n-gram linear classifier with naive Bayes features.

Features are hashed n-grams of bytes inside words (with the blanks at their edges), each present or
not. A pass over a bounded sample of the labelled documents counts, per bucket, the toxic and the other
documents that have it. The most telling buckets stay, few enough that a sample of some thousand documents supports them; each is scaled by its log-count ratio, and a
logistic regression is fitted on the scaled features of the same sample. A score is the sigmoid of the summed
weights of the buckets present in the whole text.

Defined results: null or empty text has no features and scores the intercept; without labels of both
classes the score is the share of toxic rows (0 without rows). Repeated label rows count as often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import about, add_columns, documents, fold, slices, text_of, utf8

#: Lengths of the n-grams in bytes, log2 of the buckets, buckets that stay, least documents of a bucket.
LENGTHS, BUCKET_BITS, FEATURES, LEAST = (5, 6, 7), 20, 1000, 4
#: Labelled documents that the model is fitted on, about (whole texts); smoothing of counts; L2 penalty; steps; their length.
SAMPLE, ALPHA, PENALTY, STEPS, RATE = 20_000, 1.0, 1e-2, 250, 0.3
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2

_SPACE = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
_LETTER = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])


def buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the bucket of the n-gram at every byte, and whether it is a feature: it has no blank but at its ends and lies in one text."""
    raw, at = utf8(pc.utf8_lower(pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(texts, ""), pa.scalar(" "), "")))
    blank = ~_LETTER[raw]
    raw = np.where(blank, np.uint8(32), raw).astype(np.uint32)
    since = np.concatenate([[0], np.cumsum(blank, dtype=np.int32)])
    for n in LENGTHS:
        size = max(0, len(raw) - n + 1)
        h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ raw[k : k + size]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        # Texts begin and end with a blank, so an n-gram over two texts has blanks inside.
        inside = since[n - 1 : n - 1 + size] - since[1 : 1 + size] == 0
        yield ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), inside
    yield at, None


def present(texts: pa.Array, lookup: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs. lookup: bucket to feature, -1 for none; without it, buckets are features."""
    *found, (at, _) = buckets(texts)
    keys = []
    for b, ok in found:
        f = np.where(ok, b if lookup is None else lookup[b], -1)
        where = np.flatnonzero(f >= 0)
        row = np.searchsorted(at, where, "right") - 1
        keys.append(row.astype(np.int64) << 32 | f[where])
    keys = np.unique(np.concatenate(keys))
    return keys >> 32, keys & 0xFFFFFFFF


def _class_counts(rows: DataFrame) -> DataFrame:
    """bucket, yes, no: labelled documents with the bucket, of either class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only buckets that were met take room: sorted, each with its two counts.
        seen, sums = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                row, f = present(part.column("text"))
                label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                new, place = np.unique(f, return_inverse=True)
                counts = np.stack([np.bincount(place[label == c], minlength=len(new)) for c in (0, 1)])
                both, place = np.unique(np.concatenate([seen, new]), return_inverse=True)
                total = np.zeros((2, len(both)), np.int64)
                total[:, place[: len(seen)]] = sums
                total[:, place[len(seen) :]] += counts
                seen, sums = both, total
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[1]), pa.array(sums[0])], ["bucket", "yes", "no"])

    return rows.mapInArrow(count, "bucket bigint, yes bigint, no bigint").groupBy("bucket").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def _regress(row: np.ndarray, feature: np.ndarray, ratio: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on the scaled features, by gradient steps whose length adapts to each weight."""
    n, k = len(label), len(ratio)
    value = ratio[feature]
    w, seen = np.zeros(k + 1), np.full(k + 1, 1e-8)
    for _ in range(STEPS):
        z = np.bincount(row, value * w[feature], minlength=n) + w[k]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        g = np.append(np.bincount(feature, value * miss[row], minlength=k) / n + PENALTY * w[:k], miss.mean())
        seen += g * g
        w -= RATE * g / np.sqrt(seen)
    return w[:k], float(w[k])


def fit(rows: DataFrame, features: int = FEATURES) -> dict:
    """The model from rows with doc_id, text and label (0 or 1): lookup of buckets, summed weights, intercept."""
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label")).filter("label in (0, 1)")
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    yes, no = sizes.get(1, 0), sizes.get(0, 0)
    lookup = np.full(1 << BUCKET_BITS, -1, np.int32)
    if not yes or not no:
        share = yes / max(1, yes + no)
        return {"lookup": lookup, "weights": np.zeros(1), "bias": float(np.log((share + 1e-6) / (1 - share + 1e-6)))}
    p, q = (F.col("yes") + ALPHA) / (yes + 2 * ALPHA), (F.col("no") + ALPHA) / (no + 2 * ALPHA)
    counts = _class_counts(rows).filter(F.col("yes") + F.col("no") >= LEAST).select("bucket", F.log(p / q).alias("ratio"), ((p - q) * F.log(p / q)).alias("telling"))
    best = counts.orderBy(F.desc("telling"), "bucket").limit(features).toPandas()
    lookup[best["bucket"].to_numpy(np.int64)] = np.arange(len(best))
    ratio = best["ratio"].to_numpy(float)
    held = rows.sparkSession.sparkContext.broadcast(lookup)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, f = present(part.column("text"), held.value)
                cuts = np.searchsorted(row, np.arange(len(part) + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(f.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("label"), lists], ["label", "f"])

    # The sample's features alone reach the driver, as flat arrays.
    taken = rows.select("label", "text").mapInArrow(extract, "label int, f array<int>").toArrow().combine_chunks()
    label, lists = taken.column("label").to_numpy().astype(float), taken.column("f")
    size = np.concatenate([np.zeros(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in lists.chunks)])
    feature = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in lists.chunks)])
    weights, bias = _regress(np.repeat(np.arange(len(label)), size), feature, ratio, label)
    return {"lookup": lookup, "weights": weights * ratio, "bias": bias}


def scores(texts: pa.Array, model: dict) -> np.ndarray:
    """Each text's probability of being toxic."""
    row, f = present(texts, model["lookup"])
    z = np.bincount(row, model["weights"][f], minlength=len(texts)) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def predict(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(texts: pa.Array):
        s = scores(texts, held.value)
        return s, (s >= threshold).astype(np.int32)

    return add_columns(docs, [("score", "double", pa.float64()), ("predicted", "int", pa.int32())], kernel)


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and label of about sample labelled documents outside the held-out fold (all, where there are fewer). The sample bounds what is broadcast."""
    known = labels.filter(F.col(label).isNotNull() & (fold("doc_id", folds) != held_out)).select("doc_id", F.col(label).alias("label"))
    return text_of(docs).join(F.broadcast(about(known, "doc_id", sample)), "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; a quarter of them is held out from learning."""
    docs = documents(spark, sf_dir)
    model = fit(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", FOLDS, HELD_OUT))
    return predict(text_of(docs), model).select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
