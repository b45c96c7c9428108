"""Operator 8: quality by a factorisation machine.

The inputs of a document are its hashed words (each weighted by the square root of its share), structure
statistics of the text and the length. Every pair of inputs interacts through the product of two short
vectors; the sum over all pairs is half of (the square of the summed vectors less the sum of their
squares), so a score takes time linear in the document's inputs.

Defined results: null or empty text has the statistics of an empty text and no words; without labels of
both classes the score is the share of good rows (0.5 without rows). Repeated label rows count as often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import add_columns, documents, fold, run_hashes, slices, text_of, utf8, words
from rankloom.llm.toxicity import labelled

#: log2 of the word buckets; length of the vectors; training documents, about (whole texts).
BUCKET_BITS, RANK, SAMPLE = 15, 6, 6000
#: Passes over the sample, rows of a step, step length, L2 penalty.
PASSES, BATCH, RATE, PENALTY = 12, 64, 0.05, 1e-4
THRESHOLD, FOLDS, HELD_OUT = 0.5, 3, 1

STATISTICS = ("log_bytes", "log_words", "word_length", "distinct_words", "top_word", "same_as_previous", "upper", "digit", "sign", "non_ascii", "white", "log_lines", "line_length", "sign_ends")

_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_LOWER = np.isin(np.arange(256), np.arange(97, 123))
_HIGH = np.arange(256) >= 128
_SIGN = ~(_WHITE | _UPPER | _DIGIT | _LOWER | _HIGH)


def inputs(texts: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The statistics of each text, and its words: row, bucket, weight, each pair of row and bucket once."""
    raw, at = utf8(texts)
    n = len(texts)
    size = np.diff(at)
    starts, ends, first = words(raw, at, _WHITE)
    row = np.repeat(np.arange(n), np.diff(first))
    low = np.where(_UPPER[raw], raw + np.uint8(32), raw)
    h = run_hashes(low, starts, ends)

    def per_text(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag[raw])])
        return sums[at[1:]] - sums[at[:-1]]

    count = np.diff(first)
    some, each = np.maximum(size, 1), np.maximum(count, 1)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    keys, tally = np.unique(row.astype(np.int64) << BUCKET_BITS | bucket, return_counts=True)
    r, b = keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1)
    distinct = np.bincount(r, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, r, tally)
    lines = per_text(np.arange(256) == 10) + 1
    last = np.bincount(row, _SIGN[raw[ends - 1]], minlength=n) if len(ends) else np.zeros(n)
    stats = np.stack([np.log1p(size), np.log1p(count), (size - per_text(_WHITE)) / each, distinct / each, top / each, np.bincount(row, same, minlength=n) / each, *(per_text(f) / some for f in (_UPPER, _DIGIT, _SIGN, _HIGH, _WHITE)), np.log1p(lines), np.log1p(size / lines), last / each], 1)
    return stats, (r, b, np.sqrt(tally / each[r]))


class Machine:
    """A factorisation machine over the statistics (scaled by mean and spread) and the word buckets."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, bias: float):
        rng = np.random.default_rng(7)
        k = len(STATISTICS) + (1 << BUCKET_BITS)
        self.mean, self.spread, self.bias = mean, spread, bias
        self.w, self.v = np.zeros(k, np.float32), rng.normal(0, 0.01, (k, RANK)).astype(np.float32)

    def rows(self, stats: np.ndarray, found: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All inputs as row, input, value."""
        n, k = stats.shape
        z = np.clip((stats - self.mean) / self.spread, -6, 6) / np.sqrt(k)
        r, b, x = found
        return np.concatenate([np.repeat(np.arange(n), k), r]), np.concatenate([np.tile(np.arange(k), n), b + k]), np.concatenate([z.ravel(), x]).astype(np.float32)

    def margin(self, r: np.ndarray, i: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's margin and its summed vectors."""
        linear = np.bincount(r, self.w[i] * x, minlength=n)
        sums = np.zeros((n, RANK))
        squares = np.zeros(n)
        for f in range(RANK):
            p = self.v[i, f] * x
            sums[:, f] = np.bincount(r, p, minlength=n)
            squares += np.bincount(r, p * p, minlength=n)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums


def _train(stats: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> Machine:
    share = min(max(label.mean(), 1e-3), 1 - 1e-3)
    m = Machine(stats.mean(0), stats.std(0) + 1e-9, float(np.log(share / (1 - share))))
    seen_w, seen_v = np.full(m.w.shape, 1e-4, np.float32), np.full(m.v.shape, 1e-4, np.float32)
    rng = np.random.default_rng(11)
    for _ in range(PASSES):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            n = len(part)
            r, i, x = m.rows(stats[part], (np.repeat(np.arange(n), [len(lists[p][0]) for p in part]), np.concatenate([lists[p][0] for p in part]), np.concatenate([lists[p][1] for p in part])))
            z, sums = m.margin(r, i, x, n)
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) / n
            used, place = np.unique(i, return_inverse=True)
            e = miss[r] * x
            g = np.bincount(place, e) + PENALTY * m.w[used]
            seen_w[used] += g * g
            m.w[used] -= RATE * g / np.sqrt(seen_w[used])
            for f in range(RANK):
                g = np.bincount(place, e * (sums[r, f] - m.v[i, f] * x)) + PENALTY * m.v[used, f]
                seen_v[used, f] += g * g
                m.v[used, f] -= RATE * g / np.sqrt(seen_v[used, f])
            m.bias -= RATE * float(miss.sum())
    return m


def fit(rows: DataFrame) -> Machine:
    """The machine from rows with text and label (0 or 1), as many as are given; labelled() bounds them."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                stats, (r, b, x) = inputs(part.column("text"))
                cuts = pa.array(np.searchsorted(r, np.arange(len(part) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(list(stats), pa.list_(pa.float64())), pa.ListArray.from_arrays(cuts, pa.array(b.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.float32)))], ["doc_id", "label", "s", "b", "x"])

    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label")).filter("label in (0, 1)")
    taken = rows.mapInArrow(extract, "doc_id bigint, label int, s array<double>, b array<int>, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    label = taken["label"].to_numpy(float)
    if len(set(label)) < 2:
        share = float(label.mean()) if len(label) else 0.5
        m = Machine(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
        m.v[:] = 0
        return m
    # A text without words comes back as an empty list of no type.
    lists = [(np.asarray(b, np.int64), np.asarray(x, np.float32)) for b, x in zip(taken["b"], taken["x"], strict=True)]
    return _train(np.stack(taken["s"].to_list()), lists, label)


def scores(texts: pa.Array, m: Machine) -> np.ndarray:
    """Each text's probability of good quality."""
    stats, found = inputs(texts)
    z, _ = m.margin(*m.rows(stats, found), len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def predict(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(texts: pa.Array):
        s = scores(texts, held.value)
        return s, (s >= threshold).astype(np.int32)

    return add_columns(docs, [("score", "double", pa.float64()), ("predicted", "int", pa.int32())], kernel)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; a third of them is held out from learning."""
    docs = documents(spark, sf_dir)
    model = fit(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", FOLDS, HELD_OUT, SAMPLE))
    return predict(text_of(docs), model).select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op8_quality": op8_quality}
SQL: dict[str, str] = {}
