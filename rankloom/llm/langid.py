"""Operator 7: language identification with language-bitmask n-gram filters.

Each language's most frequent byte n-grams, save those far more frequent in another language, go into
a Bloom filter. The filters of all languages are
bit-sliced: one table whose slot holds a bit for each language, so the slots of an n-gram, ANDed,
give the mask of all languages that have it; more languages than a slot has bits take several such tables. A text's masks are counted per language, each count is
corrected for the filter's false positives (hits = true + (grams - true) * rate), and the largest decides.

Defined results: a text that is null, empty or without a letter is `und` with score 0; ties go to the
first language in order; without training rows every text is `und`. Rows with null language teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import about, add_columns, documents, fold, mix, slices, text_of, utf8

UNKNOWN = "und"
#: Lengths in bytes of the n-grams; n-grams kept for a language; slots of the table; hash functions.
LENGTHS, TOP, SLOTS_BITS, HASHES = (3, 4), 20_000, 20, 3
#: Languages of a table: the bits of its widest slot.
WIDTH = 64
#: Training documents of a language, about (whole texts).
SAMPLE = 2500
#: A language has an n-gram if its frequency there is at least this part of its frequency anywhere.
PART = 0.2
FOLDS, HELD_OUT = 4, 2

_SPACE = np.array([c < 0x80 and not chr(c).isalpha() for c in range(256)])


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the n-grams of the lower-cased letters of all texts, as integers that hold length and bytes, and where each text's begin. Other signs count as one blank."""
    raw, at = utf8(pc.utf8_lower(pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(texts, ""), pa.scalar(" "), "")))
    blank = _SPACE[raw]
    again = np.zeros(len(raw), bool)
    again[1:] = blank[1:] & blank[:-1]
    again[at[:-1]] = False
    sums = np.concatenate([[0], np.cumsum(~again)])
    raw, at = np.where(blank, np.uint8(32), raw)[~again].astype(np.uint64), sums[at]
    for n in LENGTHS:
        h = np.full(max(0, len(raw) - n + 1), n << 56, np.uint64)
        for k in range(n):
            h |= raw[k : k + len(h)] << np.uint64(8 * k)
        ok = np.ones(len(raw), bool)
        for k in range(1, n):
            ok[np.maximum(at[1:] - k, at[:-1])] = False
        ok = ok[: len(h)]
        yield h[ok], np.concatenate([[0], np.cumsum(ok)])[np.minimum(at, len(ok))]


def _slots(h: np.ndarray) -> Iterator[np.ndarray]:
    spread = mix(h)
    for k in range(HASHES):
        yield ((spread >> np.uint64(SLOTS_BITS * k)) & np.uint64((1 << SLOTS_BITS) - 1)).astype(np.int64)


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, top: int = TOP) -> dict:
    """The model: languages in order, the bit-sliced tables (each for WIDTH languages at most), and each language's rate of false positives."""
    known = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull())
    rows = about(known, "doc_id", sample, label).select(F.col(label).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                langs, codes = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                for k, lang in enumerate(langs):
                    found = [h for h, _ in grams(part.column("text").filter(pa.array(codes == k)))]
                    g, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(W.partitionBy("lang"))
    counts = counts.withColumn("rate", rate).withColumn("most", F.max("rate").over(W.partitionBy("gram"))).filter(F.col("rate") >= PART * F.col("most"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("r", rank).filter(F.col("r") <= top).groupBy("lang").agg(F.collect_list("gram").alias("grams")).orderBy("lang").collect()
    kind = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, WIDTH)) if len(best) <= bits or bits == WIDTH)
    tables, rates = [], []
    for start in range(0, len(best), WIDTH):
        table = np.zeros(1 << SLOTS_BITS, kind)
        for k, row in enumerate(best[start : start + WIDTH]):
            for s in _slots(np.array(row["grams"], np.int64).astype(np.uint64)):
                table[s] |= kind(1 << k)
        rates += [float(np.mean((table >> kind(k)) & kind(1)) ** HASHES) for k in range(len(best[start : start + WIDTH]))]
        tables.append(table)
    return {"languages": [r["lang"] for r in best], "tables": tables, "rates": rates}


def scores(texts: pa.Array, model: dict) -> tuple[list[str], np.ndarray]:
    """Each text's language and the share of its n-grams that this language truly has."""
    languages = model["languages"]
    hits, total = np.zeros((len(texts), max(1, len(languages)))), np.zeros(len(texts))
    for h, at in grams(texts):
        total += np.diff(at)
        slots = list(_slots(h))
        for no, table in enumerate(model["tables"]):
            mask = np.bitwise_and.reduce([table[s] for s in slots])
            for k in range(min(WIDTH, len(languages) - no * WIDTH)):
                sums = np.concatenate([[0], np.cumsum((mask >> table.dtype.type(k)) & table.dtype.type(1), dtype=np.int64)])
                hits[:, no * WIDTH + k] += sums[at[1:]] - sums[at[:-1]]
    rates = np.array(model["rates"] or [0.0])
    share = np.clip((hits / np.maximum(total, 1)[:, None] - rates) / (1 - rates), 0, 1)
    best = share.argmax(1)
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    known = letters & bool(languages)
    return [languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], np.where(known, share[np.arange(len(best)), best], 0.0)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, [("lang_pred", "string", pa.string()), ("score", "double", pa.float64())], lambda texts: scores(texts, held.value))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may teach: those outside the held-out fold."""
    return docs.filter(fold("doc_id", FOLDS) != HELD_OUT)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a quarter of them is held out from learning."""
    docs = documents(spark, sf_dir)
    out = predict(text_of(docs), fit(learnable(docs)))
    return out.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
SQL: dict[str, str] = {}
