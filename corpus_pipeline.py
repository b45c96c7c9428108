"""A corpus pipeline in five stages: from documents to packed sequences of clean, distinct, sanitised text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. The stages accept nulls, empty texts, repeated rows, empty tables and extra columns (which
they hand on); what each operator makes of them is said in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm import langid, ngram_join, packing, pii, toxicity
from rankloom.llm.common import documents, gathered, keep_where, reliable, unused

#: Documents go whose language is unknown, or whose own language has so few of their n-grams at most.
LEAST_LANGUAGE_SCORE = 0.2
#: Near duplicates share their word 5-grams to 0.8 or more (Jaccard).
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language. The model is learnt from their own lang values."""
    model = langid.fit(langid.learnable(docs))
    known = f"lang_pred <> '{langid.UNKNOWN}' and score >= {LEAST_LANGUAGE_SCORE}"
    return keep_where(docs, ["lang_pred", "score"], lambda d: langid.predict(d, model), known)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the toxicity classifier lets pass."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.labelled(docs, labels, "toxic", toxicity.FOLDS, toxicity.HELD_OUT))
    return keep_where(docs, ["score", "predicted"], lambda d: toxicity.predict(d, model), "predicted = 0")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one of the smallest id; of repeated rows one."""
    groups = ngram_join.ngram_join(docs, NEAR_WORDS, NEAR_PERCENT)
    others = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti")
    own = F.concat_ws(":", F.col("doc_id").cast("string"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    key, copy = unused("_key", docs.columns), unused("_copy", docs.columns)
    repeated = gathered(docs.select(own.alias(key)).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key))
    if repeated.isEmpty():
        return kept
    # Texts move only where rows share an id (or, without one, a text).
    kept = kept.withColumn(key, own)
    once = kept.join(repeated, key, "left_anti")
    first = kept.join(repeated, key, "left_semi").withColumn(copy, F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64("text")))).filter(F.col(copy) == 1)
    return once.select(*docs.columns).unionByName(first.select(*docs.columns))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it taken out of their texts; n_chars follows."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces with their places in sequences."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("toxicity", without_toxic), ("n-gram Jaccard join", without_near_duplicates), ("PII", sanitised), ("best-fit packing", packed)]

#: Classifiers, terms from corpus statistics and a genetic algorithm are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = reliable(docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
