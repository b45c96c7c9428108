"""Operator 5: document fingerprints as Merkle trees, in DataFrame functions only.

A text's sections are its lines; a section's paragraphs are its runs up to a sign followed by white
space, 48 characters at most, as many texts have no other breaks. A paragraph's hash is the SHA-256 of its
text, a section's that of its paragraphs' hashes, the root's that of its sections' hashes. Equal roots
mean equal texts; where roots differ, the sections whose hash the other text lacks locate the edits (an inserted
section moves the others, and is found alone), and within them the
paragraphs. The fingerprint holds the whole root in hexadecimal, and in base 64 the first 48 bits of each section and 24 of each paragraph:
`root|section:paragraphs;section:paragraphs...`.

Defined results: null text counts as empty, with one section without paragraphs; repeated rows are
documents of their own that follow each other; rows without id come after all others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import documents

#: A paragraph: up to 48 characters that end with a sign and white space, else that end with white space, else as they come.
PARAGRAPH = r"(?s).{0,46}?[^\p{L}\p{N}\s](?:\s+|$)|.{1,48}(?:\s+|$)|.{1,48}"


#: Bytes of text of a bucket, about; buckets at most (beyond that they grow: rows pass through one sorted, none of them held).
BUCKET_BYTES, BUCKETS_MOST = 8 << 20, 1 << 16
#: Hexadecimal digits of a section's and of a paragraph's hash that a fingerprint keeps.
SECTION_DIGITS, PARAGRAPH_DIGITS = 12, 6


def short(hash_: Column, digits: int) -> Column:
    """The first digits of a hexadecimal hash in base 64, which takes two thirds of the signs."""
    return F.base64(F.unhex(F.substring(hash_, 1, digits)))


def tree(text: Column) -> Column:
    """The paragraphs' hashes, by section."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(lines, lambda line: F.transform(F.regexp_extract_all(line, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.sha2(p, 256)))


def fingerprint(leaves: Column) -> Column:
    """The fingerprint of a tree()."""
    sections = F.transform(leaves, lambda x: F.sha2(F.concat_ws("", x), 256))
    parts = F.transform(F.arrays_zip(sections.alias("s"), leaves.alias("p")), lambda z: F.concat(short(z["s"], SECTION_DIGITS), F.lit(":"), F.concat_ws("", F.transform(z["p"], lambda h: short(h, PARAGRAPH_DIGITS)))))
    return F.concat(F.sha2(F.concat_ws("", sections), 256), F.lit("|"), F.concat_ws(";", parts))


def leaves_of(tree_: Column) -> Column:
    """The distinct paragraphs of a tree(), as a fingerprint keeps them."""
    return F.array_distinct(F.transform(F.flatten(tree_), lambda h: short(h, PARAGRAPH_DIGITS)))


def leaves(print_: Column) -> Column:
    """The same from a fingerprint."""
    every = F.regexp_extract_all(F.regexp_replace(print_, "^[^|]*[|]|[A-Za-z0-9+/]{8}:|;", ""), F.lit("[A-Za-z0-9+/]{4}"), F.lit(0))
    return F.array_distinct(every)


def likeness(a: Column, b: Column, x: Column | None = None, y: Column | None = None) -> Column:
    """1 for equal roots, else twice the shared paragraphs' number over the sum of both texts' distinct paragraphs. x, y: the leaves of a and b, where they are at hand."""
    x, y = leaves(a) if x is None else x, leaves(b) if y is None else y
    same = F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1)
    return F.when(same, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(x) + F.size(y)))


def differing_sections(a: Column, b: Column) -> Column:
    """A struct of removed and added: numbers (from 1) of the sections of a that b lacks, and of those of b that a lacks, whatever their places; both empty if the roots are equal, or if the same sections stand in another order or number."""
    x, y = F.split(F.substring_index(a, "|", -1), ";"), F.split(F.substring_index(b, "|", -1), ";")
    lacking = lambda of, other: F.filter(F.sequence(F.lit(1), F.size(of)), lambda i: ~F.array_contains(other, F.element_at(of, i)))
    same, none = F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1), F.array().cast("array<int>")
    return F.struct(F.when(same, none).otherwise(lacking(x, y)).alias("removed"), F.when(same, none).otherwise(lacking(y, x)).alias("added"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every row."""
    return docs.select("doc_id", fingerprint(tree(F.col("text").cast("string"))).alias("fingerprint"))


def _bucket(doc_id: str, bounds: list[int]) -> Column:
    """How many of the ordered bounds are at most doc_id, found in two steps; -1 without id."""
    if not bounds:
        return F.when(F.col(doc_id).isNull(), -1).otherwise(0)
    step = max(64, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda array: F.size(F.filter(array, lambda b: b <= F.col(doc_id)))
    group = below(F.array(*[F.lit(g[0]) for g in groups]))
    own = F.element_at(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), F.greatest(group, F.lit(1)))
    return F.when(F.col(doc_id).isNull(), -1).when(group == 0, 0).otherwise((group - 1) * step + below(own))


def _printed(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with name: a text's fingerprint and leaves."""
    made = rows.withColumn("tree", tree(F.col(text)))
    return made.withColumn(name, F.struct(fingerprint(F.col("tree")).alias("print"), leaves_of(F.col("tree")).alias("leaves"))).drop("tree")


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text and own (fingerprint and leaves), with next_text and next_own: those of the next document in descending order of ids, after the last the first.

    Ids are dealt into buckets by their quantiles. Texts move once, to their bucket, where each row takes
    from the next one; the last row of a bucket takes from the first of the next bucket, of which there are as many as buckets.
    """
    least = F.lit(-(1 << 63))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if buckets is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(1, min(BUCKETS_MOST, size // BUCKET_BYTES + 1))
    cuts = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx("doc_id", cuts, 20 * buckets)).first()[0] if cuts else None
    rows = rows.withColumn("bucket", _bucket("doc_id", sorted(set(found or [])))).withColumn("h", F.xxhash64("text"))
    first = rows.groupBy("bucket").agg(F.max(F.struct(F.coalesce("doc_id", least).alias("doc_id"), "h")).alias("f"))
    # As many rows as buckets.
    around = W.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))
    whole = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = first.select(F.col("bucket").alias("b"), F.coalesce(F.lead("f").over(around), F.first("f").over(whole)).alias("f"))
    after = after.select("b", F.col("f.doc_id").alias("i"), F.col("f.h").alias("h"))
    head = rows.withColumn("i", F.coalesce("doc_id", least)).join(F.broadcast(after), ["i", "h"]).select("b", "text").dropDuplicates(["b"])
    head = _printed(head, "text", "own").select("b", F.struct("text", "own").alias("head"))
    # In as many partitions as any shuffle, so that the join below finds the texts where they are.
    chained = _printed(rows.repartition("bucket"), "text", "own")
    order = W.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("h"))
    chained = chained.withColumn("next", F.lead(F.struct("text", "own")).over(order))
    joined = chained.join(head, (F.col("bucket") == F.col("b")) & F.col("next").isNull(), "left").withColumn("next", F.coalesce("next", "head"))
    return joined.select("doc_id", "text", "own", F.col("next.text").alias("next_text"), F.col("next.own").alias("next_own"))


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document's."""
    rows = with_next(documents(spark, sf_dir)).withColumn("n_chars", F.char_length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - third), F.col("next_text").substr(F.lit(1), third))
    rows = _printed(rows.select("doc_id", "n_chars", "own", "next_own", edited.alias("edited")), "edited", "changed")
    near = lambda c: likeness(F.col("own.print"), F.col(f"{c}.print"), F.col("own.leaves"), F.col(f"{c}.leaves"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("own.print").alias("fingerprint"), F.col("changed.print").alias("edited_fingerprint"), near("changed").alias("near_edited"), near("next_own").alias("near_next"))


QUERIES = {"op5_merkle_fingerprints": op5_merkle_fingerprints}
SQL: dict[str, str] = {}
