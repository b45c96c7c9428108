"""Column functions: comparison values, hashes for splits, windows of sequences, mutations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metrics in the order in which a comparison looks for them.
METRIC_PRIORITY = ("Spearman", "AUC", "F1_Macro", "F1", "MCC", "Accuracy", "Recall@10", "R2", "MSE")
#: One-letter symbols of amino acids, in alphabetical order.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def split_hash(seed: int | str, *keys: str) -> Column:
    """A number below 2**32 from the md5 of seed and keys, the same in any engine and partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def comparison_value(metric: Column, value: Column) -> Column:
    """The value with more being better: errors are negated."""
    return F.when(metric == "MSE", -value).otherwise(value)


def relative_delta(value: Column, base: Column, metric: Column | None = None) -> Column:
    """Per cent of change against base, positive for better."""
    change = (value - base) / F.greatest(F.abs(base), F.lit(1e-12)) * 100
    return change if metric is None else F.when(metric == "MSE", -change).otherwise(change)


def delta_sign(delta: Column, dead: float = 1e-4) -> Column:
    """up, down or same, within a dead band."""
    return F.when(delta > dead, "up").when(delta < -dead, "down").otherwise("same")


def sample_key(samples: Column) -> Column:
    """A sample limit as text: Full where there is none."""
    text = F.trim(samples.cast("string"))
    return F.when(text.isNull() | text.isin("", "Full"), "Full").otherwise(text.try_cast("double").cast("bigint").cast("string"))


def safe_name(name: Column) -> Column:
    """A model name that can be a path."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def short_name(name: Column) -> Column:
    """The part of a model name after its last slash."""
    return F.element_at(F.split(name, "/"), -1)


def rounded(value: Column) -> Column:
    """Five digits, halves to even."""
    return F.bround(value, 5)


def centred_window(position: Column, length: Column, window: int) -> Column:
    """Start (from 0, inclusive) and end (exclusive) of a window around a position, kept inside the sequence."""
    half = window // 2
    start = F.when(length <= window, 0).when(position < half, 0).when(position + half >= length, length - window).otherwise(position - half)
    return F.struct(start.cast("int").alias("start"), F.least(length, start + window).cast("int").alias("end"))


def crop(sequence: Column, window: int, truncate: bool) -> Column:
    """Sequences longer than window are cut to their centre, or become null."""
    cut = F.substring(sequence, F.floor((F.length(sequence) - window) / 2).cast("int") + 1, F.lit(window)) if truncate else F.lit(None)
    return F.when(F.length(sequence) <= window, sequence).otherwise(cut)


def differences(wild: Column, mutant: Column) -> Column:
    """Positions (from 0) and symbols in which two sequences of equal length differ; null for unequal lengths."""
    zipped = F.zip_with(F.split(wild, ""), F.split(mutant, ""), lambda w, m: F.struct(w.alias("wt"), m.alias("mut")))
    placed = F.transform(zipped, lambda x, i: F.struct(i.cast("int").alias("pos"), x["wt"].alias("wt"), x["mut"].alias("mut")))
    return F.when(F.length(wild) == F.length(mutant), F.filter(placed, lambda x: x["wt"] != x["mut"]))


def parse_mutations(text: Column) -> Column:
    """`A12G:C40D` as an array of position (from 0), wild type and mutant, in order of positions; empty for null, blank or WT."""
    one = lambda m: F.struct((F.regexp_extract(m, r"^[A-Z](\d+)[A-Z]$", 1).cast("int") - 1).alias("pos"), F.substring(m, 1, 1).alias("wt"), F.substring(m, -1, 1).alias("mut"))
    none = F.array().cast("array<struct<pos:int,wt:string,mut:string>>")
    return F.when(text.isNull() | (F.trim(text) == "") | (F.upper(text) == "WT"), none).otherwise(F.array_sort(F.transform(F.split(text, ":"), one)))


def shift_mutations(text: Column, by: int) -> Column:
    """Mutation text with all positions moved."""
    return F.array_join(F.transform(F.split(text, ":"), lambda m: F.concat(F.substring(m, 1, 1), (F.regexp_extract(m, r"(\d+)", 1).cast("int") + by).cast("string"), F.substring(m, -1, 1))), ":")


def apply_mutations(sequence: Column, mutations: Column, alphabet: str = AMINO_ACIDS) -> Column:
    """The sequence with all mutations put in; null where a mutation names another wild type than the sequence has, or a symbol outside the alphabet."""
    fits = F.forall(mutations, lambda m: (F.substring(sequence, m["pos"] + 1, F.lit(1)) == m["wt"]) & F.contains(F.lit(alphabet), m["mut"]))
    return F.when(fits, F.aggregate(mutations, sequence, lambda s, m: F.overlay(s, m["mut"], m["pos"] + 1, F.lit(1))))


def standardised(value: Column, mean: Column, deviation: Column) -> Column:
    """The value less the mean, over the deviation and a little more."""
    return (value - mean) / (deviation + 1e-10)


def missing_parts(vector: Column) -> Column:
    """How many parts of a vector are null or no number: those that unit() counts as 0."""
    return F.size(F.filter(vector, lambda x: x.isNull() | F.isnan(x)))


def unit(vector: Column) -> Column:
    """A vector of length one; zero vectors and missing parts: parts become 0."""
    clean = F.transform(vector, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))
    norm = F.sqrt(F.aggregate(clean, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(clean, lambda x: x / norm)).otherwise(clean)


def dot(a: Column, b: Column) -> Column:
    """The product of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clean_sequence(sequence: Column) -> Column:
    """Upper case, signs that are no letters as X; X for an empty one."""
    x = F.regexp_replace(F.upper(sequence), "[^A-Z]", "X")
    return F.when(F.length(x) == 0, "X").otherwise(x)


def kmers(sequence: Column, k: int, alphabet: str = AMINO_ACIDS) -> Column:
    """All k-mers of the runs of alphabet signs; none goes over another sign."""
    if k < 1:
        raise ValueError("k must be positive")
    large = F.translate(sequence, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    runs = F.filter(F.split(large, f"[^{alphabet}]"), lambda r: F.length(r) >= k)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (k - 1)), lambda i: F.substring(r, i, F.lit(k)))))
