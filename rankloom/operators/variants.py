"""Scores of sequence variants from profiles, ensembles of scores, windows along positions."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions import AMINO_ACIDS, differences
from rankloom.operators.metrics import spearman, tasks


def variant_scores(variants: DataFrame, profile: DataFrame, alphabet: str = AMINO_ACIDS) -> DataFrame:
    """variant_id and score: the sum over mutated positions of logp(mutant) - logp(wild type).

    variants: variant_id, wt_id, wt, mut; profile: wt_id, pos, symbol, logp. Positions with a symbol outside
    the alphabet are skipped; a missing profile row or unequal lengths make the score null; no differences 0.
    """
    diffs = variants.select("variant_id", "wt_id", differences(F.col("wt"), F.col("mut")).alias("_d"))
    each = diffs.select("variant_id", "wt_id", F.explode("_d").alias("x")).select("variant_id", "wt_id", "x.*")
    each = each.filter(F.expr(f"instr('{alphabet}', wt) > 0 and instr('{alphabet}', mut) > 0"))
    p = profile.select("wt_id", "pos", "symbol", "logp")
    j = each.join(p.withColumnsRenamed({"symbol": "wt", "logp": "lw"}), ["wt_id", "pos", "wt"], "left").join(p.withColumnsRenamed({"symbol": "mut", "logp": "lm"}), ["wt_id", "pos", "mut"], "left")
    s = j.groupBy("variant_id").agg(F.sum(F.col("lm") - F.col("lw")).alias("_s"), F.count_if(F.col("lm").isNull() | F.col("lw").isNull()).alias("_m"))
    return diffs.join(s, "variant_id", "left").select("variant_id", F.when(F.col("_d").isNotNull() & (F.coalesce("_m", F.lit(0)) == 0), F.coalesce("_s", F.lit(0.0))).alias("score"))


def mutated_positions(variants: DataFrame) -> DataFrame:
    """wt_id and pos of all positions that a variant changes."""
    return variants.select("wt_id", F.explode(differences(F.col("wt"), F.col("mut"))).alias("x")).select("wt_id", "x.pos").distinct()


def mean_log_likelihood(sequences: DataFrame, profile: DataFrame, alphabet: str = AMINO_ACIDS) -> DataFrame:
    """id and the mean logp of its canonical symbols at their positions. sequences: id, wt_id, seq."""
    each = sequences.select("id", "wt_id", F.posexplode(F.split("seq", "")).alias("pos", "symbol")).filter(F.expr(f"instr('{alphabet}', symbol) > 0"))
    return each.join(profile, ["wt_id", "pos", "symbol"]).groupBy("id").agg(F.avg("logp").alias("mean_logp"))


def consensus(sequences: DataFrame, group: str, key: str, sequence: str) -> DataFrame:
    """The most common symbol of each position in a group; of equally common ones that of the first row by key."""
    each = sequences.select(group, key, F.posexplode(F.split(sequence, "")).alias("pos", "symbol"))
    counts = each.groupBy(group, "pos", "symbol").agg(F.count("*").alias("n"), F.min(key).alias("k"))
    best = counts.groupBy(group, "pos").agg(F.max_by("symbol", F.struct("n", -F.col("k"))).alias("s"))
    return best.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "").alias("consensus"))


def z_scores(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """z_<column>: less the group's mean, over its population deviation; 0 where that is about 0."""
    df = df.repartition(tasks(df, df.count()), group)  # no task's part grows with the rows
    stats = df.groupBy(group).agg(*[x for c in columns for x in (F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_d_{c}"))])
    out = df.hint("merge").join(stats, group)
    for c in columns:
        out = out.withColumn(f"z_{c}", F.when(F.col(f"_d_{c}") <= 1e-8, 0.0).otherwise((F.col(c) - F.col(f"_a_{c}")) / F.col(f"_d_{c}"))).drop(f"_a_{c}", f"_d_{c}")
    return out


def ensemble_scores(df: DataFrame, group: str, terms: dict[str, float], out: str = "ensemble") -> DataFrame:
    """df with out, the weighted sum of the terms' z-scores within the group, and n_terms. A term that is null or not finite for any row of a group is left out for the whole group, so that its rows stay comparable."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    whole = df.groupBy(group).agg(*[F.bool_and(finite(c)).alias(f"_w_{c}") for c in terms])
    clean = df.join(whole, group).withColumns({f"_t_{c}": F.when(F.col(f"_w_{c}"), F.col(c).cast("double")) for c in terms})
    z = z_scores(clean, group, [f"_t_{c}" for c in terms])
    total = sum((F.when(F.col(f"_w_{c}"), F.col(f"z__t_{c}") * w).otherwise(0.0) for c, w in terms.items()), F.lit(0.0))
    n = sum((F.col(f"_w_{c}").cast("int") for c in terms), F.lit(0))
    return z.withColumns({out: total, "n_terms": n}).select(*df.columns, out, "n_terms")


def ensemble_grid(df: DataFrame, group: str, measured: str, terms: list[str], step: float) -> DataFrame:
    """weights (as text) and the mean over groups of the Spearman correlation of the weighted z-scores, for all weights of the simplex at a step."""
    parts = round(1 / step)
    grid = [[]]
    for k in range(len(terms)):
        grid = [w + [i] for w in grid for i in (range(parts - sum(w) + 1) if k + 1 < len(terms) else [parts - sum(w)])]
    z = z_scores(df, group, terms)
    mixed = z.select(group, measured, F.explode(F.array(*[F.struct(F.lit("/".join(f"{i / parts:.2f}" for i in w)).alias("weights"), sum((F.col(f"z_{t}") * (i / parts) for t, i in zip(terms, w, strict=True)), F.lit(0.0)).alias("s")) for w in grid])).alias("x")).select(group, measured, "x.*")
    per = spearman(mixed.withColumn("s", F.round("s", 9)), "s", measured, ["weights", group])
    return per.groupBy("weights").agg(F.avg("spearman").alias("mean_spearman"))


def symmetric_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, pos and sum (p - q)(log p - log q) / 2 of two profiles of id, pos, symbol, logp."""
    j = a.select("id", "pos", "symbol", F.col("logp").alias("lp")).join(b.select("id", "pos", "symbol", F.col("logp").alias("lq")), ["id", "pos", "symbol"])
    return j.groupBy("id", "pos").agg((F.sum((F.exp("lp") - F.exp("lq")) * (F.col("lp") - F.col("lq"))) / 2).alias("divergence"))


def window_divergence(divergence: DataFrame, mutations: DataFrame, reach: int) -> DataFrame:
    """variant_id and score: less the divergence summed over the positions around each mutation, over all of a variant's mutations. divergence: wt_id, pos, divergence; mutations: variant_id, wt_id, pos."""
    around = window_sum(divergence, "wt_id", "pos", "divergence", reach, "_w")
    return mutations.join(around.select("wt_id", "pos", "_w"), ["wt_id", "pos"]).groupBy("variant_id").agg((-F.sum("_w")).alias("score"))


def soft_target_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, pos and sum p (log p - log q) of two profiles of id, pos, symbol, logp: the change that b's log probabilities mean under a's."""
    j = a.select("id", "pos", "symbol", F.col("logp").alias("lp")).join(b.select("id", "pos", "symbol", F.col("logp").alias("lq")), ["id", "pos", "symbol"])
    return j.groupBy("id", "pos").agg(F.sum(F.exp("lp") * (F.col("lq") - F.col("lp"))).alias("delta"))


def conservation_delta(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key and score: less the mean squared change of a value at a variant's positions."""
    return pairs.groupBy(key).agg(F.avg(-(F.col(b) - F.col(a)) * (F.col(b) - F.col(a))).alias("score"))


def weighted_scores(changes: DataFrame, weights: DataFrame) -> DataFrame:
    """variant_id and score: the sum of each mutated position's change times the position's weight. changes: variant_id, wt_id, pos, change; weights: wt_id, pos, weight (1 where there is none)."""
    j = changes.join(weights, ["wt_id", "pos"], "left")
    return j.groupBy("variant_id").agg(F.sum(F.col("change") * F.coalesce("weight", F.lit(1.0))).alias("score"))


def likelihood_delta(mutants: DataFrame, wild: DataFrame) -> DataFrame:
    """id and delta: a mutant's mean log likelihood less its wild type's. mutants: id, wt_id, mean_logp; wild: wt_id, mean_logp."""
    return mutants.join(wild.select("wt_id", F.col("mean_logp").alias("_w")), "wt_id").select("id", (F.col("mean_logp") - F.col("_w")).alias("delta"))


def edited_pairs(variants: DataFrame, reach: int | None = None) -> DataFrame:
    """variant_id, wt_pos, mut_pos, mut_at, is_edit of aligned positions of wild type and mutant; replaced ones count as aligned, and positions without a partner have null there (mut_at: mut_pos, or where in the mutant a position was deleted). With reach, those at most so far from an edit in the wild type.

    Alignment is by longest common blocks within a row; only rows of sequences pass through Python.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for key, wt, mut in zip(x["variant_id"], x["wt"], x["mut"], strict=True):
                for tag, a, b, c, d in SequenceMatcher(None, wt or "", mut or "", autojunk=False).get_opcodes():
                    both = min(b - a, d - c)
                    rows += [(key, a + k, c + k, c + k, tag != "equal") for k in range(both)]
                    rows += [(key, i, None, d, True) for i in range(a + both, b)] + [(key, None, i, i, True) for i in range(c + both, d)]
            out = pd.DataFrame(rows, columns=["variant_id", "wt_pos", "mut_pos", "mut_at", "is_edit"])
            yield out.astype({"wt_pos": "Int64", "mut_pos": "Int64"})

    kind = dict(variants.dtypes)["variant_id"]
    pairs = variants.select("variant_id", "wt", "mut").mapInPandas(run, f"variant_id {kind}, wt_pos bigint, mut_pos bigint, mut_at bigint, is_edit boolean")
    if reach is None:
        return pairs
    span = pairs.filter("is_edit and wt_pos is not null").groupBy("variant_id").agg((F.min("wt_pos") - reach).alias("_lo"), (F.max("wt_pos") + reach).alias("_hi"))
    return pairs.join(span, "variant_id").filter("wt_pos between _lo and _hi").drop("_lo", "_hi")


def edit_spans(pairs: DataFrame, pad: int = 0) -> DataFrame:
    """variant_id, start, end (exclusive): the positions of the mutant that enclose all its edits, at least one, padded; 0 and 0 where nothing is edited. pairs: of edited_pairs()."""
    edit = F.col("is_edit")
    per = pairs.groupBy("variant_id").agg(F.min(F.when(edit, F.col("mut_at"))).alias("lo"), F.max(F.when(edit, F.coalesce(F.col("mut_pos") + 1, F.col("mut_at")))).alias("hi"), (F.max("mut_pos") + 1).alias("length"))
    end = F.least("length", F.greatest("hi", F.col("lo") + 1) + pad)
    return per.select("variant_id", F.when(F.col("lo").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("lo") - pad)).alias("start"), F.when(F.col("lo").isNull(), 0).otherwise(end).alias("end"))


def window_sum(df: DataFrame, key: str, pos: str, value: str, reach: int, out: str) -> DataFrame:
    """The sum of a value over the positions from pos - reach to pos + reach."""
    return df.withColumn(out, F.sum(value).over(W.partitionBy(key).orderBy(pos).rangeBetween(-reach, reach)))


def conservation_weights(df: DataFrame, key: str, value: str) -> DataFrame:
    """weight: the sigmoid of the negative z-score of the value within the key, from 0.2 to 1."""
    z = z_scores(df, key, [value])
    return z.withColumn("weight", F.greatest(F.lit(0.2), F.least(F.lit(1.0), 1 / (1 + F.exp(F.col(f"z_{value}")))))).drop(f"z_{value}")
