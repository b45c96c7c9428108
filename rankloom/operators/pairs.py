"""Pairs of positions: contacts, precision of ranked pairs, corrections of pair matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.metrics import GROUP_ROWS, _bucket, quantiles, tasks

#: Bands of separation (from, below) by name.
BANDS = (("short", 6, 12), ("medium", 12, 24), ("long", 24, 1 << 30))
#: Buckets of scores.
BUCKETS = 256


def dealt(rows: DataFrame, protein: str) -> DataFrame:
    """Rows of positions dealt to tasks by protein, as many tasks as their pairs need: what one task makes and sorts doesn't grow with the rows, and what follows by protein (windows, joins, aggregates) takes place where its pairs are made."""
    n = F.col("count")
    proteins, made = rows.groupBy(protein).count().agg(F.count("*"), F.sum(F.floor(n * (n - 1) / 2))).first()
    return rows.repartition(max(1, min(proteins, tasks(rows, made or 0))), protein)


def contacts(positions: DataFrame, threshold: float = 8.0, least: int = 1, most: int | None = None) -> DataFrame:
    """protein, i, j (i < j), distance, contact of all pairs of valid positions at least so far apart in sequence. positions: protein, pos, x, y, z, valid."""
    p = positions.filter("valid").select("protein", "pos", "x", "y", "z")
    a, b = (p.select("protein", *[F.col(c).alias(f"{c}_{s}") for c in ("pos", "x", "y", "z")]) for s in ("i", "j"))
    apart = F.col("pos_j") - F.col("pos_i")
    near = (apart >= least) if most is None else (apart >= least) & (apart <= most)
    d = F.sqrt(sum(((F.col(f"{c}_i") - F.col(f"{c}_j")) * (F.col(f"{c}_i") - F.col(f"{c}_j")) for c in ("x", "y", "z")), F.lit(0.0)))
    return a.join(b, "protein").filter(near).select("protein", F.col("pos_i").alias("i"), F.col("pos_j").alias("j"), d.alias("distance"), (d < threshold).alias("contact"))


def near_pairs(positions: DataFrame, threshold: float = 8.0, least: int = 1) -> DataFrame:
    """protein, i, j (i < j), distance of the contacts alone: valid positions nearer than threshold and at least so far apart in sequence. positions: protein, pos, x, y, z, valid.

    Space is cut into cells as wide as the threshold. A position meets those of its own cell and of 13 neighbouring ones, which with the others'
    13 make all 26: each pair of cells meets once, and no pair of a protein's positions is formed that isn't in neighbouring cells.
    """
    at = [F.floor(F.col(c) / threshold).cast("bigint") for c in ("x", "y", "z")]
    p = positions.filter("valid and x is not null and y is not null and z is not null").select("protein", "pos", "x", "y", "z", *[c.alias(f"c{k}") for k, c in enumerate(at)])
    # One of each two opposite steps, and no step.
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"s{k}") for k, v in enumerate(s)]) for s in steps])).alias("s")
    a = p.select("*", step).select("protein", *[F.col(c).alias(f"{c}_a") for c in ("pos", "x", "y", "z")], *[(F.col(f"c{k}") + F.col(f"s.s{k}")).alias(f"c{k}") for k in range(3)], ((F.col("s.s0") == 0) & (F.col("s.s1") == 0) & (F.col("s.s2") == 0)).alias("same"))
    b = p.select("protein", *[F.col(c).alias(f"{c}_b") for c in ("pos", "x", "y", "z")], "c0", "c1", "c2")
    met = a.join(b, ["protein", "c0", "c1", "c2"]).filter(~F.col("same") | (F.col("pos_a") < F.col("pos_b")))
    d = F.sqrt(sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in ("x", "y", "z")), F.lit(0.0)))
    i, j = F.least("pos_a", "pos_b"), F.greatest("pos_a", "pos_b")
    return met.filter((d < threshold) & (j - i >= max(1, least))).select("protein", i.alias("i"), j.alias("j"), d.alias("distance"))


def _first(pairs: DataFrame, lengths: DataFrame, least: int) -> DataFrame:
    """pairs with their length and _r, their place in the order of their protein and band, up to max(1, length // least)."""
    order = W.partitionBy("protein", "band").orderBy(F.desc("score"), "i", "j")
    return pairs.withColumn("_r", F.row_number().over(order)).join(lengths, "protein").filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("length") / least)))


def _needed(banded: DataFrame, lengths: DataFrame, least: int) -> DataFrame:
    """Of large proteins and bands the candidates of the buckets of scores that hold the first ones: a histogram says from which bucket on they are enough."""
    bucket = F.coalesce(_bucket("score", quantiles(banded, ["score"], BUCKETS)["score"]), F.lit(-1))
    banded = banded.withColumn("_b", bucket)
    counts = banded.groupBy("protein", "band", "_b").agg(F.count("*").alias("_n"))
    above = F.coalesce(F.sum("_n").over(W.partitionBy("protein", "band").orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = lengths.select("protein", F.greatest(F.lit(1), F.floor(F.col("length") / least)).alias("_w"))
    cut = counts.withColumn("_a", above).join(wanted, "protein").filter("_a < _w").groupBy("protein", "band").agg(F.min("_b").alias("_cut"))
    return banded.join(cut, ["protein", "band"]).filter(F.col("_b") >= F.col("_cut")).drop("_b", "_cut")


def precision_at(pairs: DataFrame, lengths: DataFrame, parts: list[int], bands: tuple = BANDS, most: int = GROUP_ROWS) -> DataFrame:
    """protein, band, part, precision: among the first max(1, length // part) candidates by score (then i, j) the share of contacts. pairs: protein, i, j, score, contact; lengths: protein, length.

    A protein's candidates in a band are ordered where they are if there are at most so many (most); pairs that are dealt by protein are then never
    shuffled. Of larger ones only the buckets of scores that hold the first ones are ordered.
    """
    apart = F.col("j") - F.col("i")
    band = F.coalesce(*[F.when((apart >= a) & (apart < b), n) for n, a, b in bands])
    banded = pairs.select("protein", "i", "j", "score", "contact", band.alias("band")).filter("band is not null")
    large = banded.groupBy("protein", "band").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("protein", "band")
    if large.isEmpty():
        first = _first(banded, lengths, min(parts))
    else:
        # At most one large group for each so many rows is broadcast.
        small, needed = banded.join(F.broadcast(large), ["protein", "band"], "left_anti"), _needed(banded.join(F.broadcast(large), ["protein", "band"], "left_semi"), lengths, min(parts))
        first = _first(small, lengths, min(parts)).unionByName(_first(needed, lengths, min(parts)))
    long = first.select("protein", "band", "_r", "contact", "length", F.explode(F.array(*[F.lit(p) for p in parts])).alias("part"))
    top = long.filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("length") / F.col("part"))))
    return top.groupBy("protein", "band", "part").agg(F.avg(F.col("contact").cast("double")).alias("precision"))


def mean_or_zero(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The mean of values that are there; 0 where none is."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias(value))


def average_product_correction(matrix: DataFrame) -> DataFrame:
    """protein, i, j, score less row sum times column sum over the whole sum; unchanged where that is 0."""
    rows = matrix.groupBy("protein", "i").agg(F.sum("score").alias("_r"))
    cols = matrix.groupBy("protein", "j").agg(F.sum("score").alias("_c"))
    total = matrix.groupBy("protein").agg(F.sum("score").alias("_t"))
    out = matrix.join(rows, ["protein", "i"]).join(cols, ["protein", "j"]).join(total, "protein")
    return out.select("protein", "i", "j", F.when(F.col("_t") == 0, F.col("score")).otherwise(F.col("score") - F.col("_r") * F.col("_c") / F.col("_t")).alias("score"))


def coupling(responses: DataFrame, band: int = 6) -> DataFrame:
    """protein, i, j, score from responses of protein, i, mutant a, j, symbol b, value (the change of b's score at j when i becomes a): centred over a and b, Frobenius norm, symmetrised, corrected, 0 near the diagonal."""
    m = responses
    for keys in (["protein", "i", "j", "b"], ["protein", "i", "j", "a"]):
        mean = m.groupBy(*keys).agg(F.avg("value").alias("_m"))
        m = m.join(mean, keys).withColumn("value", F.col("value") - F.col("_m")).drop("_m")
    norm = m.groupBy("protein", "i", "j").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("s"))
    turned = norm.select("protein", F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("t"))
    both = norm.join(turned, ["protein", "i", "j"], "left").select("protein", "i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise((F.col("s") + F.coalesce("t", F.lit(0.0))) / 2).alias("score"))
    done = average_product_correction(both)
    return done.withColumn("score", F.when(F.abs(F.col("i") - F.col("j")) < band, 0.0).otherwise(F.col("score")))


def pair_features(residues: DataFrame, pairs: DataFrame) -> DataFrame:
    """protein, i, j and features: products and absolute differences of both vectors' parts, and log1p of the separation. residues: protein, pos, vec."""
    a, b = (residues.select("protein", F.col("pos").alias(s), F.col("vec").alias(f"_{s}")) for s in ("i", "j"))
    both = pairs.join(a, ["protein", "i"]).join(b, ["protein", "j"])
    f = F.concat(F.zip_with("_i", "_j", lambda x, y: x.cast("double") * y.cast("double")), F.zip_with("_i", "_j", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.array(F.log1p(F.abs(F.col("i") - F.col("j")))))
    return both.withColumn("features", f).drop("_i", "_j")
