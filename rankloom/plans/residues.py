"""Queries of positions, pairs of positions, mutations and probes on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom import functions as fn
from rankloom.operators import features, metrics, pairs, prepare, probes, similarity, variants
from rankloom.plans.neighbours import _E, _POS, _RES, _positions, _residues
from rankloom.plans.results import _LOGP, _VAR, _probe_sides, _profile, _variants
from rankloom.plans.tables import rounded, table, vectors


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """Each vector cut into eight positions, with the digits of a number as labels, some of them too few; 9 says that there is no truth."""
    v = table(spark, d, "embeddings")
    digits = F.substring((F.col("vec_id") * 7919 + 12345678).cast("string"), F.lit(1), F.lit(8) - (F.col("vec_id") % 3 == 0).cast("int"))
    labels = F.transform(prepare.digit_scores(digits), lambda x: F.when(x == 9, -1).otherwise(x))
    rows = v.select(F.col("vec_id").alias("protein"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8)).alias("vectors"), labels.alias("labels"), F.lit(8).alias("length"))
    return prepare.aligned(rows, ["protein"], "vectors", "labels", "length", 100)


def aligned_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = prepare.without_ignored(_aligned(spark, d))
    return rounded(rows.groupBy("protein").agg(F.count("*").alias("n"), F.max("misaligned").alias("misaligned"), F.sum("label").alias("labels"), F.sum(F.col("vec")[0].cast("double")).alias("first")), 5)


def pair_embedding(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("id", "vector")
    p = v.select(F.col("id").alias("left"), F.pmod(F.col("id") * 7 + 1, F.lit(v.count())).alias("right"))
    total = F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * i), F.lit(0.0), lambda a, x: a + x)
    return rounded(features.pair_vectors(p, v, "left", "right").select("left", "right", F.size("vector").alias("width"), total.alias("total")), 3)


def _cosines(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    wild = v.groupBy("label").agg(F.min("id").alias("wild"))
    return features.cosine_to(v.join(wild, "label").select("id", "label", "wild"), v, "id", "wild")


def wildtype_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = _cosines(spark, d).withColumn("cosine", F.round("cosine", 9)).withColumn("measured", F.col("id") * 7919 % 1000)
    return rounded(metrics.spearman(rows, "measured", "cosine", ["label"]).join(rows.groupBy("label").agg(F.avg("cosine").alias("mean")), "label"))


def pair_features(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("protein"), F.explode(F.array(F.struct(F.lit(0).alias("i"), F.lit(5).alias("j")), F.struct(F.lit(1).alias("i"), F.lit(7).alias("j")))).alias("x")).select("protein", "x.*")
    f = pairs.pair_features(_residues(spark, d), p)
    return rounded(f.select("protein", "i", "j", F.posexplode("features").alias("place", "value")), 5)


def coupling(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("protein"), F.posexplode("embedding").alias("p", "value"))
    place = lambda size, n: (F.floor(F.col("p") / size) % n).cast("int")
    responses = e.select("protein", (place(32, 2) * 10).alias("i"), (place(16, 2) * 10).alias("j"), place(4, 4).alias("a"), place(1, 4).alias("b"), F.col("value").cast("double").alias("value"))
    return rounded(pairs.coupling(responses), 5)


def balanced_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = pairs.contacts(_positions(spark, d), 8.0, 6).withColumn("k", F.concat_ws("-", "protein", "i", "j"))
    kept = prepare.balanced_pairs(c, "protein", "contact", "k", 42, 2000)
    return kept.groupBy("protein", "contact").agg(F.count("*").alias("n"), F.sum(F.col("i") * 1000 + F.col("j")).alias("places"))


def triplet_levels(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("label")
    c, a = (label % 2).cast("string"), F.concat_ws(".", (label % 2).cast("string"), (label % 5).cast("string"))
    v = vectors(spark, d).select("id", "vector", c.alias("c"), a.alias("a"), F.concat_ws(".", a, label.cast("string")).alias("h"))
    return rounded(similarity.triplet_loss(similarity.hard_triplets(v, {"c": None, "a": "c", "h": "a"}, F.col("id") % 20 == 0)), 5)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    v = _variants(spark, d).select("variant_id", "wt_id", F.explode(fn.differences(F.col("wt"), F.col("mut"))).alias("x")).select("variant_id", "wt_id", "x.*")
    p = _profile(spark, d)
    side = lambda s: p.select("wt_id", "pos", F.col("symbol").alias(s), F.col("logp").alias(f"l_{s}"))
    return v.join(side("wt"), ["wt_id", "pos", "wt"]).join(side("mut"), ["wt_id", "pos", "mut"]).select("variant_id", "wt_id", "pos", (F.col("l_mut") - F.col("l_wt")).alias("change"))


def weighted_variant_score(spark: SparkSession, d: str) -> DataFrame:
    places = _profile(spark, d).select("wt_id", "pos").distinct().withColumn("v", ((F.col("wt_id").cast("int") * 7 + F.col("pos") * 3) % 11).cast("double"))
    return rounded(variants.weighted_scores(_changes(spark, d), variants.conservation_weights(places, "wt_id", "v").select("wt_id", "pos", "weight")), 5)


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each position's vector as two distributions over eight symbols: of its parts, and of half of them."""
    each = _residues(spark, d).select(F.col("protein").cast("string").alias("id"), "pos", F.posexplode("vec").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    whole = W.partitionBy("id", "pos")
    of = lambda x: each.select("id", "pos", F.substring(F.lit("ACDEFGHI"), F.col("i") + 1, F.lit(1)).alias("symbol"), (x - F.log(F.sum(F.exp(x)).over(whole))).alias("logp"))
    return of(F.col("x")), of(F.col("x") * 0.5)


def position_window_divergence(spark: SparkSession, d: str) -> DataFrame:
    div = variants.symmetric_divergence(*_profiles(spark, d)).withColumnRenamed("id", "wt_id")
    n = table(spark, d, "embeddings").count()
    places = F.array_distinct(F.array(F.col("c_nationkey") % 8, (F.col("c_nationkey") * 3 + 1) % 8))
    changes = table(spark, d, "customer").select(F.col("c_custkey").alias("variant_id"), (F.col("c_custkey") % n).cast("string").alias("wt_id"), F.explode(places.cast("array<int>")).alias("pos"))
    return rounded(variants.window_divergence(div, changes, 2), 5)


def soft_target_delta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(variants.soft_target_delta(*_profiles(spark, d)), 5)


def conservation_delta(spark: SparkSession, d: str) -> DataFrame:
    c = _changes(spark, d).withColumns({"a": (F.col("pos") % 4).cast("double"), "b": F.col("change")})
    return rounded(variants.conservation_delta(c, "variant_id", "a", "b"), 5)


def likelihood_delta(spark: SparkSession, d: str) -> DataFrame:
    v = _variants(spark, d)
    seqs = v.select(F.col("variant_id").alias("id"), "wt_id", F.col("mut").alias("seq"))
    mutants = variants.mean_log_likelihood(seqs, _profile(spark, d)).join(seqs.select("id", "wt_id"), "id")
    wild = variants.mean_log_likelihood(v.select(F.col("wt_id").alias("id"), "wt_id", F.col("wt").alias("seq")).distinct(), _profile(spark, d)).withColumnRenamed("id", "wt_id")
    return rounded(variants.likelihood_delta(mutants, wild))


def mutation_windows(spark: SparkSession, d: str) -> DataFrame:
    c = _changes(spark, d).select("variant_id", "pos", fn.centred_window(F.col("pos"), F.lit(9), 4).alias("w"))
    return c.select("variant_id", "pos", "w.start", "w.end")


def mutation_strings(spark: SparkSession, d: str) -> DataFrame:
    v = _variants(spark, d)
    each = F.transform(fn.differences(F.col("wt"), F.col("mut")), lambda x: F.concat(x["wt"], (x["pos"] + 1).cast("string"), x["mut"]))
    text = F.when(F.size(each) == 0, "WT").otherwise(F.array_join(each, ":"))
    rows = v.select("variant_id", "wt", "mut", text.alias("text"))
    parsed = fn.parse_mutations(F.col("text"))
    wrong = fn.apply_mutations(F.col("wt"), fn.parse_mutations(F.lit("Z1A")))
    return rows.select("variant_id", "text", F.size(parsed).alias("n"), F.when(F.col("text") != "WT", fn.shift_mutations(F.col("text"), 10)).alias("shifted"), (fn.apply_mutations(F.col("wt"), parsed) == F.col("mut")).alias("whole"), wrong.isNull().alias("refused"))


def missing_parts(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).withColumn("vector", F.transform("vector", lambda x, i: F.when((i + F.col("id")) % 9 == 0, F.lit(float("nan"))).otherwise(x.cast("double"))))
    u = v.select("id", fn.missing_parts(F.col("vector")).cast("bigint").alias("n_missing"), fn.unit(F.col("vector")).alias("u"))
    return rounded(u.select("id", "n_missing", F.aggregate("u", F.lit(0.0), lambda a, x: a + x).alias("total")), 5)


def edit_spans(spark: SparkSession, d: str) -> DataFrame:
    return variants.edit_spans(variants.edited_pairs(_variants(spark, d)), 1)


def probe_gbt(spark: SparkSession, d: str) -> DataFrame:
    return probes.evaluate(probes.fit_predict(*_probe_sides(spark, d), "vector", "gbt", "regression"), "regression")


def multilabel_ovr(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("label") % 2 == 0, "even").otherwise("odd")
    a, b = (x.withColumn("labels", F.array(size, F.concat(F.lit("m"), (F.col("label") % 3).cast("string")))) for x in _probe_sides(spark, d))
    names = ["even", "m0", "m1", "m2", "odd"]
    return metrics.multilabel_metrics(probes.multilabel(a, b, "vector", "labels", names), "id", "labels", "predicted")


def pair_probe(spark: SparkSession, d: str) -> DataFrame:
    """Are two positions' vectors on one side of their table's first component? After PCA, balanced pairs, whole proteins on one side of the split; products of parts say it."""
    rows = probes.reduced(_residues(spark, d), "vec", 4, 1.0)
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("protein"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(8) for j in range(i + 1, 8)])).alias("x")).select("protein", "x.*")
    f = pairs.pair_features(rows, p).withColumn("contact", F.col("features")[0] > 0).withColumn("k", F.concat_ws("-", "protein", "i", "j"))
    f = f.repartition(metrics.tasks(p, p.count()), "protein")
    even = prepare.balanced_pairs(f, "protein", "contact", "k", 42).withColumn("y", F.col("contact").cast("double"))
    folded = prepare.folds(even, 4, 42, "k", group="protein")
    return probes.cross_validated(folded, "features", "linear", "classification", "fold").orderBy("fold")


def residue_probe(spark: SparkSession, d: str) -> DataFrame:
    return probes.residue_probe(_aligned(spark, d), "protein", 3, 42)


QUERIES = {f.__name__: f for f in (aligned_positions, pair_embedding, wildtype_cosine, pair_features, coupling, balanced_pairs, triplet_levels, weighted_variant_score, position_window_divergence, soft_target_delta, conservation_delta, likelihood_delta, mutation_windows, mutation_strings, missing_parts, edit_spans, probe_gbt, multilabel_ovr, pair_probe, residue_probe)}

_CHANGE = f"{_VAR}, ch AS (SELECT variant_id, wt_id, p, w, m, {_LOGP.format('m')} - {_LOGP.format('w')} AS change FROM e WHERE w <> m)"
_PROFILE = f"{_RES}, g AS (SELECT protein::VARCHAR AS id, pos, x - ln(sum(exp(x)) OVER (PARTITION BY protein, pos)) AS lp, x * 0.5 - ln(sum(exp(x * 0.5)) OVER (PARTITION BY protein, pos)) AS lq FROM d)"
SQL = {
    "aligned_positions": "WITH v AS (SELECT vec_id AS protein, embedding AS e, 8 - (vec_id % 3 = 0)::INT AS n, (vec_id * 7919 + 12345678)::VARCHAR AS s FROM embeddings), x AS (SELECT protein, n, unnest(range(n)) AS p, e, s FROM v), y AS (SELECT protein, n, s[p + 1]::INT AS l, e[p * 8 + 1]::DOUBLE AS f FROM x) SELECT protein, count(*) AS n, max((n <> 8)::INT) AS misaligned, sum(l)::BIGINT AS labels, round(sum(f), 5) AS first FROM y WHERE l <> 9 GROUP BY 1",
    "pair_embedding": f"WITH {_E}, j AS (SELECT a.id AS l, b.id AS r, list_concat(a.v, b.v) AS v FROM e a JOIN e b ON b.id = (a.id * 7 + 1) % (SELECT count(*) FROM e)) SELECT l AS \"left\", r AS \"right\", len(v)::INT AS width, round(list_dot_product(v, range(len(v))::DOUBLE[]), 3) AS total FROM j",
    "wildtype_cosine": f"WITH {_E}, w AS (SELECT label, min(id) AS wild FROM e GROUP BY 1), c AS (SELECT a.label, a.id * 7919 % 1000 AS y, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a JOIN w USING (label) JOIN e b ON b.id = wild), k AS (SELECT label, s, rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY label ORDER BY s) + (count(*) OVER (PARTITION BY label, s) - 1) / 2.0 AS rs FROM c) SELECT label, count(*) AS n, round(corr(ry, rs), 6) AS spearman, round(avg(s), 6) AS mean FROM k GROUP BY 1 HAVING count(*) >= 2",
    "pair_features": f"WITH {_RES}, q AS (SELECT a.protein, a.pos AS i, b.pos AS j, a.i AS k, a.x AS x, b.x AS y FROM d a JOIN d b ON a.protein = b.protein AND a.i = b.i AND ((a.pos = 0 AND b.pos = 5) OR (a.pos = 1 AND b.pos = 7))) SELECT protein, i::INT AS i, j::INT AS j, k::INT AS place, round(x * y, 5) AS value FROM q UNION ALL SELECT protein, i::INT, j::INT, (k + 8)::INT, round(abs(x - y), 5) FROM q UNION ALL SELECT DISTINCT protein, i::INT, j::INT, 16, round(ln(1 + j - i), 5) FROM q",
    "coupling": "WITH x AS (SELECT vec_id AS protein, unnest(range(64)) AS p, embedding AS e FROM embeddings), r AS (SELECT protein, (p // 32) * 10 AS i, (p // 16) % 2 * 10 AS j, (p // 4) % 4 AS a, p % 4 AS b, e[p + 1]::DOUBLE AS v FROM x), c AS (SELECT *, v - avg(v) OVER (PARTITION BY protein, i, j, b) AS u FROM r), z AS (SELECT protein, i, j, u - avg(u) OVER (PARTITION BY protein, i, j, a) AS u FROM c), n AS (SELECT protein, i, j, sqrt(sum(u * u)) AS s FROM z GROUP BY 1, 2, 3), s AS (SELECT n.protein, n.i, n.j, CASE WHEN n.i = n.j THEN 0 ELSE (n.s + t.s) / 2 END AS s FROM n JOIN n t ON n.protein = t.protein AND n.i = t.j AND n.j = t.i), q AS (SELECT *, sum(s) OVER (PARTITION BY protein, i) AS ri, sum(s) OVER (PARTITION BY protein, j) AS cj, sum(s) OVER (PARTITION BY protein) AS t FROM s) SELECT protein, i::INT AS i, j::INT AS j, round(CASE WHEN abs(i - j) < 6 THEN 0 WHEN t = 0 THEN s ELSE s - ri * cj / t END, 5) + 0.0 AS score FROM q",
    "balanced_pairs": f"WITH {_POS}, b AS (SELECT protein, i, j, distance < 8 AS contact, (('0x' || substr(md5('42|' || protein || '-' || i || '-' || j), 1, 8))::BIGINT) AS h, protein || '-' || i || '-' || j AS k FROM c), s AS (SELECT protein, least(count(*) FILTER (contact), count(*) FILTER (NOT contact), 1000) AS n FROM b GROUP BY 1), r AS (SELECT b.*, n, row_number() OVER (PARTITION BY b.protein, contact ORDER BY h, k) AS r FROM b JOIN s USING (protein)) SELECT protein, contact, count(*) AS n, sum(i * 1000 + j)::BIGINT AS places FROM r WHERE r <= n GROUP BY 1, 2",
    "triplet_levels": f"""WITH {_E}, l AS (SELECT id, v, label % 2 AS c, (label % 2) || '.' || (label % 5) AS a, (label % 2) || '.' || (label % 5) || '.' || label AS h FROM e),
m AS (SELECT x.id, list_distance(x.v, y.v) AS d, x.c = y.c AS c, x.a = y.a AS a, x.h = y.h AS h FROM l x JOIN l y ON x.id % 20 = 0 AND x.id <> y.id),
t AS (SELECT id, 'c' AS level, max(d) FILTER (c) AS p, min(d) FILTER (NOT c) AS n FROM m GROUP BY id UNION ALL SELECT id, 'a', max(d) FILTER (a), min(d) FILTER (NOT a AND c) FROM m GROUP BY id UNION ALL SELECT id, 'h', max(d) FILTER (h), min(d) FILTER (NOT h AND a) FROM m GROUP BY id)
SELECT level, count(*) AS n_anchors, round(avg(ln(1 + exp(p - n))), 5) AS loss FROM t WHERE p IS NOT NULL AND n IS NOT NULL GROUP BY 1""",
    "weighted_variant_score": f"WITH {_CHANGE}, q AS (SELECT DISTINCT wt_id, p, ((wt_id::INT * 7 + p * 3) % 11)::DOUBLE AS v FROM e), z AS (SELECT *, CASE WHEN stddev_pop(v) OVER g <= 1e-8 THEN 0 ELSE (v - avg(v) OVER g) / stddev_pop(v) OVER g END AS z FROM q WINDOW g AS (PARTITION BY wt_id)) SELECT variant_id, round(sum(change * greatest(0.2, least(1.0, 1 / (1 + exp(z))))), 5) AS score FROM ch JOIN z USING (wt_id, p) GROUP BY 1",
    "position_window_divergence": f"WITH {_PROFILE}, s AS (SELECT id, pos, sum((exp(lp) - exp(lq)) * (lp - lq)) / 2 AS d FROM g GROUP BY 1, 2), w AS (SELECT id, pos, sum(d) OVER (PARTITION BY id ORDER BY pos RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w FROM s), c AS (SELECT DISTINCT c_custkey AS variant_id, (c_custkey % (SELECT count(*) FROM embeddings))::VARCHAR AS id, unnest([c_nationkey % 8, (c_nationkey * 3 + 1) % 8]) AS pos FROM customer) SELECT variant_id, round(-sum(w.w), 5) AS score FROM c JOIN w USING (id, pos) GROUP BY 1",
    "soft_target_delta": f"WITH {_PROFILE} SELECT id, pos::INT AS pos, round(sum(exp(lp) * (lq - lp)), 5) AS delta FROM g GROUP BY 1, 2",
    "conservation_delta": f"WITH {_CHANGE} SELECT variant_id, round(-avg((change - p % 4) ** 2), 5)::DOUBLE AS score FROM ch GROUP BY 1",
    "likelihood_delta": f"WITH {_VAR} SELECT variant_id AS id, round(avg({_LOGP.format('m')}) - avg({_LOGP.format('w')}), 6)::DOUBLE AS delta FROM e GROUP BY 1",
    "mutation_windows": f"WITH {_CHANGE} SELECT variant_id, p::INT AS pos, (CASE WHEN p < 2 THEN 0 WHEN p + 2 >= 9 THEN 5 ELSE p - 2 END)::INT AS start, (CASE WHEN p < 2 THEN 4 WHEN p + 2 >= 9 THEN 9 ELSE p + 2 END)::INT AS \"end\" FROM ch",
    "mutation_strings": f"WITH {_VAR}, x AS (SELECT variant_id, string_agg(w || (p + 1) || m, ':' ORDER BY p) FILTER (w <> m) AS t, string_agg(w || (p + 11) || m, ':' ORDER BY p) FILTER (w <> m) AS s, count(*) FILTER (w <> m) AS n FROM e GROUP BY 1) SELECT variant_id, coalesce(t, 'WT') AS text, n::INT AS n, s AS shifted, true AS whole, true AS refused FROM x",
    "missing_parts": "WITH x AS (SELECT vec_id AS id, unnest(range(64)) AS i, embedding AS e FROM embeddings), y AS (SELECT id, (i + id) % 9 = 0 AS gone, CASE WHEN (i + id) % 9 = 0 THEN 0 ELSE e[i + 1]::DOUBLE END AS v FROM x) SELECT id, count(*) FILTER (gone) AS n_missing, round(sum(v) / sqrt(sum(v * v)), 5) AS total FROM y GROUP BY 1",
}
