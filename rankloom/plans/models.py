"""Queries of linear models whose closed form SQL can write, and of paired inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import features, metrics, prepare, probes, variants
from rankloom.plans.neighbours import _RES, _residues
from rankloom.plans.tables import ASSAY, assay, rounded, table, vectors


def _two_parts(spark: SparkSession, d: str) -> DataFrame:
    """The first two parts of each vector as inputs, the third as what is to be foretold."""
    part = lambda k: F.element_at("vector", k).cast("double")
    return vectors(spark, d).select("id", "label", F.array(part(1), part(2)).alias("x"), part(3).alias("y"))


def ridge_folds(spark: SparkSession, d: str) -> DataFrame:
    rows = _two_parts(spark, d).withColumn("fold", (F.col("id") % 4).cast("int"))
    return rounded(probes.fold_predictions(rows, "x", "regression", "fold").select("id", "fold", "prediction"))


def ridge_fold_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = _two_parts(spark, d).withColumn("fold", (F.col("id") % 4).cast("int"))
    return rounded(probes.cross_validated(rows, "x", "linear", "regression", "fold").select("fold", "n", "mse", "mae", "r2"))


def group_ridge_score(spark: SparkSession, d: str) -> DataFrame:
    """The mean over groups of the rank correlation of held-out rows with a ridge model of the group's others."""
    split = prepare.within_group_split(_two_parts(spark, d), "label", "id", 42)
    side = lambda s: split.filter(F.col("split") == s).drop("split")
    predicted = probes.ridge_per_group(side("train"), side("test"), "label", "x").withColumn("prediction", F.round("prediction", 9))
    per = metrics.spearman(predicted, "y", "prediction", ["label"])
    return rounded(per.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n"), F.avg("spearman").alias("spearman")))


def paired_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = prepare.paired(table(spark, d, "customer"), {"wildtype": "c_mktsegment", "mutant": "c_name"})
    return rows.select("c_custkey", "pair.*")


def ensemble_scores(spark: SparkSession, d: str) -> DataFrame:
    """Price, quantity and, in groups where it is whole, their ratio."""
    a = assay(spark, d).withColumn("ratio", F.when(F.col("grp") % 3 == 0, F.when(F.col("y") == 1, F.lit(float("nan")))).otherwise(F.col("measured") / F.col("score")))
    e = variants.ensemble_scores(a, "grp", {"measured": 1.0, "score": 0.5, "ratio": 2.0})
    return rounded(e.groupBy("grp").agg(F.count("*").alias("n"), F.max("n_terms").alias("n_terms"), F.max("ensemble").alias("top"), F.avg(F.col("ensemble") * F.col("y")).alias("mean_of_positive")), 5)


def masked_pool(spark: SparkSession, d: str) -> DataFrame:
    """The mean of all positions and that of two in three, one after the other."""
    r = _residues(spark, d)
    blocks = [features.mean_vectors(r, ["protein"], "vec"), features.mean_vectors(r, ["protein"], "vec", mask=F.col("pos") % 3 > 0)]
    return rounded(features.joined_blocks(blocks, ["protein"], ["mean", "mean"]).select("protein", F.posexplode("vector").alias("i", "x")), 5)


QUERIES = {f.__name__: f for f in (ridge_folds, ridge_fold_errors, group_ridge_score, paired_inputs, ensemble_scores, masked_pool)}

_T = "t AS (SELECT vec_id AS id, label, (vec_id % 4)::INT AS fold, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS y FROM embeddings)"
# Standardised: the diagonal of the products is n, and the penalty is 1.
_FOLDS = f"""{_T}, f AS (SELECT DISTINCT fold FROM t), m AS (SELECT f.fold, count(*) + 1 AS n1, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, count(*) * corr(a, b) AS ab, count(*) * covar_pop(a, y) / stddev_pop(a) AS ay, count(*) * covar_pop(b, y) / stddev_pop(b) AS by_ FROM f JOIN t ON t.fold <> f.fold GROUP BY 1),
w AS (SELECT *, (ay * n1 - ab * by_) / (n1 * n1 - ab * ab) AS wa, (by_ * n1 - ab * ay) / (n1 * n1 - ab * ab) AS wb FROM m), p AS (SELECT id, t.fold, y, my + (a - ma) / sa * wa + (b - mb) / sb * wb AS p FROM t JOIN w USING (fold))"""
SQL = {
    "ridge_folds": f"WITH {_FOLDS} SELECT id, fold, round(p, 6) AS prediction FROM p",
    "ridge_fold_errors": f"WITH {_FOLDS} SELECT fold, count(*) AS n, round(avg((y - p) ** 2), 6) AS mse, round(avg(abs(y - p)), 6) AS mae, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM p GROUP BY 1",
    "group_ridge_score": f"""WITH {_T}, s AS (SELECT *, count(*) OVER (PARTITION BY label) AS k, row_number() OVER (PARTITION BY label ORDER BY (('0x' || substr(md5('42|' || id), 1, 8))::BIGINT), id) AS r FROM t), c AS (SELECT *, r <= floor(0.8 * k) AS train FROM s WHERE k >= 10),
m AS (SELECT label, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) * var_pop(a) + 1 AS aa, count(*) * var_pop(b) + 1 AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS by_ FROM c WHERE train GROUP BY 1),
p AS (SELECT label, y, round(my + (a - ma) * (ay * bb - ab * by_) / (aa * bb - ab * ab) + (b - mb) * (by_ * aa - ab * ay) / (aa * bb - ab * ab), 9) AS p FROM c JOIN m USING (label) WHERE NOT train),
k AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2.0 AS rp FROM p), g AS (SELECT label, count(*) AS n, corr(ry, rp) AS c FROM k GROUP BY 1 HAVING count(*) >= 2)
SELECT count(*) AS n_groups, sum(n)::BIGINT AS n, round(avg(coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0)), 6) AS spearman FROM g""",
    "paired_inputs": "SELECT c_custkey, c_name AS mutant, c_mktsegment AS wildtype FROM customer",
    "ensemble_scores": f"WITH {ASSAY}, t AS (SELECT *, CASE WHEN grp % 3 <> 0 THEN measured / score END AS ratio FROM a), z AS (SELECT grp, y, (measured - avg(measured) OVER g) / stddev_pop(measured) OVER g + 0.5 * (score - avg(score) OVER g) / stddev_pop(score) OVER g + CASE WHEN grp % 3 <> 0 THEN 2 * (ratio - avg(ratio) OVER g) / stddev_pop(ratio) OVER g ELSE 0 END AS e FROM t WINDOW g AS (PARTITION BY grp)) SELECT grp, count(*) AS n, max(CASE WHEN grp % 3 = 0 THEN 2 ELSE 3 END)::INT AS n_terms, round(max(e), 5) AS top, round(avg(e * y), 5) AS mean_of_positive FROM z GROUP BY 1",
    "masked_pool": f"WITH {_RES} SELECT protein, i, round(avg(x), 5) AS x FROM d GROUP BY 1, 2 UNION ALL SELECT protein, i + 8, round(avg(x), 5) FROM d WHERE pos % 3 > 0 GROUP BY 1, 2",
}
