"""Queries of metrics, splits, intervals and ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import bootstrap, metrics, prepare, variants
from rankloom.plans.tables import ASSAY, PREDICTIONS, assay, predictions, reference, rounded, table

_RANKS = """rk AS (SELECT grp, y, measured, score,
  rank() OVER (PARTITION BY grp ORDER BY measured) + (count(*) OVER (PARTITION BY grp, measured) - 1) / 2.0 AS rm,
  rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS rs FROM a)"""


def assay_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    per = metrics.spearman(assay(spark, d), "measured", "score", ["grp"]).join(reference(spark, d), "grp")
    return rounded(metrics.hierarchical_mean(per, "spearman", [["protein", "category"], ["category"]]))


def spearman_per_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.spearman(assay(spark, d), "measured", "score", ["grp"]))


def assay_auc_per_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auc(assay(spark, d), "y", "score", ["grp"]))


def pooled_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auc(assay(spark, d), "y", "score", []))


def binary_auc_ap(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    return rounded(metrics.auc(p, "y", "score", []).crossJoin(metrics.average_precision(p, "y", "score", [])))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(predictions(spark, d), "y", "p")


def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.class_metrics(metrics.confusion(predictions(spark, d), "y", "p")))


def per_class_f1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_class(metrics.confusion(predictions(spark, d), "y", "p")))


def multilabel_f1(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    size = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    rows = docs.select("doc_id", F.array("lang", "source", size).alias("truth"), F.array("lang", F.lit("src1"), F.lit("long")).alias("guess"))
    return rounded(metrics.multilabel_metrics(rows, "doc_id", "truth", "guess"))


def _errors(df: DataFrame) -> DataFrame:
    """Errors, which are about 1e9 here, to 2 digits; all else to 6."""
    return rounded(df.withColumns({c: F.round(c, 2) for c in ("mse", "mae")}))


def regression_block(spark: SparkSession, d: str) -> DataFrame:
    return _errors(metrics.regression(assay(spark, d).withColumn("guess", F.col("score") * 1500), "measured", "guess", []))


def regression_per_group(spark: SparkSession, d: str) -> DataFrame:
    return _errors(metrics.regression(assay(spark, d).withColumn("guess", F.col("score") * 1500), "measured", "guess", ["grp"]))


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return prepare.hash_split(table(spark, d, "customer"), 42, "c_custkey").groupBy("c_mktsegment", "split").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


def group_split(spark: SparkSession, d: str) -> DataFrame:
    return prepare.hash_split(table(spark, d, "orders"), 7, "o_custkey").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("groups"), F.sum("o_orderkey").alias("keys"))


def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return prepare.folds(table(spark, d, "customer"), 4, 42, "c_custkey", label="c_mktsegment").groupBy("c_mktsegment", "fold").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


def grouped_folds(spark: SparkSession, d: str) -> DataFrame:
    return prepare.folds(table(spark, d, "orders"), 4, 42, "o_orderkey", group="o_custkey").groupBy("fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def within_group_split(spark: SparkSession, d: str) -> DataFrame:
    return prepare.within_group_split(table(spark, d, "orders"), "o_custkey", "o_orderkey", 42).groupBy("o_custkey", "split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def sample_cap(spark: SparkSession, d: str) -> DataFrame:
    return prepare.cap(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 500, 42, "o_orderkey")


def topk_labels_multiclass(spark: SparkSession, d: str) -> DataFrame:
    return prepare.keep_top_labels(table(spark, d, "part"), "p_brand", 10).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


def label_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return prepare.vocabulary(table(spark, d, "part"), "p_type")


def zscore_ensemble(spark: SparkSession, d: str) -> DataFrame:
    z = variants.z_scores(assay(spark, d), "grp", ["measured", "score"])
    return rounded(z.groupBy("grp").agg(F.count("*").alias("n"), F.avg(F.col("z_measured") * F.col("z_score")).alias("mean_product"), F.max(F.col("z_measured") + F.col("z_score")).alias("top_sum")))


def ensemble_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(variants.ensemble_grid(assay(spark, d), "grp", "measured", ["score", "y"], 0.5), 5)


#: Draws of the intervals of means, and of those of other metrics and of half widths.
MEAN_DRAWS, DRAWS = 10_000, 1000


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).select("doc_id", (F.col("y") == F.col("p")).cast("double").alias("hit"))


def bootstrap_ci_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.mean_interval(_hits(spark, d), "doc_id", "hit", MEAN_DRAWS, 42))


def bootstrap_half_width(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.half_width(_hits(spark, d), "doc_id", "hit", DRAWS, 7))


def bootstrap_ci_metric(spark: SparkSession, d: str) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    cells = {"tp": y * p, "fp": (1 - y) * p, "fn": y * (1 - p)}
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "weight"))
    return rounded(bootstrap.metric_interval(predictions(spark, d), "doc_id", cells, {"f1": 2 * tp / (2 * tp + fp + fn), "precision": tp / (tp + fp), "recall": tp / (tp + fn), "accuracy": 1 - (fp + fn) / n}, DRAWS, 42))


def bootstrap_ci_regression(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of squared and absolute error and of the correlation, from five sums a replicate."""
    q = predictions(spark, d).select("doc_id", F.log10(F.col("score") + 1.0).alias("a"), (F.col("y") + 0.5 * F.col("p")).alias("b"))
    a, b = F.col("a"), F.col("b")
    sums = {"a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b, "far": F.abs(a - b)}
    n, x, y, xx, yy, xy = (F.col(c) for c in ("weight", "a", "b", "aa", "bb", "ab"))
    values = {"mse": (xx - 2 * xy + yy) / n, "mae": F.col("far") / n, "pearson": (n * xy - x * y) / F.sqrt((n * xx - x * x) * (n * yy - y * y))}
    return rounded(bootstrap.metric_interval(q, "doc_id", sums, values, DRAWS, 42))


def bootstrap_ci_spearman(spark: SparkSession, d: str) -> DataFrame:
    found = bootstrap.replicate_spearman(predictions(spark, d), "score", "y", "doc_id", DRAWS, 42)
    return rounded(bootstrap.interval(found, "spearman", [], max(20, DRAWS // 10)))


QUERIES = {f.__name__: f for f in (assay_leaderboard, spearman_per_group, assay_auc_per_group, pooled_auc, binary_auc_ap, confusion, class_metrics, per_class_f1, multilabel_f1, regression_block, regression_per_group, hash_split, group_split, stratified_folds, grouped_folds, within_group_split, sample_cap, topk_labels_multiclass, label_vocabulary, zscore_ensemble, ensemble_grid, bootstrap_ci_mean, bootstrap_half_width, bootstrap_ci_metric, bootstrap_ci_regression, bootstrap_ci_spearman)}

_SPEARMAN = f"WITH {ASSAY}, {_RANKS}, s AS (SELECT grp, count(*) AS n, coalesce(CASE WHEN isnan(corr(rm, rs)) THEN 0 ELSE corr(rm, rs) END, 0) AS spearman FROM rk GROUP BY grp HAVING count(*) >= 2)"
_AUC = "CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(y * r) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) END"
_HASH = "(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT)"
_POISSON = " + ".join(f"(u >= {p})::INT" for p in bootstrap.LIMITS)


def weights_sql(seed: int, rows: str, key: str, draws: int, name: str = "w") -> str:
    """A common table (name): rows with a replicate and its weight w."""
    p = bootstrap.PRIME
    part = lambda k: f"('0x' || substr(m, {8 * k + 1}, 8))::BIGINT % {p}"
    replicates = f"(SELECT replicate, {part(0)} AS ra, {part(1)} AS rb, {part(2)} AS rc FROM (SELECT unnest(range({draws})) AS replicate, md5('{seed}|replicate|' || replicate) AS m))"
    keyed = f"(SELECT *, ('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT % {p} AS h FROM {rows})"
    return f"{name} AS (SELECT *, {_POISSON} AS w FROM (SELECT *, (((ra * h + rb) % {p}) * h + rc) % {p} AS u FROM {keyed} CROSS JOIN {replicates}))"


def intervals_sql(metrics_: dict[str, str], source: str) -> str:
    """low, high and n_draws of metrics, which are expressions over source by replicate."""
    made = ", ".join(f"{e} AS m{k}" for k, e in enumerate(metrics_.values()))
    one = "SELECT '{0}' AS metric, round(quantile_cont(m{1}, 0.025), 6) AS low, round(quantile_cont(m{1}, 0.975), 6) AS high, count(*) AS n_draws FROM m WHERE m{1} IS NOT NULL AND NOT isnan(m{1})"
    return f"m AS (SELECT {made} FROM {source} WHERE w > 0 GROUP BY replicate) " + " UNION ALL ".join(one.format(name, k) for k, name in enumerate(metrics_))


def _weights(seed: int, rows: str, draws: int = DRAWS) -> str:
    return weights_sql(seed, rows, "doc_id", draws)


SQL = {
    "assay_leaderboard": _SPEARMAN + ", p AS (SELECT n_nationkey AS protein, n_regionkey AS category, avg(spearman) AS v FROM s JOIN supplier ON grp = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2), c AS (SELECT category, avg(v) AS v FROM p GROUP BY 1) SELECT round(avg(v), 6) AS spearman FROM c",
    "spearman_per_group": _SPEARMAN + " SELECT grp, n, round(spearman, 6) AS spearman FROM s",
    "assay_auc_per_group": f"WITH {ASSAY}, {_RANKS} SELECT grp, round({_AUC.replace('r)', 'rs)')}, 6) AS auc, count(*) AS n, sum(y)::BIGINT AS n_pos FROM rk GROUP BY grp",
    "pooled_auc": f"WITH {ASSAY}, t AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM a) SELECT round({_AUC}, 6) AS auc, count(*) AS n, sum(y)::BIGINT AS n_pos FROM t",
    "binary_auc_ap": f"""WITH {PREDICTIONS}, t AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM q),
u AS (SELECT score, count(*) AS n, sum(y) AS pos FROM q GROUP BY score), c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k, sum(pos) OVER () AS total FROM u)
SELECT x.*, y.* FROM (SELECT round({_AUC}, 6) AS auc, count(*) AS n, sum(y)::BIGINT AS n_pos FROM t) x, (SELECT round(sum(pos * tp / k / total), 6) AS average_precision FROM c) y""",
    "confusion": f"WITH {PREDICTIONS} SELECT y AS y_true, p AS y_pred, count(*) AS n FROM q GROUP BY 1, 2",
    "class_metrics": f"""WITH {PREDICTIONS}, l AS (SELECT 0 AS label UNION SELECT 1), c AS (SELECT label, count(*) FILTER (y = label AND p = label) AS tp, count(*) FILTER (y = label) AS act, count(*) FILTER (p = label) AS pre FROM l, q GROUP BY label),
f AS (SELECT *, 2 * tp / (act + pre) AS f1 FROM c WHERE act + pre > 0)
SELECT sum(act)::BIGINT AS n, round(sum(tp) / sum(act), 6) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * act) / sum(act), 6) AS f1_weighted, round(avg(tp / nullif(act, 0)), 6) AS balanced_accuracy,
round((sum(tp) * sum(act) - sum(act * pre)) / (sqrt((sum(act) * sum(act) - sum(pre * pre))::DOUBLE) * sqrt((sum(act) * sum(act) - sum(act * act))::DOUBLE)), 6) AS mcc, round(arg_max(f1, label), 6) AS f1_binary FROM f""",
    "per_class_f1": f"WITH {PREDICTIONS}, l AS (SELECT 0 AS label UNION SELECT 1) SELECT label, count(*) FILTER (y = label AND p = label) AS tp, count(*) FILTER (y = label) AS actual, count(*) FILTER (p = label) AS predicted, round(2 * count(*) FILTER (y = label AND p = label) / (count(*) FILTER (y = label) + count(*) FILTER (p = label)), 6) AS f1 FROM l, q GROUP BY label",
    "multilabel_f1": """WITH t AS (SELECT doc_id, unnest([lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END]) AS label FROM documents), g AS (SELECT doc_id, unnest([lang, 'src1', 'long']) AS label FROM documents),
j AS (SELECT coalesce(t.label, g.label) AS label, t.label IS NOT NULL AS a, g.label IS NOT NULL AS b FROM t FULL JOIN g ON t.doc_id = g.doc_id AND t.label = g.label), c AS (SELECT label, count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn FROM j GROUP BY label)
SELECT count(*) AS n, round(avg((source = 'src1' AND n_chars > 2000)::INT), 6) AS subset_accuracy, (SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) FROM c) AS f1_micro, (SELECT round(avg(2 * tp / (2 * tp + fp + fn)), 6) FROM c) AS f1_macro FROM documents""",
    "regression_block": f"""WITH {ASSAY}, t AS (SELECT measured AS y, score * 1500 AS p, rank() OVER (ORDER BY measured) + (count(*) OVER (PARTITION BY measured) - 1) / 2.0 AS ry, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rp FROM a)
SELECT count(*) AS n, round(corr(ry, rp), 6) + 0 AS spearman, round(corr(y, p), 6) + 0 AS pearson, round(avg((y - p) * (y - p)), 2) + 0 AS mse, round(avg(abs(y - p)), 2) + 0 AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) + 0 AS r2 FROM t""",
    "regression_per_group": f"WITH {ASSAY}, {_RANKS} SELECT grp, count(*) AS n, round(corr(rm, rs), 6) + 0 AS spearman, round(corr(measured, score * 1500), 6) + 0 AS pearson, round(avg((measured - score * 1500) ** 2), 2) + 0 AS mse, round(avg(abs(measured - score * 1500)), 2) + 0 AS mae, round(1 - sum((measured - score * 1500) ** 2) / (var_pop(measured) * count(*)), 6) + 0 AS r2 FROM rk GROUP BY grp",
    "hash_split": f"SELECT c_mktsegment, CASE WHEN {_HASH.format(seed=42, key='c_custkey')} % 10 < 8 THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1, 2",
    "group_split": f"SELECT CASE WHEN {_HASH.format(seed=7, key='o_custkey')} % 10 < 8 THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT o_custkey) AS groups, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1",
    "stratified_folds": f"WITH f AS (SELECT *, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_HASH.format(seed=42, key='c_custkey')}, c_custkey) - 1) % 4)::INT AS fold FROM customer) SELECT c_mktsegment, fold, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM f GROUP BY 1, 2",
    "grouped_folds": f"SELECT ({_HASH.format(seed=42, key='o_custkey')} % 4)::INT AS fold, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1",
    "within_group_split": f"WITH f AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY {_HASH.format(seed=42, key='o_orderkey')}, o_orderkey) AS r FROM orders) SELECT o_custkey, CASE WHEN r <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM f WHERE n >= 10 GROUP BY 1, 2",
    "sample_cap": f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {_HASH.format(seed=42, key='o_orderkey')}, o_orderkey LIMIT 500",
    "topk_labels_multiclass": "WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 10) SELECT p_brand, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM part SEMI JOIN t USING (p_brand) GROUP BY 1",
    "label_vocabulary": "SELECT p_type, (row_number() OVER (ORDER BY p_type) - 1)::INT AS index FROM (SELECT DISTINCT p_type FROM part)",
    "zscore_ensemble": f"WITH {ASSAY}, z AS (SELECT grp, (measured - avg(measured) OVER g) / stddev_pop(measured) OVER g AS zm, (score - avg(score) OVER g) / stddev_pop(score) OVER g AS zs FROM a WINDOW g AS (PARTITION BY grp)) SELECT grp, count(*) AS n, round(avg(zm * zs), 6) AS mean_product, round(max(zm + zs), 6) AS top_sum FROM z GROUP BY grp",
    "ensemble_grid": f"""WITH {ASSAY}, z AS (SELECT grp, measured, (score - avg(score) OVER g) / stddev_pop(score) OVER g AS zs, (y - avg(y) OVER g) / stddev_pop(y) OVER g AS zy FROM a WINDOW g AS (PARTITION BY grp)),
m AS (SELECT grp, measured, weights, round(zs * ws + zy * wy, 9) AS s FROM z, (VALUES ('0.00/1.00', 0.0, 1.0), ('0.50/0.50', 0.5, 0.5), ('1.00/0.00', 1.0, 0.0)) AS w(weights, ws, wy)),
k AS (SELECT weights, grp, rank() OVER (PARTITION BY weights, grp ORDER BY measured) + (count(*) OVER (PARTITION BY weights, grp, measured) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY weights, grp ORDER BY s) + (count(*) OVER (PARTITION BY weights, grp, s) - 1) / 2.0 AS rs FROM m),
p AS (SELECT weights, grp, corr(rm, rs) AS c FROM k GROUP BY 1, 2) SELECT weights, round(avg(c), 5) AS mean_spearman FROM p GROUP BY 1""",
    "bootstrap_ci_mean": f"WITH {PREDICTIONS}, h AS (SELECT doc_id, (y = p)::INT AS hit FROM q), {_weights(42, 'h', MEAN_DRAWS)}, m AS (SELECT sum(hit * w) / sum(w) AS v FROM w WHERE w > 0 GROUP BY replicate) SELECT (SELECT round(avg(hit), 6) FROM h) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS n_draws FROM m",
    "bootstrap_half_width": f"WITH {PREDICTIONS}, h AS (SELECT doc_id, (y = p)::INT AS hit FROM q), {_weights(7, 'h')}, m AS (SELECT sum(hit * w) / sum(w) AS v FROM w WHERE w > 0 GROUP BY replicate) SELECT round(1.96 * stddev_samp(v), 6) AS half_width FROM m",
    "bootstrap_ci_metric": f"WITH {PREDICTIONS}, {_weights(42, 'q')}, " + intervals_sql({"f1": "2 * sum(w * y * p) / (sum(w * y) + sum(w * p))", "precision": "sum(w * y * p) / nullif(sum(w * p), 0)", "recall": "sum(w * y * p) / nullif(sum(w * y), 0)", "accuracy": "sum(w * (y = p)::INT) / sum(w)"}, "w"),
    "bootstrap_ci_regression": f"WITH {PREDICTIONS}, g AS (SELECT doc_id, log10(score + 1.0) AS a, y + 0.5 * p AS b FROM q), {_weights(42, 'g')}, " + intervals_sql({"mse": "sum(w * (a - b) * (a - b)) / sum(w)", "mae": "sum(w * abs(a - b)) / sum(w)", "pearson": "(sum(w) * sum(w * a * b) - sum(w * a) * sum(w * b)) / sqrt((sum(w) * sum(w * a * a) - sum(w * a) ** 2) * (sum(w) * sum(w * b * b) - sum(w * b) ** 2))"}, "w"),
    "bootstrap_ci_spearman": f"WITH {PREDICTIONS}, {_weights(42, 'q')}, x AS (SELECT replicate, y, score, unnest(range(w)) FROM w WHERE w > 0), k AS (SELECT replicate, rank() OVER (PARTITION BY replicate ORDER BY score) + (count(*) OVER (PARTITION BY replicate, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY replicate ORDER BY y) + (count(*) OVER (PARTITION BY replicate, y) - 1) / 2.0 AS b FROM x), m AS (SELECT coalesce(CASE WHEN isnan(corr(a, b)) THEN 0 ELSE corr(a, b) END, 0) AS v FROM k GROUP BY replicate) SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS n_draws FROM m",
}
