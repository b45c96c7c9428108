"""Queries of leaderboards, reports and long result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import functions as fn
from rankloom import sources
from rankloom.operators import bootstrap, features, metrics, similarity, warehouse
from rankloom.plans import neighbours
from rankloom.plans.evaluation import _RANKS, DRAWS, MEAN_DRAWS, weights_sql
from rankloom.plans.results import baseline_delta, latest_results
from rankloom.plans.tables import ASSAY, PREDICTIONS, RESULTS, assay, predictions, reference, results, rounded, table, vectors


def ovr_macro_auc(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    centres = features.mean_vectors(v, ["label"], "vector").select(F.col("label").alias("class"), "mean")
    # As many centres as classes.
    each = v.crossJoin(F.broadcast(centres)).select("id", F.col("label").alias("truth"), "class", F.round(fn.dot(F.col("vector"), F.col("mean")), 9).alias("score"))
    return rounded(metrics.ovr_auc(each, "truth", "class", "score"))


def score_board(spark: SparkSession, d: str) -> DataFrame:
    a = assay(spark, d).withColumns({"flat": F.lit(1.0), "price": -F.col("measured"), "odd": F.when(F.col("grp") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("score") * F.col("y"))})
    per = metrics.score_board(a, "grp", "measured", "y", ["score", "flat", "price", "odd"])
    whole = per.groupBy("score").agg(F.count("*").alias("n_groups"), F.avg("spearman").alias("spearman"), F.avg("auc").alias("auc"))
    return rounded(warehouse.lift(whole, "score", "spearman", "score"))


def aggregation_rules(spark: SparkSession, d: str) -> DataFrame:
    a = assay(spark, d)
    per = metrics.spearman(a, "measured", "score", ["grp"]).join(reference(spark, d), "grp")
    gene = metrics.auc(a, "y", "score", ["grp"]).agg(F.avg("auc").alias("value"))
    levels = metrics.hierarchical_mean(per.withColumnRenamed("spearman", "value"), "value", [["protein", "category"], ["category"]])
    return rounded(warehouse.with_rule({"hierarchical": levels, "flat": per.agg(F.avg("spearman").alias("value")), "per_gene": gene, "pooled": metrics.auc(a, "y", "score", []).select(F.col("auc").alias("value"))}, "rule", "value"))


def panel_mean(spark: SparkSession, d: str) -> DataFrame:
    per = metrics.auc(assay(spark, d), "y", "score", ["grp"]).withColumn("auc", F.when(F.col("grp") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("auc")))
    out = warehouse.panel_mean(per, "grp", "auc")
    return rounded(out.select("mean", "n_groups", F.explode("detail").alias("x")).select("mean", "n_groups", "x.grp", F.col("x.auc").alias("auc")))


def retrieval_report(spark: SparkSession, d: str) -> DataFrame:
    per = neighbours.retrieval_per_query(spark, d).filter("eligible")
    return rounded(bootstrap.mean_intervals(per, "query_id", ["hit_1", "hit_10", "ap"], MEAN_DRAWS, 42, vectors(spark, d).count()))


def transfer_interval(spark: SparkSession, d: str) -> DataFrame:
    judged = neighbours.transfer_judged(spark, d).filter("in_all > 1")
    width = bootstrap.half_width(judged.withColumn("v", F.col("right").cast("double")), "query_id", "v", DRAWS, 42, ["level"])
    return rounded(judged.groupBy("level").agg(F.count("*").alias("n_answerable"), F.avg(F.col("right").cast("double")).alias("accuracy")).join(width, "level"), 5)


def bootstrap_ci_auc(spark: SparkSession, d: str) -> DataFrame:
    found = bootstrap.replicate_auc(predictions(spark, d), "y", "score", "doc_id", DRAWS, 42)
    return rounded(bootstrap.interval(found, "auc", [], max(20, DRAWS // 10)))


def _views(spark: SparkSession, d: str) -> DataFrame:
    return latest_results(spark, d).withColumn("probe", F.when(F.length("task") > 4, "linear").otherwise("knn"))


def baseline_views(spark: SparkSession, d: str) -> DataFrame:
    out = warehouse.baseline_views(_views(spark, d), [("linear", "test"), ("knn", "validation")], ["probe", "split", "task", "metric"], "model", "value", "MODEL-1", "row_no")
    return rounded(out.select("probe", "split", "task", "metric", "model", "value", "base", "delta"))


def model_columns(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).filter("split = 'test' and metric = 'AUC'").withColumn("m", F.concat(F.lit("m"), F.substring("model", -1, 1)))
    return rounded(warehouse.side_by_side(r, "task", "m", "value", "row_no", [f"m{k}" for k in range(5)]))


def ordered_models(spark: SparkSession, d: str) -> DataFrame:
    out = warehouse.ordered_models(latest_results(spark, d), "model", ["model-3", "Model-1"])
    return out.select("place", "model", "task", "split", "metric", "value").orderBy("place", "model", "task", "split", "metric")


def stop_union(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.best_hit(spark, d).select(F.col("target_id").alias("id"), (F.col("query_id") % 3).alias("task"))
    return sources.stop_union(*[found.filter(F.col("task") == k) for k in range(3)])


def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).select(F.col("task").alias("Task"), F.col("split").alias("EvalSplit"), F.when(F.col("row_no") % 3 == 0, "knn").alias("Probe"), F.when(F.col("row_no") % 4 == 0, "500").when(F.col("row_no") % 4 == 1, "").alias("Samples"))
    keyed = warehouse.with_defaults(r).select(warehouse.identity_key(list(warehouse.IDENTITY)).alias("identity"))
    return keyed.groupBy("identity").agg(F.count("*").alias("n"))


def long_rows(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).groupBy("model", "task", "split").agg(F.max(F.when(F.col("row_no") % 2 == 0, F.when(F.col("metric") == "AUC", F.col("value")))).alias("AUC"), F.max(F.when(F.col("metric") == "MSE", F.col("value"))).alias("MSE"))
    declared = F.when(F.length("task") > 5, "Spearman").when(F.length("task") > 4, "MSE").otherwise("AUC")
    return rounded(warehouse.long_rows(r.withColumn("declared", declared), ["model", "task", "split"], "declared"))


def long_records(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    own = F.when(F.col("row_no") % 4 == 0, F.create_map(F.lit("EVAL_F1"), v, F.lit("eval_auc"), v / 2)).when(F.col("row_no") % 4 == 1, F.create_map(F.lit("eval_AUC"), v)).when(F.col("row_no") % 4 == 2, F.create_map(F.lit("eval_mcc"), v, F.lit("eval_Accuracy"), v / 4)).otherwise(F.create_map(F.lit("loss"), v))
    r = results(spark, d).select("row_no", F.when(F.col("row_no") % 3 == 0, "AUC").otherwise("F1_Macro").alias("declared"), own.alias("metrics"))
    return rounded(warehouse.long_records(r, ["row_no"], "declared", "metrics"))


def rounded_markers(spark: SparkSession, d: str) -> DataFrame:
    # Halves of the fifth digit: to even.
    half = fn.rounded(((F.col("row_no") % 64 + 0.5) / 100000).cast("decimal(12,6)")).cast("double")
    keys = ["model", "task", "split", "metric"]
    rows = latest_results(spark, d).select(*keys, half.alias("half"))
    return baseline_delta(spark, d).select(*keys, fn.delta_sign(F.col("delta")).alias("sign")).join(rows, keys)


def ranked_hits_expected(spark: SparkSession, d: str) -> DataFrame:
    hits = neighbours._text_hits(spark, d).withColumn("expected", F.floor(F.lit(8) / F.col("shared")))
    return rounded(similarity.rank_hits(hits, "containment", expected="expected").select("query_id", "target_id", "shared", "expected", "containment", "rank"))


def hit_label_sets(spark: SparkSession, d: str) -> DataFrame:
    hits, queries, _ = neighbours._hits_to_labelled(spark, d)
    labels = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("labels"))
    return similarity.transfer_labels(hits, queries, labels).select("query_id", F.array_join("predicted", ",").alias("predicted"), "covered")


QUERIES = {f.__name__: f for f in (ovr_macro_auc, score_board, aggregation_rules, panel_mean, retrieval_report, transfer_interval, bootstrap_ci_auc, baseline_views, model_columns, ordered_models, stop_union, identity_keys, long_rows, long_records, rounded_markers, ranked_hits_expected, hit_label_sets)}

_N = neighbours
_AUC = "CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(y * r) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) END"
_TIES = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0"
_LAST = f"{RESULTS}, t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY model, task, split, metric ORDER BY day DESC, row_no DESC) = 1)"
SQL = {
    "ovr_macro_auc": f"WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e) GROUP BY 1, 2) GROUP BY 1), s AS (SELECT c.label AS g, (e.label = c.label)::INT AS y, round(list_dot_product(v, m), 9) AS s FROM e, c), k AS (SELECT g, y, {_TIES.format('g', 's')} AS r FROM s), a AS (SELECT g, {_AUC} AS auc FROM k GROUP BY 1) SELECT round(avg(auc), 6) AS auc_macro, count(auc) AS n_labels FROM a",
    "score_board": f"WITH {ASSAY}, l AS (SELECT grp, measured, y, unnest(['score', 'price', 'odd']) AS score, unnest([score, -measured, score * y]) AS s FROM a), g AS (SELECT * FROM l WHERE NOT (score = 'odd' AND grp % 3 = 0)), f AS (SELECT * FROM g QUALIFY min(s) OVER (PARTITION BY score, grp) < max(s) OVER (PARTITION BY score, grp)), k AS (SELECT score, grp, y, {_TIES.format('score, grp', 'measured')} AS rm, {_TIES.format('score, grp', 's')} AS r FROM f), p AS (SELECT score, grp, corr(rm, r) AS c, {_AUC} AS auc FROM k GROUP BY 1, 2 HAVING count(*) >= 2), w AS (SELECT score, count(*) AS n_groups, avg(coalesce(CASE WHEN isnan(c) THEN 0 ELSE c END, 0)) AS v, avg(auc) AS auc FROM p GROUP BY 1) SELECT score, n_groups, round(v, 6) AS spearman, round(auc, 6) AS auc, round(v - (SELECT v FROM w WHERE score = 'score'), 6) AS lift FROM w",
    "aggregation_rules": f"WITH {ASSAY}, {_RANKS}, s AS (SELECT grp, coalesce(CASE WHEN isnan(corr(rm, rs)) THEN 0 ELSE corr(rm, rs) END, 0) AS v, {_AUC.replace('* r)', '* rs)')} AS auc FROM rk GROUP BY grp HAVING count(*) >= 2), p AS (SELECT n_nationkey AS protein, n_regionkey AS category, avg(v) AS v FROM s JOIN supplier ON grp = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2), c AS (SELECT avg(v) AS v FROM p GROUP BY category), o AS (SELECT y, {_TIES.format('1', 'score')} AS r FROM a) SELECT 'hierarchical' AS rule, round(avg(v), 6) AS value FROM c UNION ALL SELECT 'flat', round(avg(v), 6) FROM s JOIN supplier ON grp = s_suppkey UNION ALL SELECT 'per_gene', round(avg(auc), 6) FROM s UNION ALL SELECT 'pooled', round({_AUC}, 6) FROM o",
    "panel_mean": f"WITH {ASSAY}, {_RANKS}, s AS (SELECT grp, {_AUC.replace('* r)', '* rs)')} AS auc FROM rk WHERE grp % 7 <> 0 GROUP BY grp) SELECT round(avg(auc) OVER (), 6) AS mean, count(*) OVER () AS n_groups, grp, round(auc, 6) AS auc FROM s WHERE auc IS NOT NULL",
    "retrieval_report": f"WITH {_N._PER}, x AS (SELECT query_id, unnest(['hit_1', 'hit_10', 'ap']) AS metric, unnest([hit_1::DOUBLE, hit_10::DOUBLE, round(ap, 6)]) AS v FROM p WHERE eligible), {weights_sql(42, 'x', 'query_id', MEAN_DRAWS)}, m AS (SELECT metric, replicate, sum(v * w) / sum(w) AS v FROM w WHERE w > 0 GROUP BY 1, 2) SELECT metric, (SELECT round(avg(v), 6) FROM x WHERE x.metric = m.metric) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS n_draws FROM m GROUP BY 1",
    "transfer_interval": f"""WITH {_N._KNN}, {_N.LEVELS_SQL}, x AS (SELECT a.level, a.id AS query_id, (a.lab = b.lab)::INT AS v FROM l a JOIN n ON n.query_id = a.id AND r = 1 JOIN l b ON b.id = n.t AND b.level = a.level JOIN k ON k.level = a.level AND k.lab = a.lab WHERE a.q AND n_all > 1), {weights_sql(42, 'x', 'query_id', DRAWS)}, m AS (SELECT level, replicate, sum(v * w) / sum(w) AS v FROM w WHERE w > 0 GROUP BY 1, 2) SELECT level, (SELECT count(*) FROM x WHERE x.level = m.level) AS n_answerable, (SELECT round(avg(v), 5) FROM x WHERE x.level = m.level) AS accuracy, round(1.96 * stddev_samp(v), 5) AS half_width FROM m GROUP BY 1""",
    "bootstrap_ci_auc": f"WITH {PREDICTIONS}, {weights_sql(42, 'q', 'doc_id', DRAWS)}, x AS (SELECT replicate, y, score, unnest(range(w)) FROM w WHERE w > 0), k AS (SELECT replicate, y, {_TIES.format('replicate', 'score')} AS r FROM x), a AS (SELECT {_AUC} AS v FROM k GROUP BY replicate) SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS n_draws FROM a WHERE v IS NOT NULL",
    "baseline_views": f"WITH {_LAST}, v AS (SELECT *, CASE WHEN length(task) > 4 THEN 'linear' ELSE 'knn' END AS probe FROM t), b AS (SELECT task, split, metric, value AS base FROM t WHERE model = 'org/model-1') SELECT probe, split, task, metric, model, round(value, 6) AS value, round(base, 6) AS base, round(value - base, 6) AS delta FROM v LEFT JOIN b USING (task, split, metric) WHERE (probe, split) IN (('linear', 'test'), ('knn', 'validation'))",
    "model_columns": f"WITH {RESULTS} SELECT task, " + ", ".join(f"round(arg_max(value, row_no) FILTER (model = 'org/model-{k}'), 6) AS m{k}" for k in range(5)) + " FROM r WHERE split = 'test' AND metric = 'AUC' GROUP BY 1",
    "ordered_models": f"WITH {_LAST} SELECT CASE WHEN model LIKE '%model-3%' THEN 0 WHEN model LIKE '%model-1%' THEN 1 ELSE 2 END AS place, model, task, split, metric, value FROM t ORDER BY ALL",
    "stop_union": f"WITH {_N._BEST} SELECT DISTINCT target_id AS id FROM best",
    "identity_keys": f"WITH {RESULTS} SELECT concat_ws('|', task, CASE WHEN row_no % 4 = 0 THEN 'Samples=500' END, CASE WHEN row_no % 3 = 0 THEN 'Probe=knn' END, CASE WHEN split <> 'test' THEN 'EvalSplit=' || split END) AS identity, count(*) AS n FROM r GROUP BY 1",
    "long_rows": f"WITH {RESULTS}, w AS (SELECT model, task, split, max(value) FILTER (metric = 'AUC' AND row_no % 2 = 0) AS auc, max(value) FILTER (metric = 'MSE') AS mse, CASE WHEN length(task) > 5 THEN 'Spearman' WHEN length(task) > 4 THEN 'MSE' ELSE 'AUC' END AS dec FROM r GROUP BY 1, 2, 3), f AS (SELECT *, CASE WHEN dec = 'AUC' AND auc IS NOT NULL THEN 'AUC' WHEN dec = 'MSE' AND mse IS NOT NULL THEN 'MSE' WHEN auc IS NOT NULL THEN 'AUC' WHEN mse IS NOT NULL THEN 'MSE' ELSE dec END AS name FROM w) SELECT model, task, split, name AS metric_name, round(CASE name WHEN 'AUC' THEN auc WHEN 'MSE' THEN mse END, 6) AS metric_value FROM f UNION ALL SELECT model, task, split, 'MSE', round(mse, 6) FROM f WHERE name <> 'MSE' AND mse IS NOT NULL",
    "long_records": f"WITH {RESULTS}, d AS (SELECT row_no, value AS v, row_no % 4 AS k, CASE WHEN row_no % 3 = 0 THEN 'AUC' ELSE 'F1_Macro' END AS dec FROM r), o AS (SELECT row_no, CASE k WHEN 0 THEN CASE dec WHEN 'AUC' THEN 'AUC' ELSE 'F1_Macro' END WHEN 1 THEN 'AUC' WHEN 2 THEN 'Accuracy' ELSE dec END AS metric_name, CASE k WHEN 0 THEN CASE dec WHEN 'AUC' THEN v / 2 ELSE v END WHEN 1 THEN v WHEN 2 THEN v / 4 END AS v FROM d UNION ALL SELECT row_no, 'AUC', CASE k WHEN 0 THEN v / 2 ELSE v END FROM d WHERE dec <> 'AUC' AND k < 2) SELECT row_no, metric_name, round(v, 6) AS metric_value FROM o",
    "rounded_markers": f"WITH {_LAST}, b AS (SELECT task, split, metric, value AS base FROM t WHERE model = 'org/model-0'), x AS (SELECT t.*, round(value - base, 6) AS delta FROM t LEFT JOIN b USING (task, split, metric)) SELECT model, task, split, metric, CASE WHEN delta > 1e-4 THEN 'up' WHEN delta < -1e-4 THEN 'down' ELSE 'same' END AS sign, round((row_no % 64 + row_no % 2) / 100000.0, 5)::DOUBLE AS half FROM x",
    "ranked_hits_expected": f"WITH {_N._HITS} SELECT query_id, target_id, shared, floor(8 / shared)::BIGINT AS expected, round(containment, 6) AS containment, row_number() OVER (PARTITION BY query_id ORDER BY floor(8 / shared), hits.containment DESC, target_id)::INT AS rank FROM hits QUALIFY rank <= 300",
    "hit_label_sets": f"WITH {_N._LABELLED}, o AS (SELECT query_id, target_id FROM k WHERE r = 1) SELECT item_id AS query_id, CASE WHEN doc_id IS NULL THEN '' ELSE concat_ws(',', lang, source) END AS predicted, doc_id IS NOT NULL AS covered FROM benchmark LEFT JOIN o ON query_id = item_id LEFT JOIN documents ON doc_id = target_id",
}
