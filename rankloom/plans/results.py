"""Queries of the results warehouse, of variants and of probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import comparison_value
from rankloom.operators import prepare, probes, variants, warehouse
from rankloom.plans.tables import RESULTS, results, rounded, table, vectors

_CELL = ["model", "task", "split", "metric"]


def latest_results(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.latest(results(spark, d), _CELL, "day", "row_no")


def collect_results(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.collect_latest(results(spark, d), [*_CELL, "day"], _CELL, "day", "row_no")


def merge_same_day(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    return warehouse.merge_new(r.filter("row_no % 2 = 0"), r.filter("row_no % 2 = 1"), [*_CELL, "day"], "row_no")


def _wide(spark: SparkSession, d: str, model: str) -> DataFrame:
    last = latest_results(spark, d).filter(F.col("model") == f"org/model-{model}")
    return last.groupBy("task", "split").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("AUC", "MSE")])


def compare_models(spark: SparkSession, d: str) -> DataFrame:
    return rounded(warehouse.compare(_wide(spark, d, "0"), _wide(spark, d, "1"), ["task", "split"], ["AUC", "MSE"]))


def baseline_delta(spark: SparkSession, d: str) -> DataFrame:
    out = warehouse.baseline_delta(latest_results(spark, d), ["task", "split", "metric"], "model", "value", "model-0", "row_no")
    return rounded(out.select(*_CELL, "value", "base", "delta"))


def winloss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(warehouse.tally(baseline_delta(spark, d), "model", "metric", "delta"))


def top_movers(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.movers(baseline_delta(spark, d).select(*_CELL, "delta"), "delta", 5)


def pivot_report(spark: SparkSession, d: str) -> DataFrame:
    r = latest_results(spark, d).filter("split = 'test' and metric = 'AUC'").withColumn("m", F.concat(F.lit("m"), F.substring("model", -1, 1)))
    return rounded(warehouse.pivot_report(r, "task", "m", "value", [f"m{k}" for k in range(5)]))


def pending_work(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).withColumn("EvalStrategy", F.when(F.col("value") < 40, warehouse.FAILED).otherwise("fixed"))
    registry = r.select("model", "task", "day").distinct()
    return warehouse.pending(registry, r, ["model", "task", "day"])


def summarise_model(spark: SparkSession, d: str) -> DataFrame:
    r = latest_results(spark, d).filter("split = 'test'")
    tasks = r.select("task").distinct().withColumn("metric", F.when(F.length("task") > 4, "AUC").otherwise("MSE"))
    return warehouse.summarise(r, tasks, "org/model-2", ["AUC", "MSE"])


def only_one_side(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    return warehouse.only_in(r.filter("model = 'org/model-0'"), r.filter("model = 'org/model-1'"), ["task", "day", "split", "metric"])


def registry_coverage(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.coverage(results(spark, d).select("task", "metric", "split").distinct(), "split", "metric")


def fold_means(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).withColumn("seconds", F.col("value") / 10)
    return rounded(warehouse.fold_means(r, ["model", "task"], ["value"], "seconds"))


def best_value(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).withColumn("better", comparison_value(F.col("metric"), F.col("value")))
    return rounded(r.groupBy("task", "metric").agg(F.max("better").alias("best")))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("variant_id"), F.col("c_nationkey").cast("string").alias("wt_id"), F.translate(F.substring("c_name", -9, 9), "0123456789", "ACDEFGHIKL").alias("mut"))
    return c.join(c.groupBy("wt_id").agg(F.min("mut").alias("wt")), "wt_id")


def _profile(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    each = n.select("k", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("pos")).select("k", "pos", F.posexplode(F.split(F.lit("ACDEFGHIKL"), "")).alias("i", "symbol"))
    return each.select(F.col("k").cast("string").alias("wt_id"), "pos", "symbol", (-((F.col("k") * 7 + F.col("pos") * 3 + F.col("i") * 5) % 11) / 4.0).alias("logp"))


def variant_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(variants.variant_scores(_variants(spark, d), _profile(spark, d)))


def mean_pll(spark: SparkSession, d: str) -> DataFrame:
    s = _variants(spark, d).select(F.col("variant_id").alias("id"), "wt_id", F.col("mut").alias("seq"))
    return rounded(variants.mean_log_likelihood(s, _profile(spark, d)))


def mutations(spark: SparkSession, d: str) -> DataFrame:
    return variants.mutated_positions(_variants(spark, d)).groupBy("wt_id").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


def consensus(spark: SparkSession, d: str) -> DataFrame:
    return variants.consensus(_variants(spark, d), "wt_id", "variant_id", "mut")


def position_window(spark: SparkSession, d: str) -> DataFrame:
    from rankloom.plans.neighbours import _positions

    w = variants.window_sum(_positions(spark, d), "protein", "pos", "x", 3, "w")
    return rounded(w.groupBy("protein").agg(F.max("w").alias("top"), F.round(F.avg("w"), 3).alias("mean")), 5)


def _probe_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = prepare.hash_split(vectors(spark, d).withColumn("y", (F.col("label") % 3).cast("double")), 42, "id")
    return rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")


def probe_linear(spark: SparkSession, d: str) -> DataFrame:
    return probes.evaluate(probes.fit_predict(*_probe_sides(spark, d), "vector", "linear", "classification"), "classification")


def probe_ridge(spark: SparkSession, d: str) -> DataFrame:
    return probes.evaluate(probes.fit_predict(*_probe_sides(spark, d), "vector", "linear", "regression"), "regression")


def ridge_per_group(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.withColumn("g", F.col("label") % 2).withColumn("y", F.col("vector")[0].cast("double") * 2 + F.col("label")) for x in _probe_sides(spark, d))
    return probes.ridge_per_group(a, b, "g", "vector").select("id", "g", "y", "prediction")


QUERIES = {f.__name__: f for f in (latest_results, collect_results, merge_same_day, compare_models, baseline_delta, winloss, top_movers, pivot_report, pending_work, summarise_model, only_one_side, registry_coverage, fold_means, best_value, variant_score, mean_pll, mutations, consensus, position_window, probe_linear, probe_ridge, ridge_per_group)}

_LAST = f"{RESULTS}, t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY model, task, split, metric ORDER BY day DESC, row_no DESC) = 1)"
_DELTA = f"{_LAST}, b AS (SELECT task, split, metric, value AS base FROM t WHERE model = 'org/model-0'), dl AS (SELECT model, task, split, metric, round(value, 6) AS value, round(base, 6) AS base, round(value - base, 6) AS delta FROM t LEFT JOIN b USING (task, split, metric))"
_VAR = "c AS (SELECT c_custkey AS variant_id, c_nationkey::VARCHAR AS wt_id, translate(right(c_name, 9), '0123456789', 'ACDEFGHIKL') AS mut FROM customer), v AS (SELECT c.*, min(mut) OVER (PARTITION BY wt_id) AS wt FROM c), e AS (SELECT variant_id, wt_id, p, wt[p + 1] AS w, mut[p + 1] AS m FROM (SELECT *, unnest(range(9)) AS p FROM v))"
_LOGP = "(-((wt_id::INT * 7 + p * 3 + (instr('ACDEFGHIKL', {}) - 1) * 5) % 11) / 4.0)"
SQL = {
    "latest_results": f"WITH {_LAST} SELECT * FROM t",
    "collect_results": f"WITH {RESULTS}, f AS (SELECT *, min(row_no) OVER (PARTITION BY model, task, split, metric, day) AS s FROM r QUALIFY row_number() OVER (PARTITION BY model, task, split, metric, day ORDER BY row_no DESC) = 1) SELECT * EXCLUDE (s) FROM f QUALIFY row_number() OVER (PARTITION BY model, task, split, metric ORDER BY day DESC, s DESC) = 1",
    "merge_same_day": f"WITH {RESULTS} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY model, task, split, metric, day ORDER BY row_no % 2 DESC, row_no DESC) = 1",
    "compare_models": f"""WITH {_LAST}, w AS (SELECT model, task, split, max(value) FILTER (metric = 'AUC') AS auc, max(value) FILTER (metric = 'MSE') AS mse FROM t GROUP BY 1, 2, 3), x AS (SELECT * FROM w WHERE model = 'org/model-0'), y AS (SELECT * FROM w WHERE model = 'org/model-1'),
j AS (SELECT coalesce(x.task, y.task) AS task, coalesce(x.split, y.split) AS split, CASE WHEN x.task IS NULL THEN 'only_b' WHEN y.task IS NULL THEN 'only_a' ELSE 'both' END AS status, CASE WHEN x.auc IS NOT NULL AND y.auc IS NOT NULL THEN 'AUC' WHEN x.mse IS NOT NULL AND y.mse IS NOT NULL THEN 'MSE' END AS metric, x.auc AS xa, y.auc AS ya, x.mse AS xm, y.mse AS ym FROM x FULL JOIN y ON x.task = y.task AND x.split = y.split),
k AS (SELECT *, CASE metric WHEN 'AUC' THEN xa WHEN 'MSE' THEN xm END AS a, CASE metric WHEN 'AUC' THEN ya WHEN 'MSE' THEN ym END AS b, CASE metric WHEN 'MSE' THEN -1 ELSE 1 END AS s FROM j),
o AS (SELECT *, CASE WHEN s * a >= s * b THEN a ELSE b END AS best, CASE WHEN s * a >= s * b THEN b ELSE a END AS other FROM k)
SELECT task, split, status, metric, CASE WHEN s * a > s * b THEN 'a' WHEN s * b > s * a THEN 'b' WHEN a = b THEN 'tie' END AS winner, round(best, 6) AS best, round(other, 6) AS other, round(best - other, 6) AS delta, round(s * (best - other) / greatest(abs(other), 1e-12) * 100, 6) AS delta_pct FROM o""",
    "baseline_delta": f"WITH {_DELTA} SELECT * FROM dl",
    "winloss": f"WITH {_DELTA}, s AS (SELECT model, CASE metric WHEN 'MSE' THEN -delta ELSE delta END AS d FROM dl WHERE delta IS NOT NULL) SELECT model, count(*) FILTER (d > 1e-4) AS wins, count(*) FILTER (d < -1e-4) AS losses, count(*) FILTER (abs(d) <= 1e-4) AS ties, round(avg(d), 6) AS mean_delta FROM s GROUP BY 1",
    "top_movers": f"WITH {_DELTA} (SELECT model, task, split, metric, delta, 'lift' AS side FROM dl WHERE delta > 1e-4 ORDER BY delta DESC, model, task, split, metric LIMIT 5) UNION ALL (SELECT model, task, split, metric, delta, 'loss' AS side FROM dl WHERE delta < -1e-4 ORDER BY delta, model, task, split, metric LIMIT 5)",
    "pivot_report": f"WITH {_LAST} SELECT task, " + ", ".join(f"round(avg(value) FILTER (model = 'org/model-{k}'), 6) AS m{k}" for k in range(5)) + " FROM t WHERE split = 'test' AND metric = 'AUC' GROUP BY 1",
    "pending_work": f"WITH {RESULTS} SELECT model, task, day FROM r GROUP BY ALL HAVING max(value) < 40",
    "summarise_model": f"WITH {_LAST} SELECT task, metric, value FROM t WHERE split = 'test' AND model = 'org/model-2' QUALIFY row_number() OVER (PARTITION BY task ORDER BY (metric <> CASE WHEN length(task) > 4 THEN 'AUC' ELSE 'MSE' END)::INT, metric) = 1",
    "only_one_side": f"WITH {RESULTS}, x AS (SELECT task, day, split, metric FROM r WHERE model = 'org/model-0'), y AS (SELECT task, day, split, metric FROM r WHERE model = 'org/model-1') SELECT *, 'a' AS side FROM (FROM x EXCEPT FROM y) UNION ALL SELECT *, 'b' AS side FROM (FROM y EXCEPT FROM x)",
    "registry_coverage": f"WITH {RESULTS}, x AS (SELECT DISTINCT task, metric, split FROM r) SELECT split, count(*) AS n_tasks, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics FROM x GROUP BY 1",
    "fold_means": f"WITH {RESULTS} SELECT model, task, round(avg(value), 6) AS value, round(sum(value / 10), 6) AS seconds, count(*) AS n_folds FROM r GROUP BY 1, 2",
    "best_value": f"WITH {RESULTS} SELECT task, metric, round(max(CASE metric WHEN 'MSE' THEN -value ELSE value END), 6) AS best FROM r GROUP BY 1, 2",
    "variant_score": f"WITH {_VAR} SELECT variant_id, round(sum(CASE WHEN w <> m THEN {_LOGP.format('m')} - {_LOGP.format('w')} ELSE 0 END), 6)::DOUBLE AS score FROM e GROUP BY 1",
    "mean_pll": f"WITH {_VAR} SELECT variant_id AS id, round(avg({_LOGP.format('m')}), 6)::DOUBLE AS mean_logp FROM e GROUP BY 1",
    "mutations": f"WITH {_VAR}, x AS (SELECT DISTINCT wt_id, p FROM e WHERE w <> m) SELECT wt_id, count(*) AS n, sum(p)::BIGINT AS places FROM x GROUP BY 1",
    "consensus": f"WITH {_VAR}, k AS (SELECT wt_id, p, m, count(*) AS n, min(variant_id) AS f FROM e GROUP BY 1, 2, 3), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY wt_id, p ORDER BY n DESC, f) = 1) SELECT wt_id, string_agg(m, '' ORDER BY p) AS consensus FROM b GROUP BY 1",
    "position_window": "WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value FROM events), w AS (SELECT user_id, sum(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS w FROM p) SELECT user_id AS protein, round(max(w), 5) AS top, round(avg(w), 3) AS mean FROM w GROUP BY 1",
}
