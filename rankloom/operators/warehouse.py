"""The table of results: latest rows, comparison, deltas, reports, work that is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions import comparison_value, relative_delta, sample_key

#: The columns that identify a result, and what stands for a missing one.
IDENTITY = ("Task", "Samples", "Probe", "EvalMode", "EvalSplit", "EvalStrategy", "EmbeddingNorm")
DEFAULTS = {"Samples": "Full", "Probe": "linear", "EvalMode": "holdout", "EvalSplit": "test", "EvalStrategy": "fixed", "EmbeddingNorm": "none", "BenchmarkSeed": "42", "CodeVersion": "unknown"}
#: Fixed value: the strategy of a row that stands for a failed unit.
FAILED = "task_exception"


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing identity columns and values get their defaults."""
    for c, v in DEFAULTS.items():
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(v)) if c in df.columns else F.lit(v))
    return df.withColumn("Samples", sample_key(F.col("Samples")))


def latest(df: DataFrame, keys: list[str], date: str, order: str) -> DataFrame:
    """The last row of each key by date, then by order. Dates that can't be read count as last."""
    when = F.col(date).cast("string").try_cast("timestamp")
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_first(when), F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def collect_latest(df: DataFrame, write_keys: list[str], cell_keys: list[str], date: str, order: str) -> DataFrame:
    """The last write of each full key, then of each cell the one of the latest date; of equal dates the key that was first seen later wins."""
    return latest_cells(last_writes(df.withColumn("first_seen", F.col(order)), write_keys, order), cell_keys, date).drop("first_seen")


def last_writes(df: DataFrame, write_keys: list[str], order: str) -> DataFrame:
    """The last row of each full key by order, with the least first_seen of the key's rows."""
    per = df.groupBy(*write_keys).agg(F.max_by(F.struct(*[c for c in df.columns if c != "first_seen"]), order).alias("_x"), F.min("first_seen").alias("first_seen"))
    return per.select("_x.*", "first_seen")


def latest_cells(writes: DataFrame, cell_keys: list[str], date: str) -> DataFrame:
    """Of each cell's writes the one of the latest date; of equal dates the one that was first seen last."""
    cell = W.partitionBy(*cell_keys).orderBy(F.desc_nulls_last(date), F.desc("first_seen"))
    return writes.withColumn("_r", F.row_number().over(cell)).filter("_r = 1").drop("_r")


def merge_new(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables' rows; where they share a key (which includes the day), the new one stays, of several the last."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def pending(registry: DataFrame, results: DataFrame, keys: list[str], strategy: str = "EvalStrategy") -> DataFrame:
    """Registered units without a successful result."""
    return registry.join(results.filter(F.col(strategy) != FAILED).select(*keys), keys, "left_anti")


def compare(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Per key: status (both, only_a, only_b), the first metric that both have, winner (a, b, tie), best, other, delta, delta_pct. Errors are compared with less being better; delta is best less other."""
    x, y = (t.select(*keys, *[F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")).alias(f"{m}_{s}") for m in metrics], F.lit(True).alias(f"_in_{s}")) for t, s in ((a, "a"), (b, "b")))
    j = x.join(y, keys, "full")
    found = F.coalesce(*[F.when(F.col(f"{m}_a").isNotNull() & F.col(f"{m}_b").isNotNull(), F.struct(F.lit(m).alias("m"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b"))) for m in metrics])
    j = j.withColumn("_f", found)
    va, vb = comparison_value(F.col("_f.m"), F.col("_f.a")), comparison_value(F.col("_f.m"), F.col("_f.b"))
    best, other = F.when(va >= vb, F.col("_f.a")).otherwise(F.col("_f.b")), F.when(va >= vb, F.col("_f.b")).otherwise(F.col("_f.a"))
    status = F.when(F.col("_in_a").isNull(), "only_b").when(F.col("_in_b").isNull(), "only_a").otherwise("both")
    return j.select(*keys, status.alias("status"), F.col("_f.m").alias("metric"), F.when(va > vb, "a").when(vb > va, "b").when(va == vb, "tie").alias("winner"), best.alias("best"), other.alias("other"), (best - other).alias("delta"), relative_delta(best, other, F.col("_f.m")).alias("delta_pct"))


def baseline_delta(df: DataFrame, keys: list[str], model: str, value: str, baseline: str, order: str) -> DataFrame:
    """Every row with delta: its value less that of the first row (by order) of the key whose model holds the baseline's name; null where there is none."""
    base = df.filter(F.contains(F.lower(F.col(model)), F.lit(baseline.lower())) & F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias("base"))
    return df.filter(F.col(value).isNotNull()).join(base, keys, "left").withColumn("delta", F.col(value) - F.col("base"))


def tally(df: DataFrame, model: str, metric: str, delta: str, dead: float = 1e-4) -> DataFrame:
    """Per model: wins, losses, ties and the mean delta; errors count with their sign turned."""
    d = comparison_value(F.col(metric), F.col(delta))
    return df.filter(F.col(delta).isNotNull()).groupBy(model).agg(F.count_if(d > dead).alias("wins"), F.count_if(d < -dead).alias("losses"), F.count_if(F.abs(d) <= dead).alias("ties"), F.avg(d).alias("mean_delta"))


def pivot_report(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A row per task, a column per model, the mean of duplicates."""
    return df.groupBy(row).pivot(column, columns).agg(F.avg(value))


#: The columns in which a metric is looked for where a row lacks its task's own, in this order.
SCANNED = ("AUC", "Spearman", "F1_Macro", "Accuracy", "MCC", "Recall@10", "MSE")
#: The keys of a record's metrics that stand in for its task's own one, in this order, and what they are called.
RECORD_KEYS = (("eval_spearman", "Spearman"), ("eval_auc", "AUC"), ("eval_accuracy", "Accuracy"), ("eval_f1_macro", "F1_Macro"), ("eval_matthews_correlation", "MCC"), ("eval_mcc", "MCC"))


def long_rows(df: DataFrame, keys: list[str], declared: str) -> DataFrame:
    """keys, metric_name, metric_value of wide rows: the declared metric, else the first of SCANNED that has a value, called what it is; and for rows whose metric isn't MSE a second row of their MSE."""
    found = F.coalesce(*[F.when((F.col(declared) == m) & F.col(m).isNotNull(), F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("metric_value"))) for m in SCANNED if m in df.columns], *[F.when(F.col(m).isNotNull(), F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("metric_value"))) for m in SCANNED if m in df.columns], F.struct(F.col(declared).alias("metric_name"), F.lit(None).cast("double").alias("metric_value")))
    more = F.when((F.col("_f.metric_name") != "MSE") & F.col("MSE").isNotNull(), F.array(F.struct(F.lit("MSE").alias("metric_name"), F.col("MSE").cast("double").alias("metric_value")))) if "MSE" in df.columns else F.lit(None)
    none = F.array().cast("array<struct<metric_name:string,metric_value:double>>")
    return df.withColumn("_f", found).select(*keys, F.explode(F.concat(F.array("_f"), F.coalesce(more, none))).alias("x")).select(*keys, "x.*")


def long_records(df: DataFrame, keys: list[str], declared: str, metrics: str) -> DataFrame:
    """keys, metric_name, metric_value of records with a map of metrics, whose keys are compared in lower case: the declared metric (also without the ending _Macro), else the first of RECORD_KEYS, called what it is; and for records of another metric a second row of their AUC."""
    lower = F.map_from_entries(F.transform(F.map_entries(metrics), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].cast("double").alias("value"))))
    at = lambda key: F.try_element_at("_m", key if not isinstance(key, str) else F.lit(key))
    named = lambda name, value: F.when(value.isNotNull(), F.struct(name.alias("metric_name"), value.alias("metric_value")))
    own = F.lower(F.concat(F.lit("eval_"), F.col(declared)))
    found = F.coalesce(named(F.col(declared), at(own)), named(F.col(declared), at(F.regexp_replace(own, "_macro", ""))), *[named(F.lit(n), at(k)) for k, n in RECORD_KEYS], F.struct(F.col(declared).alias("metric_name"), F.lit(None).cast("double").alias("metric_value")))
    extra = F.when((F.lower(declared) != "auc") & at("eval_auc").isNotNull(), F.array(F.struct(F.lit("AUC").alias("metric_name"), at("eval_auc").alias("metric_value"))))
    none = F.array().cast("array<struct<metric_name:string,metric_value:double>>")
    return df.withColumn("_m", lower).select(*keys, F.explode(F.concat(F.array(found), F.coalesce(extra, none))).alias("x")).select(*keys, "x.*")


def with_rule(parts: dict[str, DataFrame], column: str, value: str) -> DataFrame:
    """One row per aggregation rule: its name and value. parts: a frame of one row for each rule."""
    out = None
    for rule, df in parts.items():
        row = df.select(F.lit(rule).alias(column), F.col(value).cast("double").alias(value))
        out = row if out is None else out.unionByName(row)
    return out


def panel_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    """The mean of finite values, their number, and the detail: an array of group and value in order."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))
    some = df.filter(finite)
    return some.agg(F.avg(value).alias("mean"), F.count("*").alias("n_groups"), F.array_sort(F.collect_list(F.struct(group, value))).alias("detail"))


def ordered_models(df: DataFrame, model: str, stages: list[str], out: str = "place") -> DataFrame:
    """df with the place of each model: the number of the first stage whose name it holds, else after all stages."""
    place = F.coalesce(*[F.when(F.contains(F.lower(F.col(model)), F.lit(s.lower())), F.lit(k)) for k, s in enumerate(stages)], F.lit(len(stages)))
    return df.withColumn(out, place)


def baseline_views(df: DataFrame, views: list[tuple[str, str]], keys: list[str], model: str, value: str, baseline: str, order: str) -> DataFrame:
    """The deltas against the baseline of each view (a probe and a split), one after the other."""
    out = None
    for probe, split in views:
        part = baseline_delta(df.filter((F.col("probe") == probe) & (F.col("split") == split)), keys, model, value, baseline, order)
        out = part if out is None else out.unionByName(part)
    return out


def side_by_side(df: DataFrame, task: str, model: str, value: str, order: str, models: list[str]) -> DataFrame:
    """A row per task with the last value of each model, null where it has none."""
    last = df.groupBy(task, model).agg(F.max_by(value, order).alias("_v"))
    return last.groupBy(task).pivot(model, models).agg(F.first("_v"))


def lift(df: DataFrame, score: str, value: str, baseline: str) -> DataFrame:
    """df with lift: the value less that of the baseline score. One row for each score."""
    base = df.filter(F.col(score) == baseline).select(F.col(value).alias("_b"))
    # One row.
    return df.join(F.broadcast(base), F.lit(True), "left").withColumn("lift", F.col(value) - F.col("_b")).drop("_b")


def registry(tasks: DataFrame, metrics: dict[str, str], presets: dict[str, Column]) -> DataFrame:
    """key, name, type, metric, preset: each task once for each preset that it belongs to. tasks: key, type; metrics: the headline metric of a type."""
    metric = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in metrics.items()])
    member = F.array_compact(F.array(*[F.when(c, F.lit(p)) for p, c in presets.items()]))
    return tasks.select("key", F.initcap("key").alias("name"), "type", metric.alias("metric"), F.explode(member).alias("preset"))


def task_families(kinds: DataFrame, modes: DataFrame, kind: str, mode: str, prefix: str) -> DataFrame:
    """key, kind, mode: a task for each kind and mode, two small tables."""
    both = kinds.select(kind).distinct().crossJoin(F.broadcast(modes.select(mode).distinct()))
    return both.select(F.concat_ws("_", F.lit(prefix), F.lower(F.regexp_replace(kind, r"\s+", "_")), F.lower(F.regexp_replace(mode, r"\s+", "_"))).alias("key"), kind, mode)


def movers(df: DataFrame, delta: str, k: int, dead: float = 1e-4) -> DataFrame:
    """The k largest lifts and the k largest losses beyond the dead band."""
    up = df.filter(F.col(delta) > dead).orderBy(F.desc(delta), *[c for c in df.columns if c != delta]).limit(k).withColumn("side", F.lit("lift"))
    down = df.filter(F.col(delta) < -dead).orderBy(delta, *[c for c in df.columns if c != delta]).limit(k).withColumn("side", F.lit("loss"))
    return up.unionByName(down)


def fold_means(df: DataFrame, keys: list[str], metrics: list[str], seconds: str) -> DataFrame:
    """Per identity: the mean of finite metrics, summed seconds, the number of folds."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    return df.groupBy(*keys).agg(*[F.avg(finite(m)).alias(m) for m in metrics], F.sum(seconds).alias(seconds), F.count("*").alias("n_folds"))


def summarise(df: DataFrame, tasks: DataFrame, model: str, fallbacks: list[str]) -> DataFrame:
    """One row per task of a model: its declared metric's value, else the first there is. tasks: task, metric; df: model, task, metric, value."""
    rank = F.coalesce(*[F.when(F.col("metric") == m, F.lit(k + 1)) for k, m in enumerate(fallbacks)], F.lit(len(fallbacks) + 1))
    j = df.filter(F.col("model") == model).join(tasks.withColumnRenamed("metric", "declared"), "task")
    order = F.struct(F.when(F.col("metric") == F.col("declared"), 0).otherwise(rank).alias("r"), F.col("metric"))
    return j.groupBy("task").agg(F.min_by(F.struct("metric", "value"), order).alias("x")).select("task", "x.metric", "x.value")


def coverage(tasks: DataFrame, kind: str, metric: str) -> DataFrame:
    """Per kind: tasks and their distinct metrics."""
    return tasks.groupBy(kind).agg(F.count("*").alias("n_tasks"), F.array_join(F.array_sort(F.collect_set(metric)), ",").alias("metrics"))


def identity_key(columns: list[str]) -> Column:
    """The identity as text; parts that are the default are left out, save the first."""
    parts = [F.col(columns[0]), *[F.when(F.col(c) != DEFAULTS.get(c, ""), F.concat(F.lit(f"{c}="), F.col(c))) for c in columns[1:]]]
    return F.concat_ws("|", *parts)


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side alone, with the side."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("a")).unionByName(y.join(x, keys, "left_anti").withColumn("side", F.lit("b")))


def sweep(tasks: DataFrame, seeds: list[int]) -> DataFrame:
    """A row per task and seed."""
    return tasks.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def failure_rows(units: DataFrame, error: str) -> DataFrame:
    """Rows that stand for failed units."""
    return units.withColumn("Error", F.lit(error)).withColumn("EvalStrategy", F.lit(FAILED))


def with_settings(df: DataFrame, settings: str = "settings", out: str = "ScorerSettings") -> DataFrame:
    """df with a scorer's settings (a map) as one text, names in order: a part of a score's identity, so scores of other settings are never taken for these. Without settings it is empty."""
    pairs = F.transform(F.array_sort(F.map_keys(settings)), lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(F.col(settings), k), F.lit(""))))
    return df.withColumn(out, F.coalesce(F.concat_ws(",", pairs), F.lit("")))


def score_identity(df: DataFrame, settings: str = "settings", version: str = "CodeVersion") -> list[str]:
    """The columns that identify a score: those of a result, its scorer's settings, and the code version. Rows need with_defaults() and with_settings()."""
    return [*IDENTITY, "ScorerSettings", version]
