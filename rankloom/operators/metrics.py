"""Classification, ranking, regression and retrieval metrics as distributed aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _buckets(df: DataFrame, buckets: int | None = None) -> int:
    return buckets or max(1, min(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def quantiles(df: DataFrame, values: list[str], buckets: int | None = None, repeated: bool = False) -> dict[str, list]:
    """Bounds that deal the values of several columns into buckets, all from one pass; a frequent value's bound as often as it fills a bucket, if repeated."""
    n = _buckets(df, buckets)
    if n == 1:
        return {v: [] for v in values}
    cuts = [i / n for i in range(1, n)]
    row = df.agg(*[F.percentile_approx(v, cuts, 40 * n).alias(f"b{k}") for k, v in enumerate(values)]).first()
    return {v: sorted(row[k] or [] if repeated else set(row[k] or [])) for k, v in enumerate(values)}


def _bucket(value: str, bounds: list) -> Column:
    """How many bounds are at most the value: first among every 16th of them, then among those between."""
    if not bounds:
        return F.lit(0)
    below = lambda array: F.size(F.filter(array, lambda b: b <= F.col(value)))
    if len(bounds) <= 16:
        return below(F.array(*[F.lit(b) for b in bounds]))
    parts = [bounds[i : i + 16] for i in range(0, len(bounds), 16)]
    part = below(F.array(*[F.lit(p[0]) for p in parts]))
    own = F.element_at(F.array(*[F.array(*[F.lit(b) for b in p]) for p in parts]), F.greatest(part, F.lit(1)))
    return F.when(part == 0, 0).otherwise((part - 1) * 16 + below(own))


#: Rows of a group that one window sorts; larger groups are dealt into buckets. Rows that one task sorts, about.
GROUP_ROWS, TASK_ROWS = 200_000, 500_000


def tasks(df: DataFrame, rows: int) -> int:
    """How many tasks so many rows are dealt to: as there are cores, and more where each would have more than TASK_ROWS."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def small_groups(df: DataFrame, groups: list[str], most: int = GROUP_ROWS) -> int:
    """Where each group has so few rows that a window over it is no task's burden: to how many tasks the groups are dealt. Otherwise 0."""
    if not groups:
        return 0
    largest, rows = df.groupBy(*groups).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return tasks(df, rows or 0) if (largest or 0) <= most else 0


def window_ranks(df: DataFrame, groups: list[str], values: dict[str, str], parts: int | None = None) -> DataFrame:
    """df with the mean rank (from 1) of each value among its group's rows, for small groups: one exchange by group serves all values. values: column and the name of its rank; parts: how many tasks get the groups, so that what one sorts doesn't grow with the rows."""
    if parts:
        df = df.repartition(parts, *groups)
    for v, out in values.items():
        ties = F.count("*").over(W.partitionBy(*groups, v))
        df = df.withColumn(out, F.rank().over(W.partitionBy(*groups).orderBy(v)) + (ties - 1) / 2)
    return df


def running_counts(df: DataFrame, value: str, groups: list[str], extra: dict[str, Column] | None = None, bounds: list | None = None) -> DataFrame:
    """One row per group and value: n (rows), before (rows of smaller values) and, for each extra aggregate, its sum here and before_<name>.

    Values are dealt into buckets by quantiles, and sums run inside a bucket and over the buckets' totals,
    so no task holds all values of a large group. Rows with null value are left out.
    """
    extra = extra or {}
    some = df.filter(F.col(value).isNotNull())
    if bounds is None:
        bounds = quantiles(some, [value])[value]
    per = some.groupBy(*groups, value).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in extra.items()]).withColumn("_b", _bucket(value, bounds))
    names = ["n", *extra]
    sums = per.groupBy(*groups, "_b").agg(*[F.sum(k).alias(f"_t_{k}") for k in names])
    over = W.partitionBy(*(groups or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offset = sums.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_b").alias("_ob"), *[F.coalesce(F.sum(f"_t_{k}").over(over), F.lit(0)).alias(f"_o_{k}") for k in names])
    match = F.col("_b") == F.col("_ob")
    for g in groups:
        match &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = W.partitionBy(*groups, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    # As many offsets as groups and buckets.
    joined = per.join(offset, match)
    return joined.select(*groups, value, *names, *[(F.coalesce(F.sum(k).over(inside), F.lit(0)) + F.col(f"_o_{k}")).alias("before" if k == "n" else f"before_{k}") for k in names])


def tie_ranks(df: DataFrame, value: str, groups: list[str], out: str, extra: dict[str, Column] | None = None, bounds: list | None = None) -> DataFrame:
    """group, value and the mean rank (from 1) of the rows with this value."""
    return running_counts(df, value, groups, extra, bounds).select(*groups, value, (F.col("before") + (F.col("n") + 1) / 2).alias(out))


def spearman(df: DataFrame, a: str, b: str, groups: list[str]) -> DataFrame:
    """spearman and n per group; groups of fewer than two rows go, constant ones count 0."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    if parts := small_groups(rows, groups):
        return _correlated(window_ranks(rows.select(*groups, F.col(a).alias("_a"), F.col(b).alias("_b"), F.lit(1).alias("_c")), groups, {"_a": "_ra", "_b": "_rb"}, parts), groups)
    bounds = quantiles(rows, [a, b])
    # Rows with the same values are one weighted row in the joins, so that a frequent value costs no more than its distinct partners.
    pairs = rows.groupBy(*groups, a, b).agg(F.count("*").alias("_c"))
    ranked = pairs.join(tie_ranks(rows, a, groups, "_ra", None, bounds[a]), [*groups, a]).join(tie_ranks(rows, b, groups, "_rb", None, bounds[b]), [*groups, b])
    return _correlated(ranked, groups)


def _correlated(ranked: DataFrame, groups: list[str]) -> DataFrame:
    """spearman and n from rows with _ra, _rb and how often they stand."""
    total = lambda c: F.sum(F.col("_c") * c)
    x, y = F.col("_ra"), F.col("_rb")
    sums = ranked.groupBy(*groups).agg(F.sum("_c").alias("n"), total(x).alias("_x"), total(y).alias("_y"), total(x * x).alias("_xx"), total(y * y).alias("_yy"), total(x * y).alias("_xy"))
    spread = (F.col("n") * F.col("_xx") - F.col("_x") * F.col("_x")) * (F.col("n") * F.col("_yy") - F.col("_y") * F.col("_y"))
    value = F.when(spread > 0, (F.col("n") * F.col("_xy") - F.col("_x") * F.col("_y")) / F.sqrt(spread)).otherwise(0.0)
    return sums.filter("n >= 2").select(*groups, "n", value.alias("spearman"))


def auc(df: DataFrame, label: str, score: str, groups: list[str]) -> DataFrame:
    """auc, n and n_pos per group, ties counted half; null where a group has one class or a row without label."""
    rows = df.withColumn("_y", F.col(label).cast("int"))
    if parts := small_groups(rows, groups):
        ranked = window_ranks(rows.filter(F.col(score).isNotNull()).select(*groups, "_y", F.col(score).alias("_s")), groups, {"_s": "_rank"}, parts)
        out = ranked.groupBy(*groups).agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("n_pos"), F.count_if(F.col("_y").isNull()).alias("_none"), F.sum(F.col("_y") * F.col("_rank")).alias("_r"))
    else:
        per = running_counts(rows, score, groups, {"pos": F.sum(F.coalesce("_y", F.lit(0))), "none": F.count_if(F.col("_y").isNull())})
        ranks = F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2))
        out = per.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum("none").alias("_none"), ranks.alias("_r"))
    neg = F.col("n") - F.col("n_pos")
    value = (F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * neg)
    return out.select(*groups, F.when((F.col("_none") == 0) & (F.col("n_pos") > 0) & (neg > 0), value).alias("auc"), "n", "n_pos")


def average_precision(df: DataFrame, label: str, score: str, groups: list[str]) -> DataFrame:
    """average_precision per group: over the distinct scores from the highest, steps in recall times precision."""
    rows = df.withColumn("_y", F.col(label).cast("int")).withColumn("_down", -F.col(score).cast("double"))
    per = running_counts(rows, "_down", groups, {"pos": F.sum("_y")})
    totals = per.groupBy(*groups).agg(F.sum("pos").alias("_p"))
    joined = per.join(totals, groups) if groups else per.crossJoin(totals)  # one row of totals
    step = F.col("pos") / F.col("_p") * (F.col("before_pos") + F.col("pos")) / (F.col("before") + F.col("n"))
    return joined.groupBy(*groups).agg(F.coalesce(F.sum(F.when(F.col("_p") > 0, step)), F.lit(0.0)).alias("average_precision"))


def confusion(df: DataFrame, truth: str, predicted: str, groups: list[str] = ()) -> DataFrame:
    """Rows per true and predicted label."""
    return df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*groups, F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Per label: tp, actual, predicted, f1. Labels of truth or prediction."""
    groups = list(groups)
    both = matrix.select(*groups, F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))).alias("x")).select(*groups, "x.*")
    sums = both.groupBy(*groups, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "predicted")])
    return sums.withColumn("f1", 2 * F.col("tp") / (F.col("actual") + F.col("predicted")))


def class_metrics(matrix: DataFrame, groups: list[str] = ()) -> DataFrame:
    """n, accuracy, f1_macro, f1_weighted, balanced_accuracy, mcc and f1_binary (of the largest label) from a confusion matrix."""
    s = per_class(matrix, groups).groupBy(*groups).agg(F.sum("actual").alias("n"), F.sum("tp").alias("c"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("actual")) / F.sum("actual")).alias("f1_weighted"), F.avg(F.when(F.col("actual") > 0, F.col("tp") / F.col("actual"))).alias("balanced_accuracy"), F.sum(F.col("actual") * F.col("predicted")).alias("tp_"), F.sum(F.col("actual") * F.col("actual")).alias("tt"), F.sum(F.col("predicted") * F.col("predicted")).alias("pp"), F.max_by("f1", "label").alias("f1_binary"))
    n, under = F.col("n").cast("double"), F.sqrt((F.col("n") * F.col("n") - F.col("pp")).cast("double")) * F.sqrt((F.col("n") * F.col("n") - F.col("tt")).cast("double"))
    return s.select(*groups, "n", (F.col("c") / n).alias("accuracy"), "f1_macro", "f1_weighted", "balanced_accuracy", F.when(under > 0, (F.col("c") * n - F.col("tp_")) / under).otherwise(0.0).alias("mcc"), "f1_binary")


def multilabel_metrics(df: DataFrame, key: str, truth: str, predicted: str) -> DataFrame:
    """n, subset_accuracy, f1_micro and f1_macro of label arrays; 0 where nothing is to divide by."""
    exact = df.agg(F.count("*").alias("n"), F.avg((F.array_sort(F.array_distinct(truth)) == F.array_sort(F.array_distinct(predicted))).cast("double")).alias("subset_accuracy"))
    flags = df.select(F.explode(F.array_union(truth, predicted)).alias("label"), F.col(truth).alias("_t"), F.col(predicted).alias("_p"))
    has_t, has_p = F.array_contains("_t", F.col("label")), F.array_contains("_p", F.col("label"))
    per = flags.groupBy("label").agg(F.count_if(has_t & has_p).alias("tp"), F.count_if(~has_t & has_p).alias("fp"), F.count_if(has_t & ~has_p).alias("fn"))
    under = lambda s: 2 * s("tp") + s("fp") + s("fn")
    f1 = per.agg(F.coalesce(2 * F.sum("tp") / under(F.sum), F.lit(0.0)).alias("f1_micro"), F.coalesce(F.avg(2 * F.col("tp") / under(F.col)), F.lit(0.0)).alias("f1_macro"))
    return exact.crossJoin(f1)  # one row each


def regression(df: DataFrame, truth: str, predicted: str, groups: list[str]) -> DataFrame:
    """n, spearman, pearson, mse, mae and r2 per group."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    rows = df.filter(y.isNotNull() & p.isNotNull())
    block = rows.groupBy(*groups).agg(F.coalesce(F.corr(y, p), F.lit(0.0)).alias("pearson"), F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), (1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count("*"))).alias("r2"))
    ranks = spearman(rows, truth, predicted, groups)
    out = block.join(ranks, groups) if groups else block.crossJoin(ranks)  # one row each
    return out.select(*groups, "n", "spearman", "pearson", "mse", "mae", "r2")


def score_board(df: DataFrame, group: str, measured: str, binary: str, scores: list[str]) -> DataFrame:
    """score, group, spearman, auc, n of several scores of the same rows; a score that is constant or not finite in a group is left out there."""
    long = df.select(group, measured, binary, F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("_s")) for s in scores])).alias("x")).select(group, measured, binary, "x.*")
    good = long.groupBy("score", group).agg((F.min("_s") < F.max("_s")).alias("a"), F.bool_and(F.col("_s").isNotNull() & ~F.isnan("_s") & (F.abs("_s") != float("inf"))).alias("b")).filter("a and b").select("score", group)
    # Spark takes the exploded rows for fewer than they are, and would send them whole to the driver to broadcast them.
    rows = long.hint("merge").join(good, ["score", group])
    return spearman(rows, measured, "_s", ["score", group]).join(auc(rows, binary, "_s", ["score", group]).drop("n", "n_pos"), ["score", group])


def hierarchical_mean(df: DataFrame, value: str, levels: list[list[str]]) -> DataFrame:
    """The mean of the means, from the finest level's keys to the whole."""
    for keys in levels:
        df = df.groupBy(*keys).agg(F.avg(value).alias(value))
    return df.agg(F.avg(value).alias(value))


def ovr_auc(scores: DataFrame, truth: str, label: str, score: str) -> DataFrame:
    """auc_macro and the number of labels that have both classes, from a row per item and label."""
    per = auc(scores.withColumn("_hit", (F.col(truth) == F.col(label)).cast("int")), "_hit", score, [label])
    return per.agg(F.avg("auc").alias("auc_macro"), F.count("auc").alias("n_labels"))
