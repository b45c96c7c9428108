"""Columns, labels, splits, folds and caps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions import split_hash

#: Names of the validation split.
VALIDATION = ("validation", "valid", "val", "dev", "eval")


def resolve(df: DataFrame, role: str, wanted: str | None, fallbacks: list[str]) -> str:
    """The first of the wanted name and the fallbacks that df has, ignoring case only where nothing fits exactly."""
    tried = [c for c in [wanted, *fallbacks] if c]
    lower = {c.lower(): c for c in df.columns}
    for c in tried:
        if c in df.columns:
            return c
    for c in tried:
        if c.lower() in lower:
            return lower[c.lower()]
    raise ValueError(f"no column for {role}: tried {tried}, found {df.columns}")


def paired(df: DataFrame, roles: dict[str, str], out: str = "pair") -> DataFrame:
    """A struct of several sequences, in order of their roles' names."""
    return df.withColumn(out, F.struct(*[F.col(roles[r]).alias(r) for r in sorted(roles)]))


def numeric_label(label: Column) -> Column:
    """A label as integer where it is one, else null."""
    return label.cast("string").try_cast("int")


def first_label(df: DataFrame, column: str) -> Column:
    """A label column as it is, or the first element of its lists."""
    return F.try_element_at(F.col(column), F.lit(1)) if dict(df.dtypes)[column].startswith("array") else F.col(column)


def parsed_label(df: DataFrame, column: str, problem: str) -> Column:
    """A label (of lists, the first element) for a problem: regression as a double; classes as text, integers without leading zeros or signs of plus."""
    label = first_label(df, column).cast("string")
    if problem == "regression":
        return label.try_cast("double")
    return F.coalesce(F.trim(label).try_cast("int").cast("string"), label)


def without_spaces(sequence: Column) -> Column:
    """A sequence without any white space."""
    return F.regexp_replace(sequence, r"\s+", "")


def label_list(text: Column) -> Column:
    """Labels divided by commas or blanks."""
    return F.filter(F.split(F.regexp_replace(text, ",", " "), r"\s+"), lambda x: x != "")


def mapped(label: Column, mapping: dict[str, str]) -> Column:
    """The mapped label, or itself."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]) if mapping else F.create_map()
    return F.coalesce(F.try_element_at(table, label.cast("string")), label.cast("string")) if mapping else label.cast("string")


def vocabulary(df: DataFrame, label: str, *others: DataFrame) -> DataFrame:
    """label and index of all distinct labels of the splits given, a number bounded by the task: integers keep their value, others are counted from 0 in alphabetical order."""
    every = df.select(label)
    for other in others:
        every = every.union(other.select(label))
    found = every.filter(F.col(label).isNotNull()).distinct()
    if dict(df.dtypes)[label] in ("tinyint", "smallint", "int", "bigint"):
        return found.withColumn("index", F.col(label).cast("int"))
    return found.withColumn("index", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(label)) - 1)


def width(vocabulary_: DataFrame) -> int:
    """The classes that a vocabulary's indices need."""
    return (vocabulary_.agg(F.max("index")).first()[0] or 0) + 1


def residue_labels(text: Column, alphabet: str) -> Column:
    """A label string as numbers by their place in the alphabet; -1 for other signs. The length stays."""
    places = F.array(*[F.lit(a) for a in alphabet])
    return F.transform(F.split(text, ""), lambda c: F.coalesce(F.array_position(places, c), F.lit(0)).cast("int") - 1)


#: The symbols of three and of eight states of secondary structure, in the order of their numbers.
THREE_STATES, EIGHT_STATES = "HEC", "GHIBESTC"


def decoded_labels(task: str, column: str, text: Column) -> Column:
    """A label string as numbers, by what its task and column are called: disorder (listed numbers, or signs 0 and 1), eight states, three states (other symbols -1), else listed integers or digits. The more special name wins, as names overlap."""
    name = task.lower()
    digits = F.transform(F.regexp_extract_all(text, F.lit(r"(\d)"), F.lit(1)), lambda d: d.cast("int"))
    if "disorder" in name or column.startswith("disorder"):
        listed = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double").cast("int"))
        bits = F.transform(F.regexp_extract_all(text, F.lit("([01])"), F.lit(1)), lambda d: d.cast("int"))
        return F.when(text.rlike(r"[.\[]"), listed).otherwise(bits)
    if column == "dssp8" or "ss8" in name or "dssp8" in name:
        return residue_labels(text, EIGHT_STATES)
    if "ss3" in name or "secondary structure" in name:
        return residue_labels(text, THREE_STATES)
    listed = F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    return F.when(F.contains(text, F.lit(",")), listed).otherwise(digits)


def span_content_differs(labels: Column, declared: Column, most: float = 1e-3) -> Column:
    """Whether the labelled share of a sequence is another than declared (null: nothing declared, no difference); null for an empty one."""
    share = F.aggregate(labels, F.lit(0), lambda a, x: a + x) / F.size(labels)
    return F.when(F.size(labels) > 0, F.coalesce(F.abs(share - declared) > most, F.lit(False)))


def span_labels(length: Column, regions: Column, term: str = "disorder") -> Column:
    """0 or 1 for each position from 1 to length: whether a region (start, end, term; both ends inside) of the term covers it."""
    good = F.filter(regions, lambda r: F.lower(F.trim(r["term"])) == term)
    return F.when(length < 1, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda p: F.exists(good, lambda r: (p >= r["start"]) & (p <= r["end"])).cast("int")))


def digit_scores(text: Column) -> Column:
    """The digits of a string as numbers."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d)"), F.lit(1)), lambda d: d.cast("int"))


def trimmed_pair(sequence: Column, labels: Column) -> list[Column]:
    """A sequence and its labels, both cut to the shorter of the two; null where there are no labels."""
    n = F.least(F.length(sequence), F.size(labels))
    some = F.size(labels) > 0
    return [F.when(some, F.substring(sequence, F.lit(1), n)), F.when(some, F.slice(labels, F.lit(1), n))]


def routed_score(score: Column, raw: Column, split: Column) -> Column:
    """A struct of score (the number, or the parsed raw target) and split (test, or train for all else); null where no number is left."""
    value = F.coalesce(score.cast("double"), F.trim(raw.cast("string")).try_cast("double"))
    return F.when(value.isNotNull() & ~F.isnan(value), F.struct(value.alias("score"), F.when(F.lower(F.trim(split)) == "test", "test").otherwise("train").alias("split")))


def aligned(df: DataFrame, keys: list[str], vectors: str, labels: str, length: str, window: int, most: float = 0.5) -> DataFrame:
    """keys, pos, vec, label of each position that has both, and misaligned (0 or 1): whether the entity's numbers of vectors and labels differ and no cut of sequences longer than window - 2 explains it. An error where more than most of all entities are misaligned."""
    n_v, n_l = F.size(vectors), F.size(labels)
    cut = (n_v < n_l) & (F.col(length) > window - 2)
    rows = df.filter(n_v > 0).withColumn("misaligned", ((n_v != n_l) & ~cut).cast("int"))
    bad, n = rows.agg(F.coalesce(F.sum("misaligned"), F.lit(0)), F.count("*")).first()
    if bad > most * n:
        raise ValueError(f"{bad} of {n} entities have other numbers of labels than of vectors")
    both = F.least(n_v, n_l)
    zipped = F.arrays_zip(F.slice(vectors, F.lit(1), both).alias("v"), F.slice(labels, F.lit(1), both).alias("l"))
    return rows.select(*keys, "misaligned", F.posexplode(zipped).alias("pos", "x")).select(*keys, "misaligned", "pos", F.col("x.v").alias("vec"), F.col("x.l").alias("label"))


def without_ignored(df: DataFrame, label: str = "label") -> DataFrame:
    """Positions with a label: negative ones say that there is no truth."""
    return df.filter(F.col(label) >= 0)


def routed_probe(kind: Column, mode: Column, requested: Column, special: list[str], task: Column, multilabel: tuple[str, ...] = ("linear", "torch_linear")) -> Column:
    """The probe that a task is run with: auto goes by the task's kind; retrieval and zero-shot tasks have the linear name, and so has what a multilabel task can't use."""
    auto = F.when(kind.isin("multilabel", "token_classification") | task.isin(*special), "torch_linear").otherwise("linear")
    probe = F.when(requested == "auto", auto).otherwise(requested)
    return F.when((kind == "retrieval") | (mode == "zeroshot"), "linear").when((kind == "multilabel") & ~probe.isin(*multilabel), "linear").otherwise(probe)


def probe_name(probe: Column, normalised: Column, weights: Column) -> Column:
    """A probe's name in results: neighbours say whether vectors have length one and votes are weighted."""
    return F.when(probe != "knn", probe).otherwise(F.concat(probe, F.when(normalised, "_l2").otherwise(""), F.when(weights == "distance", "_dist").otherwise("")))


def prefix_labels(*parts: str) -> list[Column]:
    """c, c.a, c.a.t and so on."""
    return [F.concat_ws(".", *parts[: k + 1]) for k in range(len(parts))]


def split_names(found: list[str], wanted: str) -> list[str]:
    """Those of the split names found (in lower case) that a wanted one means: itself, of validation its other names, else the first that holds it."""
    names = VALIDATION if wanted.lower() in VALIDATION else (wanted.lower(),)
    exact = [x for x in found if x in names]
    return exact or [x for x in sorted(found) if any(n in x for n in names)][:1]


def pick_split(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows of a split by name. An error names the splits that there are if it isn't one of them."""
    name = F.lower(F.trim(column))
    found = [r[0] for r in df.select(name.alias("s")).distinct().collect() if r[0] is not None]
    names = split_names(found, wanted)
    if not names:
        raise ValueError(f"no split {wanted}: found {sorted(found)}")
    return df.filter(name.isin(*names))


def staged(df: DataFrame, column: str, stages: dict[str, str], out: str = "stage") -> tuple[DataFrame, bool]:
    """df with the stage that each row's split is for, rows of other splits left out, and whether the last stage has no rows and needs cross-validation of the first. An error if the first stage has none."""
    name = F.lower(F.trim(column))
    sizes = {r[0]: r[1] for r in df.groupBy(name.alias("s")).count().collect() if r[0] is not None}
    chosen = {stage: split_names(list(sizes), wanted) for stage, wanted in stages.items()}
    first, *_, last = chosen
    if not chosen[first]:
        raise ValueError(f"no rows for {first}: found {sorted(sizes)}")
    pairs = [(names, stage) for stage, names in chosen.items() if names]
    of = F.coalesce(*[F.when(name.isin(*names), F.lit(stage)) for names, stage in pairs])
    return df.withColumn(out, of).filter(F.col(out).isNotNull()), not chosen[last]


def bucket_split(df: DataFrame, key: str, out: str = "split") -> DataFrame:
    """test for the first of ten hash buckets of the key, validation for the second, train for the others."""
    bucket = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("bigint") % 10
    return df.withColumn(out, F.when(bucket == 0, "test").when(bucket == 1, "validation").otherwise("train"))


def hold_out_last(df: DataFrame, entity: str, least: int = 5, out: str = "split") -> DataFrame:
    """train for the first floor(0.8 n) entities in order, test for the last ones; an error below least entities."""
    from rankloom.operators.metrics import running_counts

    every = df.select(entity).distinct()
    n = every.count()
    if n < least:
        raise ValueError(f"{n} entities, {least} are needed to hold some out")
    order = running_counts(every, entity, []).select(entity, F.when(F.col("before") < max(1, n * 8 // 10), "train").otherwise("test").alias(out))
    return df.join(order, entity)


def answerable_split(queries: DataFrame, lookup: DataFrame, label: str, path: str, name: str = "answerable") -> DataFrame:
    """The answerable queries, written as a split of their own below path."""
    from rankloom.sources import write_split

    return write_split(answerable(queries, lookup, label), path, name)


def answerable(queries: DataFrame, lookup: DataFrame, label: str) -> DataFrame:
    """The queries whose label the lookup has."""
    return queries.join(lookup.select(label).distinct(), label, "left_semi")


def hash_split(df: DataFrame, seed: int, *keys: str, out: str = "split") -> DataFrame:
    """train for eight tenths of the keys, test for the others; all rows of a key on one side."""
    return df.withColumn(out, F.when(split_hash(seed, *keys) % 10 < 8, "train").otherwise("test"))


#: Rows of a group that one window numbers.
GROUP_ROWS = 200_000


def numbered(df: DataFrame, groups: list[str], seed: int, key: str, out: str, most: int = GROUP_ROWS) -> DataFrame:
    """df with out: each row's number (from 1) in its group, in the hashed order of seed and key (then by key). A group of more than most rows is cut into stretches of the order, which are numbered apart and shifted by the rows before them, so no task orders a whole large group."""
    order = split_hash(seed, key)
    sizes = df.groupBy(*groups).agg(F.count("*").alias("_size")).filter(F.col("_size") > most)
    window = W.partitionBy(*groups).orderBy(order, key)
    if sizes.isEmpty():
        return df.withColumn(out, F.row_number().over(window))
    match = lambda left, right, names: reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[f"_g{k}"]) for k, n in enumerate(names)])
    renamed = lambda t: t.withColumnsRenamed({g: f"_g{k}" for k, g in enumerate(groups)})
    large = renamed(sizes)
    hashed = df.withColumn("_h", order)
    parts = F.coalesce(F.ceil(F.col("_size") / most), F.lit(1))
    cut = hashed.join(large, match(hashed, large, groups), "left").withColumn("_stretch", F.floor(F.col("_h") * parts / (1 << 32))).drop("_size", *[f"_g{k}" for k in range(len(groups))])
    counts = cut.groupBy(*groups, "_stretch").agg(F.count("*").alias("_n"))
    shift = renamed(counts.withColumn("_shift", F.sum("_n").over(W.partitionBy(*groups).orderBy("_stretch")) - F.col("_n")).withColumnRenamed("_stretch", "_of").filter("_shift > 0"))
    inside = cut.withColumn("_r", F.row_number().over(W.partitionBy(*groups, "_stretch").orderBy("_h", key)))
    both = inside.join(shift, match(inside, shift, groups) & (F.col("_stretch") == F.col("_of")), "left")
    return both.withColumn(out, (F.col("_r") + F.coalesce("_shift", F.lit(0))).cast("int")).select(*[c for c in df.columns if c != out], out)


def folds(df: DataFrame, k: int, seed: int, key: str, label: str | None = None, group: str | None = None, out: str = "fold") -> DataFrame:
    """Fold numbers: by group (all its rows in one fold), else dealt in turn in a hashed order inside each label if every label has k rows, else inside buckets of the hash."""
    if group is not None:
        return df.withColumn(out, (split_hash(seed, group) % k).cast("int"))
    if label is not None:
        least = df.groupBy(label).count().agg(F.min("count")).first()[0]
        if least is not None and least >= k:
            return numbered(df, [label], seed, key, "_r").withColumn(out, ((F.col("_r") - 1) % k).cast("int")).drop("_r")
    return df.withColumn(out, (split_hash(seed, key) % k).cast("int"))


def within_group_split(df: DataFrame, group: str, key: str, seed: int, least: int = 10) -> DataFrame:
    """In each group of least rows at least: the first floor(0.8 n) in a hashed order are train, the others test."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).filter((F.col("_n") >= least) & (F.floor(0.8 * F.col("_n")) >= 2))
    ranked = numbered(df.join(sizes, group), [group], seed, key, "_r")
    return ranked.withColumn("split", F.when(F.col("_r") <= F.floor(0.8 * F.col("_n")), "train").otherwise("test")).drop("_r", "_n")


def cap(df: DataFrame, rows: int, seed: int, key: str) -> DataFrame:
    """The first rows in a hashed order: a sample of stated size."""
    return df.orderBy(split_hash(seed, key), key).limit(rows)


def capped_split(df: DataFrame, rows: int, seed: int, key: str) -> DataFrame:
    """A split of twice as many rows as wanted, each side capped at rows."""
    some = hash_split(cap(df, 2 * rows, seed, key), seed, key)
    order = W.partitionBy("split").orderBy(split_hash(seed, key), key)
    # Two splits of at most twice the cap.
    return some.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= rows).drop("_r")


def top_labels(df: DataFrame, label: str, k: int) -> DataFrame:
    """The k most frequent labels and their counts; of equal ones the first in order."""
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(k)


def keep_top_labels(df: DataFrame, label: str, k: int) -> DataFrame:
    """Rows of the k most frequent labels. k labels are broadcast."""
    return df.join(F.broadcast(top_labels(df, label, k).select(label)), label, "left_semi")


def keep_top_in_sets(df: DataFrame, labels: str, k: int) -> DataFrame:
    """Label sets cut to the k most frequent labels; rows without any go."""
    top = top_labels(df.select(F.explode(labels).alias("_l")), "_l", k).agg(F.collect_list("_l").alias("_top"))
    # One row of k labels.
    return df.crossJoin(F.broadcast(top)).withColumn(labels, F.array_intersect(labels, "_top")).filter(F.size(labels) > 0).drop("_top")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or an error that says what has no rows left."""
    if df.isEmpty():
        raise ValueError(f"no rows left: {what}")
    return df


def rows_or_error(df: DataFrame, units: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """df and the error rows of its units: none where df has rows, else a row for each unit that says what has none left, so that other units go on."""
    from rankloom.operators.warehouse import failure_rows

    failed = failure_rows(units, f"no rows left: {what}")
    return df, failed.limit(0) if not df.isEmpty() else failed


def group_limits(df: DataFrame, group: str, key: str, most: int | None = None, rows: int | None = None) -> DataFrame:
    """Groups larger than most go; of each other group at most the first rows by key stay."""
    if most is not None:
        df = df.join(df.groupBy(group).count().filter(F.col("count") <= most).select(group), group, "left_semi")
    if rows is not None:
        df = df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(key))).filter(F.col("_r") <= rows).drop("_r")
    return df


def missing_units(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Expected units that are not done."""
    return expected.join(done, keys, "left_anti")


def require_complete(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """done, or an error that names some units that are missing."""
    absent = missing_units(expected, done, keys).limit(10).collect()
    if absent:
        raise ValueError(f"units missing: {[tuple(r) for r in absent]}")
    return done


def require_disjoint(parts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """parts, or an error that names some units that lie in several of them."""
    shared = parts.groupBy(*keys).agg(F.countDistinct(part).alias("n")).filter("n > 1").limit(10).collect()
    if shared:
        raise ValueError(f"units in several parts: {[tuple(r)[:-1] for r in shared]}")
    return parts


def balanced_pairs(df: DataFrame, entity: str, label: str, key: str, seed: int, most: int = 2000) -> DataFrame:
    """Per entity as many positive as negative rows, at most half of most each, the first in a hashed order."""
    sizes = df.groupBy(entity).agg(F.least(F.count_if(F.col(label)), F.count_if(~F.col(label)), F.lit(most // 2)).alias("_k"))
    return numbered(df.join(sizes, entity), [entity, label], seed, key, "_r").filter(F.col("_r") <= F.col("_k")).drop("_r", "_k")
