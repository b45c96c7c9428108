"""Queries of sources, labels, splits and of what jobs leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import functions as fn
from rankloom import sources
from rankloom.operators import audit, prepare, warehouse
from rankloom.plans.tables import results, rounded, table, vectors



def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def one_assay(spark: SparkSession, d: str) -> DataFrame:
    return sources.read_variants(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], "l_suppkey", 7)


def task_families(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.task_families(table(spark, d, "region"), table(spark, d, "customer"), "r_name", "c_mktsegment", "variants")


def task_registry(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "events").select(F.col("event_type").alias("key")).distinct()
    kind = F.when(F.length("key") > 5, "regression").otherwise("binary")
    return warehouse.registry(tasks.withColumn("type", kind), {"regression": "Spearman", "binary": "AUC"}, {"fast": F.length("key") <= 6, "full": F.lit(True)})


def label_parse(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", F.array(F.lpad(F.col("p_size").cast("string"), 4, "0"), F.lit("x")).alias("sizes"), F.col("p_retailprice").cast("string").alias("price"), F.regexp_replace("p_type", " ", " , ").alias("kinds"))
    p = p.select(prepare.parsed_label(p, "sizes", "multiclass").alias("label"), prepare.parsed_label(p, "price", "regression").alias("value"), prepare.mapped(F.col("p_brand"), {"Brand#11": "first", "Brand#23": "second"}).alias("brand"), F.size(prepare.label_list(F.col("kinds"))).alias("n_kinds"), F.length(prepare.without_spaces(F.col("kinds"))).alias("signs"))
    return rounded(p.groupBy("label").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.count_if(F.col("brand").isin("first", "second")).alias("n_mapped"), F.sum("n_kinds").alias("n_kinds"), F.sum("signs").alias("signs")), 2)


def residue_decode(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name, total = F.upper("p_name"), lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    rows = p.select(
        "p_brand",
        total(prepare.decoded_labels("SS8 states", "label", name)).alias("eight"),
        total(prepare.decoded_labels("Secondary Structure 3", "label", name)).alias("three"),
        total(prepare.decoded_labels("Disorder (SS3 mask)", "label", F.concat(F.lit("['"), (F.col("p_size") % 2).cast("string"), F.lit(".0', '1.0']")))).alias("listed"),
        total(prepare.decoded_labels("Disorder", "label", F.concat(F.col("p_size").cast("string"), F.lit("x1")))).alias("bits"),
        total(prepare.decoded_labels("other", "label", F.concat_ws(",", "p_size", "p_partkey", F.lit(" 3 ")))).alias("csv"),
        total(prepare.decoded_labels("other", "label", F.concat(F.lit("a"), F.col("p_partkey").cast("string")))).alias("digits"),
    )
    names = ("eight", "three", "listed", "bits", "csv", "digits")
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names])


def span_qa(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    start = (key % 10 + 1).cast("int")
    region = lambda a, b, term: F.struct(a.alias("start"), b.alias("end"), term.alias("term"))
    regions = F.array(region(start, start + 5, F.when(key % 3 != 0, " Disorder ").otherwise("binding")), region(F.lit(20), F.lit(99), F.when(key % 2 == 0, "disorder").otherwise("x")))
    rows = table(spark, d, "orders").select("o_orderpriority", prepare.span_labels((F.col("o_custkey") % 40).cast("int"), regions).alias("labels"), ((key % 100) / 100).alias("declared"))
    differs = prepare.span_content_differs(F.col("labels"), F.col("declared"))
    return rows.withColumn("differs", differs).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.aggregate("labels", F.lit(0), lambda a, x: a + x)).alias("n_labelled"), F.count_if(F.col("differs").isNull()).alias("n_empty"), F.count_if("differs").alias("n_differ"))


def digit_trim(spark: SparkSession, d: str) -> DataFrame:
    s, x = prepare.trimmed_pair(F.col("c_mktsegment"), prepare.digit_scores(F.col("c_name")))
    rows = table(spark, d, "customer").select("c_mktsegment", s.alias("s"), x.alias("x"))
    return rows.groupBy("c_mktsegment").agg(F.sum(F.length("s")).alias("signs"), F.sum(F.aggregate("x", F.lit(0), lambda a, v: a + v)).alias("total"))


def prefix_levels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    labels = prepare.prefix_labels("n_regionkey", "n_nationkey", "c_mktsegment")
    return c.select(F.explode(F.array(*labels)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def routed_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("value", _k().alias("k"))
    routed = prepare.routed_score(F.when(F.col("k") % 3 != 0, F.col("value")), F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise("n/a"), F.when(F.col("k") % 5 == 0, " TEST").otherwise("some"))
    return rounded(e.select(routed.alias("x")).filter("x is not null").groupBy("x.split").agg(F.count("*").alias("n"), F.sum("x.score").alias("total")), 2)


def clean_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("org name/model:"), F.col("user_id") % 5).alias("model"), _k().alias("k"), "event_type")
    samples = F.when(F.col("k") % 5 == 0, None).when(F.col("k") % 5 == 1, "").when(F.col("k") % 5 == 2, "Full").when(F.col("k") % 5 == 3, "100.0").otherwise(F.col("k").cast("string"))
    rows = e.select(fn.safe_name(F.col("model")).alias("safe"), fn.short_name(F.col("model")).alias("short"), fn.sample_key(samples).alias("samples"), fn.clean_sequence(F.when(F.length("event_type") > 5, F.concat("event_type", F.lit(" 1"))).otherwise("")).alias("sequence"))
    return rows.groupBy("safe", "short", "samples", "sequence").agg(F.count("*").alias("n"))


def probe_routing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", _k().alias("k"), "user_id")
    kind = F.when(F.col("k") % 4 == 0, "multilabel").when(F.col("k") % 4 == 1, "retrieval").when(F.col("k") % 4 == 2, "binary").otherwise("token_classification")
    requested = F.when(F.col("user_id") % 3 == 0, "auto").when(F.col("user_id") % 3 == 1, "knn").otherwise("linear")
    mode = F.when(F.col("k") % 10 == 2, "zeroshot").otherwise("holdout")
    probe = prepare.routed_probe(kind, mode, requested, ["click"], F.col("event_type"))
    name = prepare.probe_name(probe, F.col("k") % 3 == 0, F.when(F.col("k") % 2 == 0, "distance").otherwise("uniform"))
    return e.select(kind.alias("kind"), mode.alias("mode"), requested.alias("requested"), "event_type", probe.alias("probe"), name.alias("name")).groupBy("kind", "mode", "requested", "event_type", "probe", "name").agg(F.count("*").alias("n"))


def split_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("value", F.when(_k() % 4 == 0, " Train").when(_k() % 4 == 1, "VALID").when(_k() % 4 == 2, "held_Test_a").otherwise("other").alias("s"))
    rows, needs_folds = prepare.staged(e, "s", {"train": "train", "validation": "validation", "test": "test"})
    return rounded(rows.groupBy("stage").agg(F.count("*").alias("n"), F.sum("value").alias("total")).withColumn("needs_folds", F.lit(needs_folds)), 2)


def bucket_split(spark: SparkSession, d: str) -> DataFrame:
    return prepare.bucket_split(table(spark, d, "customer"), "c_custkey").groupBy("split").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


def entity_holdout(spark: SparkSession, d: str) -> DataFrame:
    return prepare.hold_out_last(table(spark, d, "events"), "user_id").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.max("user_id").alias("last"))


def capped_split(spark: SparkSession, d: str) -> DataFrame:
    return prepare.capped_split(table(spark, d, "orders"), 200, 42, "o_orderkey").groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def answerable_split(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("id", "label")
    return prepare.answerable(v.filter("id % 20 = 0"), v.filter("id % 20 <> 0"), "label").select("id", "label")


def topk_label_sets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.array("lang", "source").alias("labels"))
    kept = prepare.require_rows(prepare.keep_top_in_sets(docs, "labels", 4), "documents with a frequent label")
    return kept.select("doc_id", F.array_join(F.array_sort("labels"), ",").alias("labels"))


def score_join_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.joined_counting(table(spark, d, "events").withColumnRenamed("user_id", "c_custkey").filter("value is not null"), table(spark, d, "customer").filter("c_nationkey < 20").select("c_custkey", "c_name"), "c_custkey")[1]


def labelled_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = prepare.hash_split(table(spark, d, "documents").select("doc_id", "n_chars"), 42, "doc_id")
    joined = docs.join(table(spark, d, "labels"), "doc_id", "left")
    return rounded(audit.dataset_statistics(joined, "split", "quality", F.col("quality") == 1, "n_chars"))


def skipped_units(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return audit.skipped_report(*audit.skipped(docs, "doc_id", {"too long": F.col("n_chars") > 5000, "unscorable": F.coalesce(F.col("lang"), F.lit("fr")) == "fr"}))


def group_limits(spark: SparkSession, d: str) -> DataFrame:
    return prepare.group_limits(table(spark, d, "orders"), "o_custkey", "o_orderkey", 15, 5).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def cropped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.crop(F.col("p_name"), 9, True).alias("cut"), fn.crop(F.col("p_name"), 9, False).alias("whole"))


def failed_units(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).withColumn("EvalStrategy", F.lit("fixed"))
    units = warehouse.sweep(r.select("model", "task").distinct(), [1, 2, 3])
    failed = warehouse.failure_rows(units.filter("seed = 2"), "out of memory")
    done = units.filter("seed = 1").withColumns({"Error": F.lit(None).cast("string"), "EvalStrategy": F.lit("fixed")}).unionByName(failed)
    return warehouse.pending(units, done, ["model", "task", "seed"]).join(failed.select("model", "task", "seed", "Error"), ["model", "task", "seed"], "left")


def standardised_values(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), "l_quantity")
    s = l.groupBy("grp").agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    z = l.join(s, "grp").withColumn("z", fn.standardised(F.col("l_quantity"), F.col("m"), F.col("s")))
    return rounded(z.groupBy("grp").agg(F.max("z").alias("top"), F.avg(F.col("z") * F.col("z")).alias("spread")), 5)


QUERIES = {f.__name__: f for f in (one_assay, task_families, task_registry, label_parse, residue_decode, span_qa, digit_trim, prefix_levels, routed_scores, clean_names, probe_routing, split_lookup, bucket_split, entity_holdout, capped_split, answerable_split, topk_label_sets, score_join_counts, labelled_statistics, skipped_units, group_limits, cropped, failed_units, standardised_values)}

_KS = "(props->>'$.k')::INT"
_HASH = "(('0x' || substr(md5('42|' || {}), 1, 8))::BIGINT)"
_SUM = "list_sum(list_transform({}, lambda c: {}))"
SQL = {
    "one_assay": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey = 7",
    "task_families": r"SELECT 'variants_' || lower(regexp_replace(r_name, '\s+', '_', 'g')) || '_' || lower(regexp_replace(c_mktsegment, '\s+', '_', 'g')) AS key, r_name, c_mktsegment FROM (SELECT DISTINCT r_name FROM region), (SELECT DISTINCT c_mktsegment FROM customer)",
    "task_registry": "WITH t AS (SELECT DISTINCT event_type AS key, CASE WHEN length(event_type) > 5 THEN 'regression' ELSE 'binary' END AS type FROM events), m AS (SELECT key, upper(key[1]) || lower(key[2:]) AS name, type, CASE type WHEN 'regression' THEN 'Spearman' ELSE 'AUC' END AS metric FROM t) SELECT m.*, preset FROM m, (VALUES ('fast'), ('full')) AS p(preset) WHERE preset = 'full' OR length(key) <= 6",
    "label_parse": r"WITH p AS (SELECT p_size::VARCHAR AS label, p_retailprice AS value, p_brand IN ('Brand#11', 'Brand#23') AS m, len(list_filter(regexp_split_to_array(p_type, '[ ,]+'), lambda x: x <> '')) AS k, length(regexp_replace(replace(p_type, ' ', ' , '), '\s+', '', 'g')) AS s FROM part) SELECT label, count(*) AS n, round(sum(value), 2) AS value, count(*) FILTER (m) AS n_mapped, sum(k)::BIGINT AS n_kinds, sum(s)::BIGINT AS signs FROM p GROUP BY 1",
    "residue_decode": f"""WITH p AS (SELECT p_brand, {_SUM.format("string_split(upper(p_name), '')", "instr('GHIBESTC', c) - 1")} AS e, {_SUM.format("string_split(upper(p_name), '')", "instr('HEC', c) - 1")} AS t, p_size % 2 + 1 AS l,
1 + len(regexp_extract_all(p_size::VARCHAR, '1')) AS b, p_size + p_partkey + 3 AS c, {_SUM.format("string_split(p_partkey::VARCHAR, '')", "c::INT")} AS g FROM part)
SELECT p_brand, count(*) AS n, sum(e)::BIGINT AS eight, sum(t)::BIGINT AS three, sum(l)::BIGINT AS listed, sum(b)::BIGINT AS bits, sum(c)::BIGINT AS csv, sum(g)::BIGINT AS digits FROM p GROUP BY 1""",
    "span_qa": "WITH o AS (SELECT o_orderpriority, o_orderkey AS k, (o_custkey % 40)::INT AS n FROM orders), s AS (SELECT *, coalesce(list_sum(list_transform(range(1, n + 1), lambda p: ((k % 3 <> 0 AND p BETWEEN k % 10 + 1 AND k % 10 + 6) OR (k % 2 = 0 AND p BETWEEN 20 AND 99))::INT)), 0) AS x FROM o) SELECT o_orderpriority, count(*) AS n, sum(x)::BIGINT AS n_labelled, count(*) FILTER (n = 0) AS n_empty, count(*) FILTER (n > 0 AND abs(x / n - (k % 100) / 100) > 1e-3) AS n_differ FROM s GROUP BY 1",
    "digit_trim": f"""WITH c AS (SELECT c_mktsegment, least(length(c_mktsegment), len(regexp_extract_all(c_name, '[0-9]'))) AS n, regexp_extract_all(c_name, '[0-9]') AS x FROM customer) SELECT c_mktsegment, sum(n)::BIGINT AS signs, sum({_SUM.format("x[1 : n]", "c::INT")})::BIGINT AS total FROM c GROUP BY 1""",
    "prefix_levels": "WITH c AS (SELECT n_regionkey::VARCHAR AS a, n_nationkey::VARCHAR AS b, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT label, count(*) AS n FROM (SELECT unnest([a, a || '.' || b, a || '.' || b || '.' || s]) AS label FROM c) GROUP BY 1",
    "routed_scores": f"WITH e AS (SELECT value, {_KS} AS k FROM events), s AS (SELECT CASE WHEN k % 5 = 0 THEN 'test' ELSE 'train' END AS split, coalesce(CASE WHEN k % 3 <> 0 THEN value END, CASE WHEN k % 2 = 0 THEN k END) AS score FROM e) SELECT split, count(*) AS n, round(sum(score), 2) AS total FROM s WHERE score IS NOT NULL GROUP BY 1",
    "clean_names": f"WITH e AS (SELECT user_id % 5 AS u, {_KS} AS k, event_type AS t FROM events) SELECT 'org_name_model_' || u AS safe, 'model:' || u AS short, CASE WHEN k % 5 < 3 THEN 'Full' WHEN k % 5 = 3 THEN '100' ELSE k::VARCHAR END AS samples, CASE WHEN length(t) > 5 THEN regexp_replace(upper(t), '[^A-Z]', 'X', 'g') || 'XX' ELSE 'X' END AS sequence, count(*) AS n FROM e GROUP BY ALL",
    "probe_routing": f"""WITH e AS (SELECT event_type, {_KS} AS k, CASE user_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'knn' ELSE 'linear' END AS requested FROM events), m AS (SELECT *, CASE k % 4 WHEN 0 THEN 'multilabel' WHEN 1 THEN 'retrieval' WHEN 2 THEN 'binary' ELSE 'token_classification' END AS kind, CASE WHEN k % 10 = 2 THEN 'zeroshot' ELSE 'holdout' END AS mode FROM e),
a AS (SELECT *, CASE WHEN requested <> 'auto' THEN requested WHEN kind IN ('multilabel', 'token_classification') OR event_type = 'click' THEN 'torch_linear' ELSE 'linear' END AS p FROM m), r AS (SELECT *, CASE WHEN kind = 'retrieval' OR mode = 'zeroshot' OR kind = 'multilabel' AND p NOT IN ('linear', 'torch_linear') THEN 'linear' ELSE p END AS probe FROM a)
SELECT kind, mode, requested, event_type, probe, CASE WHEN probe <> 'knn' THEN probe ELSE probe || CASE WHEN k % 3 = 0 THEN '_l2' ELSE '' END || CASE WHEN k % 2 = 0 THEN '_dist' ELSE '' END END AS name, count(*) AS n FROM r GROUP BY ALL""",
    "split_lookup": f"WITH e AS (SELECT value, {_KS} AS k FROM events) SELECT ['train', 'validation', 'test'][k % 4 + 1] AS stage, count(*) AS n, round(sum(value), 2) AS total, false AS needs_folds FROM e WHERE k % 4 < 3 GROUP BY 1",
    "bucket_split": "WITH c AS (SELECT c_custkey, ('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT % 10 AS b FROM customer) SELECT CASE b WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM c GROUP BY 1",
    "entity_holdout": "WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)) SELECT CASE WHEN r < n * 8 // 10 THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT user_id) AS n_users, max(user_id) AS last FROM events JOIN u USING (user_id) GROUP BY 1",
    "capped_split": f"WITH h AS (SELECT o_orderkey, {_HASH.format('o_orderkey')} AS h FROM orders), c AS (SELECT *, CASE WHEN h % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM (FROM h ORDER BY h, o_orderkey LIMIT 400)), r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY split ORDER BY h, o_orderkey) <= 200) SELECT split, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM r GROUP BY 1",
    "answerable_split": "SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 20 = 0 AND label IN (SELECT label FROM embeddings WHERE vec_id % 20 <> 0)",
    "topk_label_sets": "WITH l AS (SELECT doc_id, unnest([lang, source]) AS label FROM documents), t AS (SELECT label FROM l WHERE label IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 4) SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM l SEMI JOIN t USING (label) GROUP BY 1",
    "score_join_counts": "SELECT count(*) AS n_rows, count(c_custkey) AS n_joined, count(*) - count(c_custkey) AS n_missing FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) ON user_id = c_custkey WHERE value IS NOT NULL",
    "labelled_statistics": f"WITH d AS (SELECT doc_id, n_chars, CASE WHEN {_HASH.format('doc_id')} % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents) SELECT split, count(quality) AS n_rows, count(*) - count(quality) AS n_dropped, count(DISTINCT quality) AS n_labels, round(avg((quality = 1)::INT), 6) AS positive, sum(n_chars) FILTER (quality IS NOT NULL)::BIGINT AS total_size FROM d LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "skipped_units": "SELECT CASE WHEN n_chars > 5000 THEN 'too long' WHEN coalesce(lang, 'fr') = 'fr' THEN 'unscorable' END AS reason, count(*) AS n FROM documents GROUP BY 1",
    "group_limits": "SELECT o_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) <= 15) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5) GROUP BY 1",
    "cropped": "SELECT p_partkey, CASE WHEN length(p_name) <= 9 THEN p_name ELSE substr(p_name, (length(p_name) - 9) // 2 + 1, 9) END AS cut, CASE WHEN length(p_name) <= 9 THEN p_name END AS whole FROM part",
    "failed_units": "WITH r AS (SELECT DISTINCT 'org/model-' || (user_id % 5) AS model, event_type AS task FROM events) SELECT model, task, seed, CASE WHEN seed = 2 THEN 'out of memory' END AS \"Error\" FROM r, (VALUES (2), (3)) AS s(seed)",
    "standardised_values": "WITH z AS (SELECT l_suppkey AS grp, (l_quantity - avg(l_quantity) OVER g) / (stddev_pop(l_quantity) OVER g + 1e-10) AS z FROM lineitem WINDOW g AS (PARTITION BY l_suppkey)) SELECT grp, round(max(z), 5) AS top, round(avg(z * z), 5) AS spread FROM z GROUP BY 1",
}
