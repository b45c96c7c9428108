"""Queries of vector search, retrieval, label transfer and shared k-mers."""

from __future__ import annotations

from pyspark.ml.feature import NGram
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import features, pairs, similarity
from rankloom.plans.tables import rounded, spread, table, vectors


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("id", "label")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The vectors whose id is divisible by 20 as queries, all others as gallery."""
    v = vectors(spark, d)
    return v.filter("id % 20 = 0"), v.filter("id % 20 <> 0")


def cosine_retrieval_recall(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return rounded(similarity.recall_at(similarity.nearest(v, v, 30, "cosine", True), _labels(spark, d), [1, 10, 30]))


def _per_query(spark: SparkSession, d: str, ks: list[int]) -> DataFrame:
    """Hits among the first neighbours, and the average precision of the whole ranking."""
    return similarity.average_precision(vectors(spark, d), ks)


def retrieval_map(spark: SparkSession, d: str) -> DataFrame:
    return rounded(similarity.retrieval(_per_query(spark, d, [1, 10]), [1, 10]))


def retrieval_per_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_per_query(spark, d, [1, 10, 30]))


def retrieval_full_ap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(similarity.average_precision(vectors(spark, d)))


def _transfer_sides(spark: SparkSession, d: str) -> tuple:
    c, a, h = (F.col("label") % 2).cast("string"), (F.col("label") % 5).cast("string"), F.col("label").cast("string")
    lv = lambda df: df.select("id", "vector", c.alias("c"), F.concat_ws(".", c, a).alias("a"), F.concat_ws(".", c, a, h).alias("h"))
    q, g = (lv(x) for x in _sides(spark, d))
    return similarity.nearest(q, g, 1, "euclidean"), q, g, ["c", "a", "h"]


def transfer_judged(spark: SparkSession, d: str) -> DataFrame:
    return similarity.transfer_judged(*_transfer_sides(spark, d))


def nn_transfer_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(similarity.transfer_levels(*_transfer_sides(spark, d)))


def knn_vote(spark: SparkSession, d: str) -> DataFrame:
    q, g = _sides(spark, d)
    return similarity.knn_vote(similarity.nearest(q, g, 5, "euclidean"), g.select("id", "label"))


def knn_regression(spark: SparkSession, d: str) -> DataFrame:
    q, g = _sides(spark, d)
    return rounded(similarity.knn_mean(similarity.nearest(q, g, 5, "euclidean"), g.select("id", F.col("label").cast("double").alias("value"))))


def hard_triplets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(similarity.hard_triplets(vectors(spark, d), {"label": None}, F.col("id") % 20 == 0).drop("level"), 5)


def _shingled(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """id and kmers: the runs of n words of each text, made within the row."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    rows = spread(df.select(F.col(key).alias("id"), "text")).select("id", words.alias("w"))
    return NGram(n=n, inputCol="w", outputCol="kmers").transform(rows).select("id", "kmers")


def _text_hits(spark: SparkSession, d: str) -> DataFrame:
    return similarity.shared_kmer_hits(_shingled(table(spark, d, "benchmark"), "item_id"), _shingled(table(spark, d, "documents"), "doc_id"))


def shared_kmer_hits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_text_hits(spark, d))


def ranked_hits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(similarity.rank_hits(_text_hits(spark, d), "containment"))


def best_hit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(similarity.strongest_per_target(_text_hits(spark, d), "containment", 0.3, 0.0))


def decontaminate(spark: SparkSession, d: str) -> DataFrame:
    stop = similarity.strongest_per_target(_text_hits(spark, d), "containment", 0.3, 0.0).select(F.col("target_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(stop, "doc_id", "left_anti")


def contamination_report(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.strongest_per_target(_text_hits(spark, d), "containment", 0.3, 0.0)
    return rounded(similarity.contamination(found.withColumn("task", F.concat(F.lit("task"), F.col("query_id") % 3)), table(spark, d, "documents"), "task"))


def _hits_to_labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lab = table(spark, d, "labels")
    hits = _text_hits(spark, d).join(lab.select(F.col("doc_id").alias("target_id")), "target_id", "left_semi")
    return similarity.rank_hits(hits, "containment"), table(spark, d, "benchmark").select(F.col("item_id").alias("id")), lab


def hit_label_transfer(spark: SparkSession, d: str) -> DataFrame:
    hits, queries, lab = _hits_to_labelled(spark, d)
    return rounded(similarity.transfer_value(hits, queries, lab.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("value"))))


def hit_class_scores(spark: SparkSession, d: str) -> DataFrame:
    hits, queries, lab = _hits_to_labelled(spark, d)
    return rounded(similarity.class_scores(hits, queries, lab.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), "containment"))


def hit_coverage(spark: SparkSession, d: str) -> DataFrame:
    hits, queries, _ = _hits_to_labelled(spark, d)
    got = queries.join(hits.filter("rank = 1").select(F.col("query_id").alias("id"), "target_id"), "id", "left")
    return rounded(got.agg(F.count("*").alias("n"), F.avg(F.col("target_id").isNotNull().cast("double")).alias("coverage")))


def kmer_freq(spark: SparkSession, d: str) -> DataFrame:
    f = features.kmer_frequencies(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", 2, "ACDEFGHIKLMNPQRSTVWY")
    return rounded(f.groupBy("kmer").agg(F.count("*").alias("n_docs"), F.sum("freq").alias("total"), F.max("freq").alias("top")))


def _residues(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("protein"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))).alias("pos", "vec"))


def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    m = features.mean_vectors(_residues(spark, d), ["protein"], "vec")
    return rounded(m.select("protein", F.posexplode("mean").alias("i", "x")), 5)


def diversity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.diversity(_residues(spark, d), "protein", "vec"), 5)


def span_pool(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("pair_id"))
    p = ids.select("pair_id", F.col("pair_id").alias("protein_a"), F.lit(2).alias("start_a"), F.lit(5).alias("end_a"), F.col("pair_id").alias("protein_b"), F.lit(0).alias("start_b"), F.lit(0).alias("end_b"))
    return rounded(features.span_distance(_residues(spark, d), p, "euclidean"), 5)


def _positions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = pairs.dealt(table(spark, d, "events").select("user_id", "ts", "event_id", "value", "props", "event_type"), "user_id")
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("int")
    return e.select(F.col("user_id").alias("protein"), pos.alias("pos"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.hour("ts").cast("double").alias("z"), (F.col("event_type") != "error").alias("valid"))


def contacts(spark: SparkSession, d: str) -> DataFrame:
    c = pairs.contacts(_positions(spark, d), 8.0, 6)
    return rounded(c.groupBy("protein").agg(F.count("*").alias("n"), F.count_if("contact").alias("n_contacts"), F.avg("distance").alias("mean_distance")))


def near_contacts(spark: SparkSession, d: str) -> DataFrame:
    c = pairs.near_pairs(_positions(spark, d), 8.0, 6)
    return rounded(c.groupBy("protein").agg(F.count("*").alias("n"), F.sum("distance").alias("total"), F.max(F.col("j") - F.col("i")).alias("widest")), 4)


def precision_at_l(spark: SparkSession, d: str) -> DataFrame:
    p = _positions(spark, d)
    c = pairs.contacts(p, 8.0, 6).withColumn("score", F.round(100 * F.abs(F.sin(F.col("i") * 12.9 + F.col("j") * 78.2)), 3))
    lengths = p.groupBy("protein").agg(F.max("pos").alias("length"))
    per = pairs.precision_at(c, lengths, [1, 2, 5])
    return rounded(pairs.mean_or_zero(per, ["band", "part"], "precision"), 5)


def apc(spark: SparkSession, d: str) -> DataFrame:
    m = pairs.contacts(_positions(spark, d), 8.0, 6).select("protein", "i", "j", F.col("distance").alias("score"))
    return rounded(pairs.average_product_correction(m).groupBy("protein").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.avg("score").alias("mean")), 5)


QUERIES = {f.__name__: f for f in (cosine_retrieval_recall, retrieval_map, retrieval_per_query, retrieval_full_ap, nn_transfer_levels, knn_vote, knn_regression, hard_triplets, shared_kmer_hits, ranked_hits, best_hit, decontaminate, contamination_report, hit_label_transfer, hit_class_scores, hit_coverage, kmer_freq, mean_pool, diversity, span_pool, contacts, near_contacts, precision_at_l, apc)}

_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_COSINE = f"{_E}, n AS (SELECT a.id AS q, b.id AS t, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS r FROM e a JOIN e b ON a.id <> b.id QUALIFY r <= 30)"
_RANKED = f"{_E}, n AS (SELECT a.id AS q, b.id AS t, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS r FROM e a JOIN e b ON a.id <> b.id)"
_PER = f"""{_RANKED}, h AS (SELECT q, r, hit::INT AS h, sum(hit::INT) OVER (PARTITION BY q ORDER BY r) AS k FROM n), s AS (SELECT label, count(*) - 1 AS others FROM e GROUP BY 1),
p AS (SELECT id AS query_id, others > 0 AS eligible, max(CASE WHEN r <= 1 THEN h ELSE 0 END) AS hit_1, max(CASE WHEN r <= 10 THEN h ELSE 0 END) AS hit_10, max(CASE WHEN r <= 30 THEN h ELSE 0 END) AS hit_30, CASE WHEN others > 0 THEN coalesce(sum(CASE WHEN h = 1 THEN k / r END), 0) / others ELSE 0 END AS ap FROM e JOIN s USING (label) JOIN h ON q = id GROUP BY id, others)"""
_KNN = f"{_E}, n AS (SELECT a.id AS query_id, b.label, b.id AS t, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r FROM e a JOIN e b ON a.id % 20 = 0 AND b.id % 20 <> 0 QUALIFY r <= 5)"
_W = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"
_HITS = f"""bw AS (SELECT item_id AS id, {_W} AS w FROM benchmark), dw AS (SELECT doc_id AS id, {_W} AS w FROM documents),
b AS (SELECT DISTINCT id, array_to_string(w[i : i + 2], ' ') AS k FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM bw WHERE len(w) >= 3)),
c AS (SELECT DISTINCT id, array_to_string(w[i : i + 2], ' ') AS k FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM dw WHERE len(w) >= 3)),
nb AS (SELECT id, count(*) AS n FROM b GROUP BY 1), nc AS (SELECT id, count(*) AS n FROM c GROUP BY 1),
hits AS (SELECT query_id, target_id, shared, shared / nb.n AS qcov, shared / nc.n AS tcov, shared / least(nb.n, nc.n) AS containment FROM (SELECT b.id AS query_id, c.id AS target_id, count(*) AS shared FROM b JOIN c ON b.k = c.k GROUP BY 1, 2) JOIN nb ON nb.id = query_id JOIN nc ON nc.id = target_id)"""
_SHOWN = "query_id, target_id, shared, round(qcov, 6) AS qcov, round(tcov, 6) AS tcov, round(containment, 6) AS containment"
_BEST = f"{_HITS}, best AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY containment DESC, query_id) AS r FROM hits WHERE containment >= 0.3 QUALIFY r = 1)"
_LABELLED = f"{_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY containment DESC, target_id) AS r FROM hits WHERE target_id IN (SELECT doc_id FROM labels) QUALIFY r <= 300)"
_RES = "v AS (SELECT vec_id AS protein, unnest(range(8)) AS pos, embedding AS e FROM embeddings), x AS (SELECT protein, pos, unnest(range(8)) AS i, e FROM v), d AS (SELECT protein, pos, i::INT AS i, e[pos * 8 + i + 1]::DOUBLE AS x FROM x)"
_POS = "p AS (SELECT user_id AS protein, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS pos, value AS x, (props->>'$.k')::DOUBLE AS y, hour(ts)::DOUBLE AS z, event_type <> 'error' AS valid FROM events), c AS (SELECT a.protein, a.pos AS i, b.pos AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance FROM p a JOIN p b ON a.protein = b.protein AND b.pos >= a.pos + 6 WHERE a.valid AND b.valid)"

LEVELS_SQL = """l AS (SELECT id, unnest(['c', 'a', 'h']) AS level, unnest([(label % 2)::VARCHAR, (label % 2) || '.' || (label % 5), (label % 2) || '.' || (label % 5) || '.' || label]) AS lab, id % 20 = 0 AS q FROM e),
k AS (SELECT level, lab, count(*) AS n_all, count(*) FILTER (NOT q) AS n_look FROM l GROUP BY 1, 2)"""

SQL = {
    "cosine_retrieval_recall": f"WITH {_COSINE}, f AS (SELECT q, min(r) AS f FROM n WHERE hit GROUP BY q) SELECT count(*) AS n, round(avg(coalesce(f <= 1, false)::INT), 6) AS recall_1, round(avg(coalesce(f <= 10, false)::INT), 6) AS recall_10, round(avg(coalesce(f <= 30, false)::INT), 6) AS recall_30 FROM e LEFT JOIN f ON q = id",
    "retrieval_map": f"WITH {_PER} SELECT count(*) AS n, count(*) FILTER (eligible) AS n_eligible, round(avg(ap), 6) AS map, round(avg(ap) FILTER (eligible), 6) AS map_eligible, round(avg(hit_1), 6) AS recall_1, round(avg(hit_1) FILTER (eligible), 6) AS recall_1_eligible, round(avg(hit_10), 6) AS recall_10, round(avg(hit_10) FILTER (eligible), 6) AS recall_10_eligible FROM p",
    "retrieval_per_query": f"WITH {_PER} SELECT query_id, eligible, hit_1, hit_10, hit_30, round(ap, 6) AS ap FROM p",
    "retrieval_full_ap": f"WITH {_E}, n AS (SELECT a.id AS q, (a.label = b.label)::INT AS h, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS r FROM e a JOIN e b ON a.id <> b.id), k AS (SELECT q, r, h, sum(h) OVER (PARTITION BY q ORDER BY r) AS k FROM n), s AS (SELECT label, count(*) - 1 AS others FROM e GROUP BY 1) SELECT id AS query_id, others > 0 AS eligible, round(CASE WHEN others > 0 THEN coalesce(sum(CASE WHEN h = 1 THEN k / r END), 0) / others ELSE 0 END, 6) AS ap FROM e JOIN s USING (label) JOIN k ON q = id GROUP BY id, others",
    "nn_transfer_levels": f"""WITH {_KNN}, {LEVELS_SQL} SELECT a.level, count(*) FILTER (n_all > 1) AS n_answerable, count(*) FILTER (n_look > 0) AS n_strict, round(coalesce(avg((a.lab = b.lab)::INT) FILTER (n_all > 1), 0), 6) AS accuracy FROM l a JOIN n ON n.query_id = a.id AND r = 1 JOIN l b ON b.id = n.t AND b.level = a.level JOIN k ON k.level = a.level AND k.lab = a.lab WHERE a.q GROUP BY 1""",
    "knn_vote": f"WITH {_KNN}, c AS (SELECT query_id, label, count(*) AS k FROM n GROUP BY 1, 2) SELECT query_id, label AS predicted FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC, label) = 1",
    "knn_regression": f"WITH {_KNN} SELECT query_id, round(avg(label), 6) AS predicted FROM n GROUP BY 1",
    "hard_triplets": f"""WITH {_E}, d AS (SELECT a.id AS anchor, b.id AS o, a.label = b.label AS same, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.id % 20 = 0 AND a.id <> b.id),
p AS (SELECT anchor, o, d FROM d WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY d DESC, o) = 1), n AS (SELECT anchor, o, d FROM d WHERE NOT same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY d, o) = 1)
SELECT anchor, p.o AS positive, n.o AS negative, round(p.d, 5) AS d_positive, round(n.d, 5) AS d_negative FROM p JOIN n USING (anchor)""",
    "shared_kmer_hits": f"WITH {_HITS} SELECT {_SHOWN} FROM hits",
    "ranked_hits": f"WITH {_HITS} SELECT {_SHOWN}, row_number() OVER (PARTITION BY query_id ORDER BY hits.containment DESC, target_id)::INT AS rank FROM hits QUALIFY rank <= 300",
    "best_hit": f"WITH {_BEST} SELECT {_SHOWN} FROM best",
    "decontaminate": f"WITH {_BEST} SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT target_id FROM best)",
    "contamination_report": f"WITH {_BEST}, t AS (SELECT 'task' || (query_id % 3) AS task, target_id FROM best) SELECT task, count(DISTINCT target_id) AS n_leaking, round(count(DISTINCT target_id) * 100.0 / (SELECT count(*) FROM documents), 6) AS percent FROM t GROUP BY GROUPING SETS ((task), ())",
    "hit_label_transfer": f"WITH {_LABELLED}, m AS (SELECT avg(quality) AS m FROM labels) SELECT item_id AS query_id, round(coalesce(quality, m), 6) AS predicted, quality IS NOT NULL AS covered FROM benchmark LEFT JOIN (SELECT query_id, quality FROM k JOIN labels ON doc_id = target_id WHERE r = 1) ON query_id = item_id, m",
    "hit_class_scores": f"WITH {_LABELLED}, s AS (SELECT query_id, quality, max(containment) AS s FROM k JOIN labels ON doc_id = target_id GROUP BY 1, 2), o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, quality) = 1) SELECT item_id AS query_id, coalesce(quality, (SELECT min(quality) FROM labels)) AS predicted, round(coalesce(s, 0), 6) AS best FROM benchmark LEFT JOIN o ON query_id = item_id",
    "hit_coverage": f"WITH {_LABELLED} SELECT count(*) AS n, round(avg((target_id IS NOT NULL)::INT), 6) AS coverage FROM benchmark LEFT JOIN (SELECT * FROM k WHERE r = 1) ON query_id = item_id",
    "kmer_freq": "WITH r AS (SELECT doc_id, unnest(regexp_split_to_array(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACDEFGHIKLMNPQRSTVWY]')) AS s FROM documents), k AS (SELECT doc_id, s[i : i + 1] AS kmer FROM (SELECT doc_id, s, unnest(range(1, length(s))) AS i FROM r WHERE length(s) >= 2)), c AS (SELECT doc_id, kmer, count(*) AS n FROM k GROUP BY 1, 2), f AS (SELECT kmer, n / sum(n) OVER (PARTITION BY doc_id) AS freq FROM c) SELECT kmer, count(*) AS n_docs, round(sum(freq), 6) AS total, round(max(freq), 6) AS top FROM f GROUP BY 1",
    "mean_pool": f"WITH {_RES} SELECT protein, i, round(avg(x), 5) AS x FROM d GROUP BY 1, 2",
    "diversity": f"WITH {_RES}, u AS (SELECT protein, i, x / sqrt(sum(x * x) OVER (PARTITION BY protein, pos)) AS x FROM d), s AS (SELECT protein, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM u GROUP BY protein, i) SELECT protein, max(n) AS n, round(1 - (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)), 5) AS diversity FROM s GROUP BY 1",
    "span_pool": f"WITH {_RES}, m AS (SELECT protein, avg(x) FILTER (pos >= 2 AND pos < 5) AS a, avg(x) AS b FROM d GROUP BY protein, i) SELECT protein AS pair_id, round(sqrt(sum((a - b) * (a - b))), 5) AS distance FROM m GROUP BY 1",
    "contacts": f"WITH {_POS} SELECT protein, count(*) AS n, count(*) FILTER (distance < 8) AS n_contacts, round(avg(distance), 6) AS mean_distance FROM c GROUP BY 1",
    "near_contacts": f"WITH {_POS} SELECT protein, count(*) AS n, round(sum(distance), 4) AS total, max(j - i)::INT AS widest FROM c WHERE distance < 8 GROUP BY 1",
    "precision_at_l": f"""WITH {_POS}, b AS (SELECT protein, i, j, distance < 8 AS contact, CASE WHEN j - i < 12 THEN 'short' WHEN j - i < 24 THEN 'medium' ELSE 'long' END AS band, round(100 * abs(sin(i * 12.9::DOUBLE + j * 78.2::DOUBLE)), 3) AS score FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY protein, band ORDER BY score DESC, i, j) AS r FROM b), l AS (SELECT protein, max(pos) AS length FROM p GROUP BY 1),
t AS (SELECT k.protein, band, part, avg(contact::INT) AS v FROM k JOIN l USING (protein), (SELECT unnest([1, 2, 5]) AS part) WHERE r <= greatest(1, length // part) GROUP BY 1, 2, 3) SELECT band, part, round(avg(v), 5) AS precision FROM t GROUP BY 1, 2""",
    "apc": f"WITH {_POS}, a AS (SELECT protein, distance - sum(distance) OVER (PARTITION BY protein, i) * sum(distance) OVER (PARTITION BY protein, j) / sum(distance) OVER (PARTITION BY protein) AS s FROM c) SELECT protein, count(*) AS n, round(max(s), 5) AS top, round(avg(s), 5) AS mean FROM a GROUP BY 1",
}
