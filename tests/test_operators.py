"""Operators on hand-built inputs with known answers."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import functions as fn
from rankloom import sources
from rankloom.operators import blocks, bootstrap, features, metrics, pairs, prepare, similarity, variants, warehouse
from rankloom.sources import versions
from rankloom.streaming import filter_corpus


def one(df):
    return df.first()[0]


def test_hits_are_filtered_by_identity_and_coverage(spark):
    rows = [("q7", "near", 0.62, 0.85, 0.90), ("q9", "near", 0.70, 0.81, 0.99), ("q7", "short", 0.88, 0.97, 0.35), ("q8", "far", 0.22, 0.95, 0.91), ("q9", "far", 0.22, 0.99, 0.99), ("q7", "none", 0.05, 0.10, 0.10)]
    hits = spark.createDataFrame(rows, "query_id string, target_id string, fident double, qcov double, tcov double")
    found = lambda i, c: {r.target_id: (r.query_id, r.fident) for r in similarity.strongest_per_target(hits, "fident", i, c).collect()}
    assert found(0.5, 0.8) == {"near": ("q9", 0.70)}
    # Of equally strong queries the first by id.
    assert found(0.2, 0.8) == {"near": ("q9", 0.70), "far": ("q8", 0.22)}
    assert set(found(0.5, 0.3)) == {"near", "short"} and found(0.9, 0.0) == {}


def test_fasta_round_trip_and_stop_list(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">seq-1 kind=x\nGATT\nACA\n\n>seq-2\nCCGG\n>seq-3 y\nT T\n")
    got = sources.read_fasta(spark, str(tmp_path / "a.fa"))
    assert sorted((r.id, r.seq) for r in got.collect()) == [("seq-1", "GATTACA"), ("seq-2", "CCGG"), ("seq-3", "TT")]
    sources.write_fasta(got.coalesce(1), str(tmp_path / "out"))
    assert sources.read_fasta(spark, str(tmp_path / "out")).count() == 3
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text((tmp_path / "a.fa").read_text())
    lists = [spark.createDataFrame([(x,) for x in ids], "id string") for ids in (["seq-2"], ["seq-2", "seq-3"])]
    stop = sources.stop_union(*lists)
    filter_corpus(spark, str(tmp_path / "in"), stop, str(tmp_path / "kept"), str(tmp_path / "ck")).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "kept")).collect()] == ["seq-1"]
    sources.write_stop_list(stop, str(tmp_path / "stop"))
    assert [r.value for r in spark.read.text(str(tmp_path / "stop")).collect()] == ["seq-2", "seq-3"]


def test_kmers_never_bridge_other_signs(spark):
    df = spark.createDataFrame([(1, "AAAA"), (2, "AAAAAAAAAA"), (3, "AXA"), (4, "")], "id int, seq string")
    got = {(r.id, r.kmer): r.freq for r in features.kmer_frequencies(df, "id", "seq", 2, fn.AMINO_ACIDS).collect()}
    assert got == {(1, "AA"): 1.0, (2, "AA"): 1.0}
    with pytest.raises(ValueError):
        fn.kmers(F.col("seq"), 0)
    with pytest.raises(ValueError):
        features.require_width(fn.AMINO_ACIDS, 6, 10_000)


def test_contacts_and_precision(spark):
    # Points on a circle of radius 10, one step of 30 degrees each; the chord of k steps is 20 sin(15 k degrees): 5.2, 10, 14.1 and so on.
    ring = [("p", k, 10 * float(np.cos(np.pi * k / 6)), 10 * float(np.sin(np.pi * k / 6)), 1.0, k != 7) for k in range(12)]
    df = spark.createDataFrame(ring, "protein string, pos int, x double, y double, z double, valid boolean")
    got = {(r.i, r.j) for r in pairs.contacts(df, 8.0).filter("contact").collect()}
    assert got == {(i, i + 1) for i in range(11) if 7 not in (i, i + 1)} | {(0, 11)}
    true = {(2, 29), (5, 20), (6, 20), (1, 9)}
    score = {(2, 29): 0.9, (3, 28): 0.8, (5, 20): 0.7, (6, 20): 0.6, (7, 21): 0.5, (1, 9): 0.1}
    rows = [("p", i, j, score.get((i, j), 0.0), (i, j) in true) for i in range(30) for j in range(i + 1, 30)]
    df = spark.createDataFrame(rows, "protein string, i int, j int, score double, contact boolean")
    lengths = spark.createDataFrame([("p", 10)], "protein string, length int")
    per = {(r.band, r.part): r.precision for r in pairs.precision_at(df, lengths, [5, 20]).collect()}
    # Ten over five gives two candidates, ten over twenty at least one.
    assert per[("long", 5)] == 0.5 and per[("long", 20)] == 1.0 and per[("medium", 5)] == 1.0 and per[("short", 20)] == 1.0
    assert pairs.precision_at(df.filter("j - i < 24"), lengths, [5]).filter("band = 'long'").count() == 0


def test_span_labels_and_decoding(spark):
    rows = [(4, [(1, 2, "disorder"), (4, 4, "DISORDER ")]), (5, [(2, 4, "disorder"), (3, 5, "disorder")]), (3, [(1, 3, "linker")]), (3, [(0, 1, "disorder"), (3, 40, "disorder")]), (0, [(1, 2, "disorder")])]
    df = spark.createDataFrame(rows, "n int, r array<struct<start:int,end:int,term:string>>")
    got = [r[0] for r in df.select(prepare.span_labels(F.col("n"), F.col("r"))).collect()]
    assert got == [[1, 1, 0, 1], [0, 1, 1, 1, 1], [0, 0, 0], [1, 0, 1], []]
    decode = lambda task, column, text: one(spark.createDataFrame([(text,)], "s string").select(prepare.decoded_labels(task, column, F.col("s"))))
    assert decode("SS3", "y", "CHE?") == [2, 0, 1, -1] and decode("any", "dssp8", "GC-B") == [0, 7, -1, 3]
    # The more special name wins: disorder before states.
    assert decode("Disorder of the SS3 set", "y", "['1.0', '0.0']") == [1, 0] and decode("x", "disorder_y", "01H1") == [0, 1, 1]
    assert decode("x", "y", "12, 7,") == [12, 7] and decode("x", "y", "a9b1") == [9, 1]


def test_mutations(spark):
    df = spark.createDataFrame([("ACDEFG", "D3A:F5Y")], "s string, m string")
    assert one(df.select(fn.apply_mutations(F.col("s"), fn.parse_mutations(F.col("m"))))) == "ACAEYG"
    assert one(df.select(fn.apply_mutations(F.col("s"), fn.parse_mutations(F.lit("C3A"))))) is None
    assert one(df.select(fn.shift_mutations(F.col("m"), 2))) == "D5A:F7Y"
    assert one(df.select(fn.parse_mutations(F.lit("WT")))) == []
    assert one(df.select(fn.differences(F.lit("AB"), F.lit("ABC")))) is None


def test_variant_scores_need_whole_profiles(spark):
    v = spark.createDataFrame([(1, "w", "AC", "AD"), (2, "w", "AC", "AE"), (3, "w", "AC", "AX"), (4, "w", "AC", "A")], "variant_id int, wt_id string, wt string, mut string")
    p = spark.createDataFrame([("w", 1, "C", -1.0), ("w", 1, "D", -3.0)], "wt_id string, pos int, symbol string, logp double")
    assert {r.variant_id: r.score for r in variants.variant_scores(v, p).collect()} == {1: -2.0, 2: None, 3: 0.0, 4: None}


def test_metrics_on_ties_and_partitions(spark):
    df = spark.createDataFrame([("g", 1, 0.5), ("g", 0, 0.5), ("g", 1, 0.9), ("g", 0, 0.1), ("h", 1, 1.0), ("h", 1, 2.0)], "g string, y int, s double")
    for n in (1, 7):
        got = {r.g: r.auc for r in metrics.auc(df.repartition(n), "y", "s", ["g"]).collect()}
        assert got == {"g": 0.875, "h": None}
    assert metrics.average_precision(df.filter("g = 'g'"), "y", "s", []).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    empty = metrics.class_metrics(metrics.confusion(df.limit(0), "y", "y")).first()
    assert empty.n is None


def test_diversity(spark):
    df = spark.createDataFrame([("same", [1.0, 0.0]), ("same", [1.0, 0.0]), ("anti", [1.0, 0.0]), ("anti", [-1.0, 0.0]), ("one", [1.0, 0.0])], "p string, v array<double>")
    got = {r.p: r.diversity for r in features.diversity(df, "p", "v").collect()}
    assert got == {"same": 0.0, "anti": 2.0, "one": 0.0}


def test_nearest_is_exact_over_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "id long, vector array<double>")
    whole = sorted((r.query_id, r.rank, r.target_id) for r in similarity.nearest(df, df, 3, "cosine", True).collect())
    cut = sorted((r.query_id, r.rank, r.target_id) for r in similarity.nearest(df, df, 3, "cosine", True, block=16).collect())
    assert len(whole) == 180 and [x[:2] for x in whole] == [x[:2] for x in cut]


def test_latest_rows_and_pending(spark):
    rows = [("t", "2026-08-01", 1, 0.71), ("t", "2026-08-21", 2, 0.75), ("u", "not a date", 3, 0.1), ("u", "2026-08-21", 4, 0.2)]
    df = spark.createDataFrame(rows, "task string, day string, n int, v double")
    assert {r.task: r.v for r in warehouse.latest(df, ["task"], "day", "n").collect()} == {"t": 0.75, "u": 0.1}
    done = spark.createDataFrame([("a", "fixed"), ("b", warehouse.FAILED)], "task string, EvalStrategy string")
    left = warehouse.pending(spark.createDataFrame([("a",), ("b",), ("c",)], "task string"), done, ["task"])
    assert sorted(r.task for r in left.collect()) == ["b", "c"]


def test_bootstrap_is_the_same_in_any_partitioning(spark):
    df = spark.range(50).withColumn("v", (F.col("id") % 5).cast("double"))
    a, b = (bootstrap.mean_interval(df.repartition(n), "id", "v", 50, 1).first() for n in (1, 5))
    assert (a.low, a.high) == pytest.approx((b.low, b.high)) and a.low < 2 < a.high


def test_average_precision_ranks_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 8))
    x[100:110] = x[:10]
    label = np.arange(150) % 2
    df = spark.createDataFrame([(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "id bigint, vector array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = []
    for i in range(150):
        order = [j for j in np.argsort(-np.round(unit @ unit[i], 12), kind="stable") if j != i]
        hit = label[order] == label[i]
        wanted.append((np.cumsum(hit) / np.arange(1, 150))[hit].mean())
    for block, most in ((2048, 1000), (40, 16)):
        rows = {r.query_id: r for r in similarity.average_precision(df, [1, 5], block, most).collect()}
        assert [rows[i].ap for i in range(150)] == pytest.approx(wanted)
        for i in range(150):
            order = [j for j in np.argsort(-np.round(unit @ unit[i], 12), kind="stable") if j != i]
            assert (rows[i].hit_1, rows[i].hit_5) == tuple(int((label[order[:k]] == label[i]).any()) for k in (1, 5))
        some = {r.query_id: r.ap for r in similarity.average_precision(df, [], block, most, F.col("id") % 20 == 0).collect()}
        assert sorted(some) == list(range(0, 150, 20)) and [some[i] for i in sorted(some)] == pytest.approx(wanted[::20])
    near = {r.query_id: r.ap for r in similarity.retrieval_per_query(similarity.nearest(df, df, 30, "cosine", True), df.select("id", "label"), [1]).collect()}
    assert max(near.values()) <= 30 / 74 < min(wanted)


def test_result_table_merges_and_recovers(spark, tmp_path, monkeypatch):
    rows = lambda m, v, n: spark.createDataFrame([(m, "t", "d", v, n)], "Model string, Task string, Date string, value double, n int")
    table, rescue, keys = str(tmp_path / "r"), str(tmp_path / "rec"), ["Model", "Task", "Date"]
    put = lambda df: sources.append_results(spark, df, table, rescue, keys, "n")
    read = lambda: sorted((r.Model, r.value) for r in sources.read_results(spark, table, keys, "n").collect())
    for n, (m, v) in enumerate((("m", 1.0), ("other", 5.0), ("m", 2.0))):
        assert put(rows(m, v, n)) == table
    assert read() == [("m", 2.0), ("other", 5.0)]
    # A new version's files are as many as its keys.
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "r" / "data").rglob("*.parquet"))
    before = size()
    put(spark.range(5000).selectExpr("concat('x', id) AS Model", "'t' AS Task", "'d' AS Date", "1.0D AS value", "10 AS n"))
    large = size() - before
    put(rows("m", 2.5, 11))
    assert size() - before - large < large / 10
    # A run that ends between its files and its manifest: nobody sees its rows, and the next run is not disturbed.
    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            put(rows("m", 99.0, 99))
    assert ("m", 2.5) in read()
    # Two writers: the second one's number is taken when it commits, so it takes the next with both writers' rows.
    own = versions._commit
    state = {"first": True}

    def beaten(*a):
        if state.pop("first", None):
            versions.add(spark, table, rows("first", 1.0, 12), keys, "n")
        own(*a)

    monkeypatch.setattr(versions, "_commit", beaten)
    number = versions.numbers(spark, table)[-1]
    assert put(rows("second", 2.0, 12)) == table and versions.numbers(spark, table)[-1] == number + 2
    assert {("first", 1.0), ("second", 2.0), ("m", 2.5)} <= set(read())
    with pytest.raises(versions.Conflict):
        own(spark, table, versions.manifest(spark, table))
    # Parts of many files are merged; old versions can be read until they expire.
    for k in range(10):
        put(rows("m", float(k), 20 + k))
    made = versions.manifest(spark, table)
    assert max(map(len, made["folders"].values())) <= versions.MOST and ("m", 9.0) in read()
    assert ("m", 2.5) in {(r.Model, r.value) for r in versions.read(spark, table, keys, "n", number).collect()}
    versions.expire(spark, table, 1)
    assert versions.numbers(spark, table) == [made["number"]] and ("m", 9.0) in read()
    # A damaged manifest: the new row is rescued, and nothing of the table changes.
    (tmp_path / "r" / "manifests" / f"{made['number']}.json").write_text("{")
    assert put(rows("m", 3.0, 50)) == rescue
    assert [r.value for r in spark.read.parquet(rescue).collect()] == [3.0]



def test_average_precision_hands_on_a_row_a_query_and_not_its_scores(spark):
    """Labels of any size (null, alone, small, over several slices), copies across labels; shuffled rows grow with the rows."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((240, 4))
    x[40:100] = x[0]
    label = [None if i % 31 == 0 else 900 + i if i % 29 == 0 else i % 3 if i % 2 else 10 + i // 20 for i in range(240)]
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, label, strict=True))], "id bigint, vector array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block, most in ((2048, 1 << 17), (16, 20)):
        out = similarity.average_precision(df, [1], block, most)
        got = {r.query_id: r for r in out.collect()}
        assert set(got) == {i for i in range(240) if label[i] is not None}
        for i in got:
            order = [j for j in np.argsort(-np.round(unit @ unit[i], 10), kind="stable") if j != i]
            hit = np.array([label[j] == label[i] for j in order])
            wanted = (np.cumsum(hit) / np.arange(1, 240))[hit].mean() if hit.any() else 0.0
            assert got[i].ap == pytest.approx(wanted) and got[i].eligible == bool(hit.any()) and got[i].hit_1 == int(hit[0])
        assert "array<bigint>" not in str(out._jdf.queryExecution().executedPlan()) and "FlatMapCoGroups" not in str(out._jdf.queryExecution().executedPlan())


def _ranked(queries: np.ndarray, slices: int, rows: dict, chunk: int = 256) -> dict:
    """What similarity._Ranked makes of all slices of the queries' label: query: (ap, rows ahead of the first of its label)."""
    at = {c: lambda i, c=c: rows[c][i] for c in rows}
    take = lambda i: {c: f(i) for c, f in at.items()}
    group = np.isin(rows["h"], rows["h"][queries])
    out = {}
    for s in range(slices):
        ranked = similarity._Ranked(take(queries))
        own = group & (rows["id"] % slices == s)
        for wanted, how in ((own, None), (group & ~own, similarity.SLICE), (~group, similarity.FAR)):
            i = np.flatnonzero(wanted)
            for k in range(0, len(i), chunk):
                ranked.own_rows(take(i[k : k + chunk])) if how is None else ranked.add(take(i[k : k + chunk]), how)
        for q, t, best in zip(*(c.to_pylist() for c in ranked.result().columns), strict=True):
            old = out.get(q, (0.0, None))
            out[q] = old[0] + t, min((b for b in (old[1], best) if b is not None), default=None)
    others = {q: int((rows["h"] == rows["h"][rows["id"] == q][0]).sum()) - 1 for q in out}
    return {q: (t / others[q], best) for q, (t, best) in out.items()}


def test_rows_find_their_places_among_keys_of_any_spread(monkeypatch):
    """copies across labels, many keys in a step, keys far away, vectors of length 0 or not finite, one and several slices, labels that share a group."""
    rng = np.random.default_rng(11)
    n = 1500
    x = rng.standard_normal((n, 6))
    x[200:500] = x[0] + rng.standard_normal((300, 6)) * 1e-4
    x[500:700] = x[1]
    x[700:760] = x[rng.integers(0, 200, 60)]
    x[760:765], x[765, 2], x[766, 1] = 0, np.nan, np.inf
    h, ids = rng.integers(0, 4, n), rng.permutation(n) * 3
    with np.errstate(all="ignore"):
        length = np.sqrt((x**2).sum(1))
        unit = np.where(np.isfinite(length)[:, None], x / np.where(length > 0, length, 1)[:, None], 0.0)
    rows = {"id": ids, "h": h, "vector": x}
    queries = np.concatenate([rng.choice(700, 40, replace=False), [701, 702, 760]])
    monkeypatch.setattr(similarity, "SCORES", 8 * len(queries) * 300)
    for looks, at_once, kinds, slices in ((4, 1 << 15, None, 1), (1, 64, None, 1), (4, 100, None, 3), (4, 1 << 15, 2, 1), (1, 64, 2, 2)):
        monkeypatch.setattr(similarity, "LOOKS", looks)
        monkeypatch.setattr(similarity, "AT_ONCE", at_once)
        got = {}
        for part in [h[queries] == c for c in range(4)] if kinds is None else [h[queries] < kinds, h[queries] >= kinds]:
            got |= _ranked(queries[part], slices, rows)
        for q in queries:
            down = np.rint(-(unit @ unit[q]) * 1e10)
            down[[765, 766]] = np.inf
            order = np.lexsort((ids, down))
            hit = h[order[order != q]] == h[q]
            assert got[ids[q]][0] == pytest.approx((np.cumsum(hit) / np.arange(1, n))[hit].mean(), rel=1e-9), (q, looks, slices)
            assert got[ids[q]][1] == np.flatnonzero(hit)[0]


def test_ranking_a_row_costs_little_more_than_sorting_it():
    """sorted and searched for among the queries' scores, rows took many times as long. In a process of one thread, as Spark's workers are."""
    code = """
import time, numpy as np
from test_operators import _ranked
rng, n = np.random.default_rng(12), 40_000
rows = {"id": np.arange(n), "h": rng.integers(0, 10, n), "vector": rng.standard_normal((n, 64))}
queries, took = np.flatnonzero(rows["h"] == 0)[:64], []
for _ in range(4):
    scores, began = rng.standard_normal((64, n)), time.process_time()
    scores.sort(axis=1)
    middle = time.process_time()
    _ranked(queries, 1, rows)
    took.append((middle - began, time.process_time() - middle))
print(min(t[1] for t in took) / min(t[0] for t in took))
"""
    env = os.environ | {"OMP_NUM_THREADS": "1", "PYTHONPATH": os.pathsep.join([os.path.dirname(__file__), *sys.path])}
    assert float(subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout) < 6


def _meeting(spark, monkeypatch, n: int, most: int) -> tuple:
    """What average_precision hands to blocks.met: blocks of queries, the gallery, and which of it a block reads as its own and besides."""
    seen, real = [], blocks.met

    def met(asked, gallery, group, run, schema, number, *more):
        seen.append((asked, gallery, group, more[0] if more else F.lit(True)))
        return real(asked, gallery, group, run, schema, number, *more)

    monkeypatch.setattr(blocks, "met", met)
    df = spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("vector"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).otherwise(F.col("id") % 30).alias("label"))
    assert similarity.average_precision(df, [1], 32, most).count() == n
    return seen[0]


def test_blocks_of_vectors_hold_the_bytes_of_their_type(spark, monkeypatch):
    """floats were packed as doubles, twice the bytes that each block of queries reads."""
    _, gallery, _, _ = _meeting(spark, monkeypatch, 600, 1 << 18)
    assert one(gallery.agg(F.sum(F.length("vector")))) == 600 * 8 * 4


def test_a_block_of_queries_reads_each_row_once(spark, monkeypatch):
    """rows of the queries' own slice were read and compared again with all others."""
    for most in (1 << 18, 70):
        asked, gallery, own, every = _meeting(spark, monkeypatch, 600, most)
        both = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns]).crossJoin(gallery.select(*[F.col(c).alias(f"g_{c}") for c in gallery.columns]))
        times = both.select((own.cast("int") + every.cast("int")).alias("n")).groupBy("n").count().collect()
        assert [r.n for r in times] == [1]


def test_rows_find_their_places_among_more_keys_than_two_bytes_number():
    """tables of up to 65,535 keys have numbers of two bytes, larger ones of four."""
    rng = np.random.default_rng(13)
    for n in (131_070, 131_074, 150_000):
        x, h, ids = rng.standard_normal((n, 4)), np.arange(n) % 2, rng.permutation(n)
        x[5::1000] = x[4]
        got = _ranked(np.array([4, 100]), 1, {"id": ids, "h": h, "vector": x})
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        for q in (4, 100):
            order = np.lexsort((ids, np.rint(-(unit @ unit[q]) * 1e10)))
            hit = h[order[order != q]] == h[q]
            assert got[ids[q]][0] == pytest.approx((np.cumsum(hit) / np.arange(1, n))[hit].mean(), rel=1e-9) and got[ids[q]][1] == np.flatnonzero(hit)[0]
