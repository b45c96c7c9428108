"""Sources, streams, probes and gates on hand-built inputs."""

import json
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import functions as fn
from rankloom import sources
from rankloom.operators import audit, features, metrics, prepare, probes, similarity, variants, warehouse
from rankloom.sources import versions
from rankloom.streaming import collect_results, latest_version


def test_text_sources(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("# made by hand\nd1 1 10 8 10 x\nd2  2 20\n\nd3 3 30 7 1\n")
    got = sources.read_label_list(spark, str(tmp_path / "labels.txt")).collect()
    assert [r.fields[0] for r in got] == ["d1", "d3"]
    (tmp_path / "hits.tsv").write_text("a\tb\t0.5\t0.9\t0.8\t1e-9\na\tc\t0.5\nb\tc\tx\t0.9\t0.8\t1\n")
    assert [(r.test_id, r.corpus_id, r.evalue) for r in sources.read_hits(spark, str(tmp_path / "hits.tsv")).collect()] == [("a", "b", 1e-9)]
    (tmp_path / "rec.jsonl").write_text(json.dumps({"task": "a", "v": 1.5}) + "\nnot json\n" + json.dumps({"task": "b", "v": 2.5}) + "\n")
    assert sorted(r.task for r in sources.read_records(spark, str(tmp_path / "rec.jsonl"), "task string, v double").collect()) == ["a", "b"]
    sources.append_records(spark.createDataFrame([("c", 1.0)], "task string, v double"), str(tmp_path / "out"))
    sources.append_records(spark.createDataFrame([("d", 2.0)], "task string, v double"), str(tmp_path / "out"))
    assert sources.read_records(spark, str(tmp_path / "out"), "task string, v double").count() == 2
    (tmp_path / "scores").mkdir()
    (tmp_path / "scores" / "x.json").write_text(json.dumps([1.0, 3.0, "n/a", 950.0, None, "NaN"]))
    r = sources.read_score_files(spark, str(tmp_path / "scores")).first()
    assert (r.file, r.n, r.n_scored, r["mean"], r.sd) == ("x.json", 6, 2, 2.0, 1.0)
    (tmp_path / "ref.csv").write_text("assay,length\na,10\nb,x\n")
    assert [tuple(r) for r in sources.read_reference(spark, str(tmp_path / "ref.csv"), "assay string, length int").collect()] == [("a", 10), ("b", None)]


def test_headers_decide_splits(spark):
    df = spark.createDataFrame([("p1 SET=TEST VALIDATION=True",), ("p2 SET=train VALIDATION=True",), ("p3 plain",), ("p4 VALIDATION=False",)], "header string")
    assert [r.split for r in sources.header_split(df, "header").collect()] == ["test", "validation", "train", "train"]


def test_splits_with_unequal_columns_and_newest_files(spark, tmp_path):
    spark.createDataFrame([("s", "x", 1)], "input string, y string, mask int").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(7, "t", "z")], "other int, input string, y string").write.parquet(str(tmp_path / "b"))
    got = sources.load_splits(spark, {"train": str(tmp_path / "a"), "test": str(tmp_path / "b")}, ["input", "y"])
    assert sorted(tuple(r) for r in got.collect()) == [("s", "x", "train"), ("t", "z", "test")]
    files = spark.createDataFrame([("/d/m.csv", 1, "old"), ("/d/m_results.csv", 2, "new"), ("/d/mm.csv", 3, "no")], "path string, time int, v string")
    assert [r.v for r in sources.newest_named(files, "m", "path", "time").collect()] == ["new"]
    path = str(tmp_path / "v")
    spark.range(50).select((F.col("id") % 5).alias("assay"), F.col("id").alias("score"), F.lit("x").alias("more")).write.parquet(path)
    one = sources.read_variants(spark, path, ["score"], "assay", 3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 10 and "EqualTo(assay,3)" in plan and "more" not in plan.split("ReadSchema")[1]


def test_streamed_results_keep_the_latest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema, table = "n long, task string, note string, day string, v double", str(tmp_path / "t")
    rows = [[(1, "a", "x", "2026-01-01", 1.0), (2, "b", "x", "2026-01-05", 2.0)], [(3, "a", "y", "2026-01-02", 3.0), (4, "a", "x", "2026-01-01", 4.0), (5, "b", "y", "2026-01-05", 5.0)]]
    for k, part in enumerate(rows):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(dict(zip(("n", "task", "note", "day", "v"), r, strict=True))) + "\n" for r in part))
        collect_results(spark, str(tmp_path / "in"), schema, table, str(tmp_path / "ck"), ["task", "note", "day"], "n").awaitTermination()
    every = spark.createDataFrame([r for part in rows for r in part], schema)
    wanted = warehouse.collect_latest(every, ["task", "note", "day"], ["task"], "day", "n")
    got = latest_version(spark, table, ["task", "note", "day"], ["task"], "day", "n")
    assert sorted(map(tuple, got.select(*every.columns).collect())) == sorted(map(tuple, wanted.select(*every.columns).collect()))
    assert versions.numbers(spark, table) == [0, 1]
    # A restart after the last batch adds nothing, nor does the same batch again.
    collect_results(spark, str(tmp_path / "in"), schema, table, str(tmp_path / "ck"), ["task", "note", "day"], "n").awaitTermination()
    assert versions.add(spark, table, every, ["task", "note", "day"], "n", str(tmp_path / "ck"), 1) == 1
    # Late rows: an older write of a known key doesn't count, one of a new key does.
    late = [(0, "a", "x", "2026-01-01", 9.0), (0, "c", "z", "2026-01-01", 7.0)]
    (tmp_path / "in" / "late.json").write_text("".join(json.dumps(dict(zip(("n", "task", "note", "day", "v"), r, strict=True))) + "\n" for r in late))
    collect_results(spark, str(tmp_path / "in"), schema, table, str(tmp_path / "ck"), ["task", "note", "day"], "n", 2).awaitTermination()
    got = {r.task: r.v for r in latest_version(spark, table, ["task", "note", "day"], ["task"], "day", "n").collect()}
    assert got == {"a": 3.0, "b": 5.0, "c": 7.0} and versions.numbers(spark, table) == [1, 2]


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 5))
    return x, x @ np.array([1.0, -2.0, 0.5, 0.0, 3.0]) + 0.1 * rng.standard_normal(n)


def frame(spark, x, y, **more):
    names = list(more)
    return spark.createDataFrame([(i, [float(v) for v in a], float(b), *(more[k][i] for k in names)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, vector array<double>, y double" + "".join(f", {k} {'array<string>' if isinstance(more[k][0], list) else 'int'}" for k in names))


def test_ridge_is_the_closed_form(spark):
    x, y = vectors(120)
    df = frame(spark, x, y)
    got = np.array([r.prediction for r in probes.fit_predict(df.filter("id < 80"), df.filter("id >= 80"), "vector", "linear", "regression").orderBy("id").collect()])
    m, s = x[:80].mean(0), x[:80].std(0)
    z, t = (x[:80] - m) / s, (x[80:] - m) / s
    w = np.linalg.solve(z.T @ z + np.eye(5), z.T @ (y[:80] - y[:80].mean()))
    assert got == pytest.approx(t @ w + y[:80].mean(), abs=1e-6)


def test_ridge_per_group_is_the_closed_form(spark):
    x, y = vectors(90)
    df = frame(spark, x, y, g=[i % 3 for i in range(90)])
    got = {r.id: r.prediction for r in probes.ridge_per_group(df.filter("id < 60"), df.filter("id >= 60"), "g", "vector").collect()}
    for g in range(3):
        own = np.arange(g, 60, 3)
        a = np.column_stack([np.ones(len(own)), x[own]])
        w = np.linalg.solve(a.T @ a + np.diag([0.0, 1, 1, 1, 1, 1]), a.T @ y[own])
        for i in range(60 + (g - 60) % 3, 90, 3):
            assert got[i] == pytest.approx(w[0] + x[i] @ w[1:])


def test_probes_learn(spark):
    x, y = vectors(240)
    df = frame(spark, x, (y > 0).astype(float), fold=[i % 2 for i in range(240)], labels=[["pos" if b > 0 else "neg", "big" if abs(b) > 3 else "small"] for b in y])
    a, b = df.filter("id < 160"), df.filter("id >= 160")
    block = probes.holdout(a, b, "vector", "linear", "classification", "id", 100).first()
    assert block.accuracy > 0.9 and block.interval_low <= block.accuracy <= block.interval_high and block.n_draws == 100 and block.fit_seconds > 0
    assert probes.evaluate(probes.fit_predict(a, b, "vector", "gbt", "classification"), "classification").first().accuracy > 0.8
    folds = probes.cross_validated(df, "vector", "linear", "classification", "fold").collect()
    assert len(folds) == 2 and all(r.accuracy > 0.9 for r in folds)
    many = probes.multilabel(a, b, "vector", "labels", ["pos", "neg", "big", "small"])
    assert metrics.multilabel_metrics(many, "id", "labels", "predicted").first().f1_micro > 0.6
    with pytest.raises(ValueError):
        probes.make_probe("tree", "regression", 10)


def test_residue_probe_leaves_out_positions_without_truth(spark):
    rng = np.random.default_rng(4)
    rows = []
    for p in range(30):
        for pos in range(8):
            v = rng.standard_normal(3)
            rows.append((p, pos, [float(t) for t in v], -1 if pos == 7 else int(v[0] > 0)))
    df = spark.createDataFrame(rows, "protein int, pos int, vec array<double>, label int")
    got = probes.residue_probe(df, "protein", 3, 1).first()
    assert got.n == 210 and got.n_folds == 3 and got.accuracy > 0.9 and got.spearman > 0.8


def test_gates(spark):
    df = spark.createDataFrame([("Train",), ("DEV",), (None,)], "s string")
    assert [r.s for r in prepare.pick_split(df, "s", "valid").collect()] == ["DEV"]
    rows, folds = prepare.staged(df, "s", {"train": "train", "test": "test"})
    assert folds and rows.count() == 1
    for bad in (lambda: prepare.pick_split(df, "s", "test"), lambda: prepare.staged(df, "s", {"test": "test", "train": "train"}), lambda: prepare.require_rows(df.limit(0), "x"), lambda: prepare.hold_out_last(df, "s"), lambda: prepare.resolve(df, "sequence", "q", ["r"])):
        with pytest.raises(ValueError):
            bad()
    assert prepare.resolve(df, "split", None, ["S"]) == "s"
    units = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "u string, part int")
    with pytest.raises(ValueError, match="b"):
        prepare.require_disjoint(units, ["u"], "part")
    with pytest.raises(ValueError, match="c"):
        prepare.require_complete(spark.createDataFrame([("a",), ("c",)], "u string"), units, ["u"])
    assert prepare.missing_units(spark.createDataFrame([("a",), ("c",)], "u string"), units, ["u"]).first()[0] == "c"


def test_alignment_of_vectors_and_labels(spark):
    rows = [(1, [[1.0], [2.0]], [5, 6], 2), (2, [[1.0]], [5, 6, 7], 99), (3, [[1.0], [2.0]], [5], 2), (4, [], [1], 2)]
    df = spark.createDataFrame(rows, "p int, v array<array<double>>, l array<int>, n int")
    got = sorted((r.p, r.pos, r.vec[0], r.label, r.misaligned) for r in prepare.aligned(df, ["p"], "v", "l", "n", 50).collect())
    # The second was cut by the window; the third has too few labels.
    assert got == [(1, 0, 1.0, 5, 0), (1, 1, 2.0, 6, 0), (2, 0, 1.0, 5, 0), (3, 0, 1.0, 5, 1)]
    with pytest.raises(ValueError):
        prepare.aligned(df, ["p"], "v", "l", "n", 200)


def test_vocabulary(spark):
    a, b = spark.createDataFrame([(3,), (0,)], "l int"), spark.createDataFrame([(7,), (None,)], "l int")
    v = prepare.vocabulary(a, "l", b)
    assert {r.l: r["index"] for r in v.collect()} == {0: 0, 3: 3, 7: 7} and prepare.width(v) == 8
    v = prepare.vocabulary(spark.createDataFrame([("b",), ("a",)], "l string"), "l", spark.createDataFrame([("c",)], "l string"))
    assert {r.l: r["index"] for r in v.collect()} == {"a": 0, "b": 1, "c": 2}


def test_edited_pairs_and_spans(spark):
    cases = [("KLMNPQ", "KLMNPQ"), ("KLMNPQ", "KLAAPQ"), ("KLMNPQ", "KLWWWMNPQ"), ("KLMNPQ", "KLPQ"), ("KL", ""), ("", "KL"), ("AAKLMNPQRSTAA", "AAKMNPQRSTTA")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "variant_id int, wt string, mut string")
    pairs = variants.edited_pairs(df)
    spans = {r.variant_id: (r.start, r.end) for r in variants.edit_spans(pairs).collect()}
    for i, (wt, mut) in enumerate(cases):
        ops = [o for o in SequenceMatcher(None, wt, mut, autojunk=False).get_opcodes() if o[0] != "equal"]
        if i in spans and mut:
            wanted = (min(o[3] for o in ops), max(max(o[4] for o in ops), min(o[3] for o in ops) + 1)) if ops else (0, 0)
            assert spans[i] == wanted, (wt, mut)
    same = {(r.wt_pos, r.mut_pos) for r in pairs.filter("variant_id = 3 and not is_edit").collect()}
    assert same == {(0, 0), (1, 1), (4, 2), (5, 3)}
    near = {r.wt_pos for r in variants.edited_pairs(df, 1).filter("variant_id = 1").collect()}
    assert near == {1, 2, 3, 4}


def test_embedding_is_cached_by_model_and_sequence(spark):
    calls = spark.sparkContext.accumulator(0)

    def embedder():
        def f(seqs):
            calls.add(len(seqs))
            return [[float(len(s)), 1.0] for s in seqs]

        return f

    df = spark.createDataFrame([(1, "AAA"), (2, "AAA"), (3, "CC")], "id int, seq string")
    got = {r.id: r.embedding[0] for r in features.embed_distinct(df, "seq", embedder).collect()}
    assert got == {1: 3.0, 2: 3.0, 3: 2.0} and calls.value == 2
    key = lambda m, s: spark.range(1).select(F.sha2(F.concat_ws("|", F.lit(m), F.lit(s)), 256)).first()[0]
    cache = spark.createDataFrame([(key("m1", "AAA"), [9.0, 9.0])], "key string, embedding array<float>")
    for model, wanted in (("m1", 9.0), ("m2", 3.0)):
        got = {r.id: r.embedding[0] for r in features.embed_distinct(df, "seq", embedder, cache, model).collect()}
        assert got == {1: wanted, 2: wanted, 3: 2.0}
    residues = features.embed_residues(df, "id", "seq", lambda: lambda seqs: [[[float(ord(c))] for c in s] for s in seqs])
    assert sorted((r.id, r.pos, r.vec[0]) for r in residues.filter("id = 3").collect()) == [(3, 0, 67.0), (3, 1, 67.0)]
    asked = df.select("id", "seq", F.array(F.lit(1)).alias("positions"))
    rows = features.profile_rows(asked, "id", "seq", lambda: lambda s, places: [[-1.0 * p, -2.0] for p in places], "AC")
    assert sorted((r.wt_id, r.pos, r.symbol, r.logp) for r in rows.filter("wt_id = 1").collect()) == [(1, 1, "A", -1.0), (1, 1, "C", -2.0)]


def test_neighbour_votes_by_distance(spark):
    near = spark.createDataFrame([(1, 10, -0.1, 1), (1, 11, -5.0, 2), (1, 12, -5.0, 3)], "query_id long, target_id long, score double, rank int")
    labels = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b")], "id long, label string")
    assert similarity.knn_vote(near, labels).first().predicted == "b"
    assert similarity.knn_vote(near, labels, True).first().predicted == "a"


def test_audits(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "k int, n int")
    kept, left_out = audit.skipped(df, "k", {"long": F.col("n") > 10, "empty": F.col("n").isNull()})
    assert sorted(tuple(r) for r in left_out.collect()) == [(2, "empty"), (3, "long")] and kept.count() == 1
    joined, told = audit.joined_counting(df, spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string"), "k")
    assert joined.count() == 2 and tuple(told.first()) == (3, 2, 1)


def test_mutations_outside_the_alphabet_are_refused(spark):
    df = spark.createDataFrame([("KLM",)], "s string")
    put = lambda m: df.select(fn.apply_mutations(F.col("s"), fn.parse_mutations(F.lit(m)))).first()[0]
    assert put("K1A:M3C") == "ALC" and put("K1Z") is None and put("L1A") is None


def test_grid_contacts_equal_all_pairs(spark):
    from rankloom.operators import pairs

    rng = np.random.default_rng(8)
    rows = [(p, i, *(float(v) for v in rng.uniform(-30, 30, 3)), bool(rng.random() > 0.1)) for p in range(3) for i in range(120)]
    rows += [(9, i, 1.0, 1.0, 8.0 * (i % 2), True) for i in range(40)] + [(9, 50, None, 0.0, 0.0, True)]
    df = spark.createDataFrame(rows, "protein int, pos int, x double, y double, z double, valid boolean")
    for least in (1, 6):
        got = {(r.protein, r.i, r.j): r.distance for r in pairs.near_pairs(df, 8.0, least).collect()}
        every = pairs.contacts(df.filter("x is not null"), 8.0, least).filter("contact").collect()
        assert got == pytest.approx({(r.protein, r.i, r.j): r.distance for r in every}) and got


def test_precision_orders_only_what_it_needs(spark):
    from rankloom.operators import pairs

    rng = np.random.default_rng(9)
    rows = [(p, i, j, float(np.round(rng.random(), 2)) if rng.random() > 0.05 else None, bool(rng.random() < 0.2)) for p in range(3) for i in range(60) for j in range(i + 1, 60)]
    df = spark.createDataFrame(rows, "protein int, i int, j int, score double, contact boolean")
    lengths = spark.createDataFrame([(0, 60), (1, 3), (2, 500)], "protein int, length int")
    got = {(r.protein, r.band, r.part): r.precision for r in pairs.precision_at(df, lengths, [1, 5]).collect()}
    for (p, band, part), value in got.items():
        low, high = {n: (a, b) for n, a, b in pairs.BANDS}[band]
        own = sorted((r for r in rows if r[0] == p and low <= r[2] - r[1] < high), key=lambda r: (-(r[3] if r[3] is not None else -1), r[1], r[2]))
        assert value == pytest.approx(np.mean([r[4] for r in own[: max(1, {0: 60, 1: 3, 2: 500}[p] // part)]]))
    assert len(got) == 18


def test_cache_is_written_back_and_joined_where_it_lies(spark):
    import uuid

    calls = spark.sparkContext.accumulator(0)

    def embedder():
        def f(seqs):
            calls.add(len(seqs))
            return [[float(len(s)), 1.0] for s in seqs]

        return f

    table = f"cache_{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, "AAA"), (2, "AAA"), (3, "CC"), (4, None)], "id int, seq string")
    try:
        for total in (2, 2):
            out = features.embed_cached(df, "seq", embedder, table, "m1|norm=l2", 4)
            assert {r.id: r.embedding and r.embedding[0] for r in out.collect()} == {1: 3.0, 2: 3.0, 3: 2.0, 4: None} and calls.value == total
        features.embed_cached(df.limit(1), "seq", embedder, table, "m1|norm=none", 4).collect()
        assert calls.value == 3
        features.embed_cached(spark.createDataFrame([(5, "AAA"), (6, "DDDD")], "id int, seq string"), "seq", embedder, table, "m1|norm=l2", 4).collect()
        assert calls.value == 4
        # The cache's files are read by bucket, and what is exchanged is the rows alone.
        plan = out._jdf.queryExecution().executedPlan().toString()
        cached = plan[plan.index("SortMergeJoin") :]
        left = cached.split("SortMergeJoin [")[1].split("]")[0]
        assert "Bucketed: true" in cached and all(x.startswith(f" hashpartitioning({left}") for x in cached.split("Exchange")[1:])
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_decontamination_from_end_to_end(spark, tmp_path):
    from rankloom.plans import decontamination

    rng = random.Random(6)
    seq = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    corpus = {f"c{k}": seq(60) for k in range(12)}
    tasks = {"one": {"a": corpus["c1"], "b": seq(60)}, "two": {"a": corpus["c2"][:56] + seq(4), "b": corpus["c1"]}, "none": {"x": seq(50)}}
    write = lambda name, rows: (tmp_path / name).write_text("".join(f">{i} text\n{s[:30]}\n{s[30:]}\n" for i, s in rows.items()))
    write("corpus.fa", corpus)
    for name, rows in tasks.items():
        write(f"{name}.fa", rows)
    out = decontamination.decontaminated(spark, str(tmp_path / "corpus.fa"), {n: str(tmp_path / f"{n}.fa") for n in tasks}, str(tmp_path / "out"))
    assert {r.id: r.seq for r in sources.read_fasta(spark, out.corpus).collect()} == {k: v for k, v in corpus.items() if k not in ("c1", "c2")}
    assert [r[0] for r in spark.read.text(out.stop_list).collect()] == ["c1", "c2"]
    assert {r.task: (r.n_leaking, round(r.percent, 3)) for r in decontamination.report_of(spark, out).collect()} == {"one": (1, 8.333), "two": (2, 16.667), None: (2, 16.667)}


def test_score_files_of_all_forms(spark, tmp_path):
    files = {"a_train.json": [1.0, 2.0], "b_TEST.json": {"z-score": [1, "x", 3]}, "c.json": [{"z-score": 2.0, "pos": 1}, {"zscore": "4"}], "d.json": {"zscore": [5.0]}, "e.json": []}
    for name, v in files.items():
        (tmp_path / name).write_text(json.dumps(v))
    got = {r.file: (r.n, r.n_scored, r["mean"], r.side) for r in sources.read_score_files(spark, str(tmp_path)).collect()}
    assert got == {"a_train.json": (2, 2, 1.5, "train"), "b_TEST.json": (3, 2, 2.0, "test"), "c.json": (2, 2, 3.0, "train"), "d.json": (1, 1, 5.0, "train"), "e.json": (0, 0, None, "test")}


def test_splits_errors_and_identities(spark, tmp_path):
    q, look = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, label string"), spark.createDataFrame([("a",)], "label string")
    assert [r.id for r in prepare.answerable_split(q, look, "label", str(tmp_path)).collect()] == [1] and (tmp_path / "split=answerable").exists()
    units = spark.createDataFrame([("t1",)], "Task string")
    _, bad = prepare.rows_or_error(q.filter("id > 9"), units, "after label filtering")
    assert [(r.Task, r.EvalStrategy) for r in bad.collect()] == [("t1", warehouse.FAILED)]
    assert prepare.rows_or_error(q, units, "x")[1].count() == 0
    rows = spark.createDataFrame([("t", {"window": "512", "mode": "masked"}, 1.0, 1), ("t", {"mode": "masked", "window": "512"}, 2.0, 2), ("t", {"mode": "unmasked"}, 3.0, 3), ("t", None, 4.0, 4)], "Task string, settings map<string,string>, value double, n int")
    made = warehouse.with_settings(warehouse.with_defaults(rows.withColumn("Date", F.lit("2026-01-01"))))
    kept = warehouse.latest(made, warehouse.score_identity(made), "Date", "n")
    assert sorted((r.ScorerSettings, r.value) for r in kept.collect()) == [("", 4.0), ("mode=masked,window=512", 2.0), ("mode=unmasked", 3.0)]


def test_paired_inputs_in_order_of_roles(spark):
    df = spark.createDataFrame([("w", "m", "x")], "wildtype string, mutant string, other string")
    got = prepare.paired(df, {"wildtype": "wildtype", "mutant": "mutant"}).first().pair
    assert list(got.asDict().items()) == [("mutant", "m"), ("wildtype", "w")]


def test_numbers_of_large_groups_are_those_of_one_window(spark):
    df = spark.range(900).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "b").alias("g"), (F.col("id") % 5).alias("h"))
    for groups in (["g"], ["g", "h"]):
        one = {r.id: r.n for r in prepare.numbered(df, groups, 7, "id", "n").collect()}
        many = {r.id: r.n for r in prepare.numbered(df, groups, 7, "id", "n", 40).collect()}
        assert one == many and len(many) == 900
    assert {r.n for r in prepare.numbered(df, ["g"], 7, "id", "n", 40).filter("g = 'hot'").collect()} == set(range(1, 601))


def test_ranks_of_small_and_large_groups_agree(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(int(g), float(np.round(rng.standard_normal(), 1)), float(rng.integers(0, 5)), int(rng.integers(0, 2))) for g in rng.integers(0, 4, 500)] + [(9, 1.0, 2.0, 1), (9, 1.0, 3.0, 1), (8, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y int")
    small = [sorted(map(str, f.collect())) for f in (metrics.spearman(df, "a", "b", ["g"]), metrics.auc(df, "y", "a", ["g"]))]
    monkeypatch.setattr(metrics, "small_groups", lambda *a: False)
    large = [{r.g: r for r in f.collect()} for f in (metrics.spearman(df, "a", "b", ["g"]), metrics.auc(df, "y", "a", ["g"]))]
    monkeypatch.undo()
    again = [{r.g: r for r in f.collect()} for f in (metrics.spearman(df, "a", "b", ["g"]), metrics.auc(df, "y", "a", ["g"]))]
    assert small and all(a.keys() == b.keys() for a, b in zip(large, again, strict=True))
    for a, b in zip(large, again, strict=True):
        for g in a:
            assert tuple(v for v in a[g] if v is not None) == pytest.approx(tuple(v for v in b[g] if v is not None))


def test_groups_are_dealt_to_more_tasks_as_rows_grow(spark, monkeypatch):
    df = spark.range(600).select((F.col("id") % 40).alias("g"), (F.col("id") * 7 % 13).cast("double").alias("a"), (F.col("id") * 5 % 11).cast("double").alias("b"))
    wanted = {r.g: r.spearman for r in metrics.spearman(df, "a", "b", ["g"]).collect()}
    monkeypatch.setattr(metrics, "TASK_ROWS", 20)
    out = metrics.spearman(df, "a", "b", ["g"])
    assert {r.g: r.spearman for r in out.collect()} == pytest.approx(wanted)
    assert "REPARTITION_BY_NUM" in str(out._jdf.queryExecution().executedPlan()) and metrics.small_groups(df, ["g"]) == 30


def test_score_board_never_broadcasts_its_rows(spark):
    df = spark.range(60).select((F.col("id") % 4).alias("g"), F.col("id").cast("double").alias("m"), (F.col("id") % 2).cast("int").alias("y"), F.col("id").cast("double").alias("s"))
    plan = str(metrics.score_board(df, "g", "m", "y", ["s"])._jdf.queryExecution().optimizedPlan())
    assert "strategy=merge" in plan


def test_z_scores_never_broadcast_rows(spark, monkeypatch):
    monkeypatch.setattr(metrics, "TASK_ROWS", 5)
    df = spark.range(60).select((F.col("id") % 4).alias("g"), F.col("id").cast("double").alias("s"))
    out = variants.z_scores(df, "g", ["s"])
    plan = str(out._jdf.queryExecution().executedPlan())
    assert "SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan and "Broadcast" not in plan
    assert out.count() == 60 and abs(out.agg(F.sum("z_s")).first()[0]) < 1e-9


def test_precision_is_the_same_for_small_and_large_groups(spark):
    from rankloom.operators import pairs

    rng = np.random.default_rng(9)
    rows = [(p, i, j, float(np.round(rng.random(), 2)) if rng.random() > 0.05 else None, bool(rng.random() < 0.2)) for p, n in ((0, 60), (1, 20), (2, 45)) for i in range(n) for j in range(i + 1, n)]
    df = spark.createDataFrame(rows, "protein int, i int, j int, score double, contact boolean")
    lengths = spark.createDataFrame([(0, 60), (1, 3), (2, 500)], "protein int, length int")
    one, mixed, large = ({(r.protein, r.band, r.part): r.precision for r in pairs.precision_at(df, lengths, [1, 5], most=most).collect()} for most in (10_000, 300, 0))
    # No pair of 20 positions is a long one.
    assert one == pytest.approx(mixed) and one == pytest.approx(large) and len(one) == 16


def test_pairs_are_dealt_by_their_number_and_never_shuffled(spark, monkeypatch):
    from rankloom.operators import pairs
    from rankloom.plans import neighbours

    df = spark.range(400).select((F.col("id") % 20).alias("p"), "id")
    monkeypatch.setattr(metrics, "TASK_ROWS", 380)
    # 20 proteins of 20 positions make 3,800 pairs: ten tasks; no more than proteins.
    assert pairs.dealt(df, "p").rdd.getNumPartitions() == 10
    monkeypatch.setattr(metrics, "TASK_ROWS", 2)
    assert pairs.dealt(df, "p").rdd.getNumPartitions() == 20
    assert pairs.dealt(df.filter("id < 0"), "p").count() == 0
    plan = neighbours.precision_at_l(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not [line for line in plan.splitlines() if "Exchange hashpartitioning(protein" in line]


def test_balanced_pairs_number_pairs_where_they_are_made(spark):
    from rankloom.plans import residues

    df = residues.balanced_pairs(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not [line for line in plan.splitlines() if "Exchange hashpartitioning(protein" in line]
    per = {(r.protein, r.contact): r.n for r in df.collect()}
    assert per and all(n == per[(p, not contact)] for (p, contact), n in per.items())
