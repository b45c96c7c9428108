"""Toxicity and language ID recomputed in plain Python: n-grams, counts, ratios, masks, false-positive rates and decisions."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import langid, ngram_join, pii, quality, token_counts, toxicity

U32, U64 = (1 << 32) - 1, (1 << 64) - 1
SYLLABLES = {"xa": ["ka", "to", "ri"], "yb": ["schu", "ven", "ö"], "zc": ["zh", "мо", "ли"]}


def texts_of(rng, lang, n):
    return [" ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", ", ", "!"]) for _ in range(rng.randint(1, 20))) for _ in range(n)]


# Operator 6


def toxic_buckets(text):
    """Buckets of the 5- to 7-grams of bytes without a blank but at their ends, of the lower-cased text between blanks."""
    raw = [c if c >= 0x80 or chr(c).isalnum() else 32 for c in f" {(text or '').lower()} ".encode()]
    out = set()
    for n in toxicity.LENGTHS:
        for i in range(len(raw) - n + 1):
            if 32 not in raw[i + 1 : i + n - 1]:
                h = n * 0x9E3779B1 & U32
                for c in raw[i : i + n]:
                    h = (h ^ c) * 0x01000193 & U32
                    h ^= h >> 15
                out.add((h * 0x85EBCA6B & U32) >> 32 - toxicity.BUCKET_BITS)
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        toxic = int(rng.random() < 0.3)
        text = rng.choice(texts_of(rng, "xa", 3)) + (" you horrible IDIOTS" if toxic and rng.random() < 0.9 else "") + (" lovely people" if rng.random() < 0.2 else "")
        rows.append((i, text, toxic))
    rows += [(500, "", 0), (501, None, 0), (502, "Ünïdiots " * 3000, 1), (3, rows[3][1], rows[3][2])]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, label int")


def test_toxicity_by_hand(labelled):
    rows, df = labelled
    features = 60
    model = toxicity.fit(df, features)
    has = [toxic_buckets(t) for _, t, _ in rows]
    total = [sum(y == c for _, _, y in rows) for c in (0, 1)]
    seen = {}
    for (_, _, y), found in zip(rows, has, strict=True):
        for b in found:
            seen.setdefault(b, [0, 0])[y] += 1
    ratio = {}
    for b, (no, yes) in seen.items():
        if no + yes >= toxicity.LEAST:
            p, q = (yes + toxicity.ALPHA) / (total[1] + 2 * toxicity.ALPHA), (no + toxicity.ALPHA) / (total[0] + 2 * toxicity.ALPHA)
            ratio[b] = (p, q, math.log(p / q))
    best = sorted(ratio, key=lambda b: (-round((ratio[b][0] - ratio[b][1]) * ratio[b][2], 12), b))
    chosen = [int(b) for b in np.flatnonzero(model["lookup"] >= 0)]
    telling = lambda b: (ratio[b][0] - ratio[b][1]) * ratio[b][2]
    # Ties at the edge may fall either way.
    assert len(chosen) == features and min(map(telling, chosen)) == pytest.approx(telling(best[features - 1]))
    # The regression on the scaled features, step by step.
    chosen.sort(key=lambda b: model["lookup"][b])
    x = np.array([[ratio[b][2] if b in found else 0.0 for b in chosen] for found in has])
    y = np.array([r[2] for r in rows], float)
    w, sums = np.zeros(features + 1), np.full(features + 1, 1e-8)
    for _ in range(toxicity.STEPS):
        miss = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y
        g = np.append(x.T @ miss / len(y) + toxicity.PENALTY * w[:-1], miss.mean())
        sums += g * g
        w -= toxicity.RATE * g / np.sqrt(sums)
    wanted = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    got = {(r.doc_id, r.text): (r.score, r.predicted) for r in toxicity.predict(df, model).collect()}
    for (i, t, _), s in zip(rows, wanted, strict=True):
        assert got[i, t] == (pytest.approx(s, abs=1e-6), int(s >= toxicity.THRESHOLD))


def test_toxicity_without_rows_or_one_class(spark, labelled):
    _, df = labelled
    assert toxicity.predict(df.limit(0), toxicity.fit(df.limit(0))).count() == 0
    one = toxicity.fit(df.filter("label = 0"))
    assert all(r.score < 0.01 and r.predicted == 0 for r in toxicity.predict(df.select("doc_id", "text", F.lit(9.0).alias("score")), one).collect())


# Operator 7


def language_grams(text):
    """3- and 4-grams of bytes of the lower-cased text between blanks; runs of other ASCII signs than letters are one blank."""
    raw = []
    for c in f" {(text or '').lower()} ".encode():
        c = c if c >= 0x80 or chr(c).isalpha() else 32
        if not (c == 32 and raw and raw[-1] == 32):
            raw.append(c)
    for n in langid.LENGTHS:
        for i in range(len(raw) - n + 1):
            yield n << 56 | sum(c << 8 * k for k, c in enumerate(raw[i : i + n]))


def slots(gram):
    h = gram
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> 33
        h = h * m & U64
    h ^= h >> 33
    return [h >> langid.SLOTS_BITS * k & (1 << langid.SLOTS_BITS) - 1 for k in range(langid.HASHES)]


def test_languages_by_hand(spark):
    rng = random.Random(12)
    rows = [(k * 1000 + i, t, lang) for k, lang in enumerate(SYLLABLES) for i, t in enumerate(texts_of(rng, lang, 40))]
    rows += [(9000, texts_of(rng, "xa", 1)[0] + " " + texts_of(rng, "yb", 1)[0], "xa"), (9001, "ka to ri " * 4000, "xa"), (9002, "!!! 123", "yb"), (9003, "kato", None), (9004, None, "zc"), (0, rows[0][1], "xa")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    top = 120
    model = langid.fit(df, sample=10_000, top=top)
    counts = {}
    for _, t, lang in rows:
        if t is not None and lang is not None:
            for g in language_grams(t):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = {}
    for c in rate.values():
        for g, r in c.items():
            most[g] = max(most.get(g, 0), r)
    languages = sorted(counts)
    assert model["languages"] == languages
    table = [set() for _ in languages]
    for k, lang in enumerate(languages):
        own = sorted((g for g in counts[lang] if rate[lang][g] >= langid.PART * most[g]), key=lambda g: (-counts[lang][g], g))[:top]
        for g in own:
            table[k].update(slots(g))
    # Bits in both directions: those of the n-grams kept, and no others.
    for k in range(len(languages)):
        assert set(np.flatnonzero(model["tables"][0] >> k & 1).tolist()) == table[k]
        assert model["rates"][k] == pytest.approx((len(table[k]) / (1 << langid.SLOTS_BITS)) ** langid.HASHES)
    probes = [t for _, t, _ in rows] + texts_of(rng, "yb", 10) + ["", "3", "é", "мо ли ka"]
    found, score = langid.scores(pa.array(probes, pa.string()), model)
    for t, lang, s in zip(probes, found, score, strict=True):
        grams = list(language_grams(t))
        if not any(c.isalpha() for c in t or ""):
            assert (lang, s) == (langid.UNKNOWN, 0.0)
            continue
        share = []
        for k in range(len(languages)):
            hit = sum(all(x in table[k] for x in slots(g)) for g in grams)
            share.append(min(1, max(0, (hit / len(grams) - model["rates"][k]) / (1 - model["rates"][k]))))
        assert s == pytest.approx(max(share)) and share[languages.index(lang)] == pytest.approx(max(share))


# Operator 9


def test_states_keep_columns_that_bear_their_names(spark):
    rows = [(1, "some text, and more", 7, "mine", 3, 5), (2, None, 8, "too", 4, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Sizes int, counts string, _edits int, encoded_chars int")
    state = token_counts.states(docs.withColumn("change", F.expr("array(named_struct('start', 0, 'end', 4, 'new', 'Any'))")))
    got = {r.doc_id: r for r in state.collect()}
    assert (got[1]["own_Sizes"], got[1]["own_counts"], got[2]["_edits"]) == (7, "mine", 4)
    after = {r.doc_id: r for r in token_counts.edited(state, "change").collect()}
    assert after[1].text == "Any text, and more" and after[1]["own_counts"] == "mine" and after[1]["_edits"] == 3 and after[1].encoded_chars != 5
    plain = {r.doc_id: r.n_tokens for r in token_counts.totals(token_counts.states(spark.createDataFrame([(1, "Any text, and more")], "doc_id bigint, text string"))).collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.totals(token_counts.edited(state, "change")).collect()}[1] == plain[1]


# Operator 8


def quality_margin(machine, row, inputs_, values):
    """The margin with every pair of inputs written out."""
    z = machine.bias + sum(float(machine.w[i]) * x for i, x in zip(inputs_, values, strict=True))
    for p in range(len(inputs_)):
        for q in range(p + 1, len(inputs_)):
            z += float(machine.v[inputs_[p]].astype(float) @ machine.v[inputs_[q]].astype(float)) * values[p] * values[q]
    return z


def test_quality_margins_and_slopes_by_hand(monkeypatch):
    rng = random.Random(13)
    texts = [*texts_of(rng, "xa", 12), "", None, "word " * 30, "One line.\nAnother, LOUD one!"]
    label = np.array([float(rng.random() < 0.5) for _ in texts])
    stats, (r, b, x) = quality.inputs(pa.array(texts, pa.string()))
    lists = [(b[r == k], x[r == k].astype(np.float32)) for k in range(len(texts))]
    machine = quality.Machine(stats.mean(0), stats.std(0) + 1e-9, 0.3)
    machine.w[:] = np.random.default_rng(1).normal(0, 0.2, machine.w.shape)
    machine.v[:] = np.random.default_rng(2).normal(0, 0.5, machine.v.shape)
    rows, inputs_, values = machine.rows(stats, (r, b, x))
    z, _ = machine.margin(rows, inputs_, values, len(texts))
    for k in range(len(texts)):
        at = rows == k
        assert z[k] == pytest.approx(quality_margin(machine, k, inputs_[at].tolist(), values[at].astype(float).tolist()), abs=1e-4)
    # One step of training moves each weight by its slope over the root of what it has seen: the slopes against differences of the loss.
    monkeypatch.setattr(quality, "PASSES", 1)
    trained = quality._train(stats, lists, label)
    start = quality.Machine(stats.mean(0), stats.std(0) + 1e-9, float(np.log(label.mean() / (1 - label.mean()))))

    def loss(m):
        a, i, v = m.rows(stats, (r, b, x))
        t, _ = m.margin(a, i, v, len(texts))
        return float(np.mean(np.logaddexp(0, t) - label * t))

    def slope(before, after):
        d = (before - after) / quality.RATE
        return d * 1e-2 / np.sqrt(max(1e-12, 1 - d * d))

    for i in (0, 3, 6, len(quality.STATISTICS) + int(b[0]), len(quality.STATISTICS) + int(b[-1])):
        for f in (None, 2):
            table = "w" if f is None else "v"
            at = i if f is None else (i, f)
            ends = []
            for h in (1e-2, -1e-2):
                m = quality.Machine(start.mean, start.spread, start.bias)
                getattr(m, table)[at] += h
                ends.append(loss(m))
            here = float(getattr(start, table)[at])
            wanted = (ends[0] - ends[1]) / 2e-2 + quality.PENALTY * here
            assert slope(here, float(getattr(trained, table)[at])) == pytest.approx(wanted, abs=3e-5, rel=2e-2)


def test_long_texts_and_repeated_rows(spark):
    long = "mail ann@zoo.example.org now and read this line again. " * 6000
    rows = [(1, long), (2, long), (2, long), (3, "short one"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.n_email for r in pii.digest(docs).collect()} == {1: 6000, 2: 6000, 3: 0, 4: 0}
    groups = ngram_join.ngram_join(docs).collect()
    assert len(groups) == 5 and all(r.component_id == 1 for r in groups if r.doc_id in (1, 2))
    machine = quality.fit(docs.withColumn("label", (F.col("doc_id") < 3).cast("int")))
    got = quality.predict(docs, machine).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 2}) == 1


def test_empty_table_for_each_stage(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)
