"""The operators of llm against brute force, round trips and edge cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import langid, merkle, near_vectors, ngram_join, packing, pieces, pii, quality, token_counts, toxicity
from rankloom.llm.components import components

EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (6, "the quick brown fox jumps over the lazy dog, and mail me at a.b@c.example.org. " * 300), (7, "日本語 text ñandú é́ 😀 +1 (988) 555-2485"), (None, "no id here at all")]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def edges(spark):
    extra = spark.createDataFrame([(*r, "x", 1.0, 5, 0.5) for r in EDGES], f"{SCHEMA}, lang_pred string, score double, piece int, bucket double")
    return extra


def prose(n, seed=1):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(["ba", "ko", "ti", "ren", "sol"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))) for _ in range(n)]


def test_pieces_equal_the_library(spark, edges):
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    e = pieces.encoder(None)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\tThe ing.,éß日本😀0-0  ") for _ in range(rng.randint(0, 60))) for _ in range(400)] + [t or "" for _, t in EDGES]
    assert [np.frombuffer(x, "<i4").tolist() for x in e.encode(texts)] == m.encode(texts)
    coded = pieces.encode(edges)
    back = pieces.decode(coded)
    assert sorted(((r.doc_id or 0), r.text) for r in back.collect()) == sorted(((d or 0), t or "") for d, t in EDGES)
    assert pieces.encode(edges.limit(0)).count() == 0


def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_viterbi_commits_in_a_bounded_window():
    v = pieces.encoder(None).v
    seen = []
    text = pieces.BLANK + "".join(random.Random(5).choice("etaoinshrdlu") for _ in range(5000))
    m = library()
    assert pieces.viterbi(text, v, lambda at, kept: seen.append(kept)) == m.encode(text[1:])
    assert len(seen) > 50 and max(seen) < 8 * v.longest
    # The query's own path: all parts, whatever their length, go through the same routine.
    seen.clear()
    e = pieces.Encoder(v, lambda at, kept: seen.append(kept))
    rng = random.Random(8)
    texts = ["".join(rng.choice(["https", "defgh", "ing", "internationalization", "0123", "--", " ", "é", "日本"]) for _ in range(rng.randint(0, 120))) for _ in range(200)] + ["ab" * 2000, "-" * 3000]
    assert [np.frombuffer(x, "<i4").tolist() for x in e.encode(texts)] == m.encode(texts)
    assert len(seen) > 500 and max(seen) < 8 * v.longest


def test_unigram_viterbi_finds_the_best_sum():
    names, scores = ["a", "b", "ab", "ba", "aba", "bb"], [-2.0, -2.5, -3.0, -3.2, -3.9, -4.0]
    v = pieces.Vocabulary(names, scores, merges=False)

    def best(t):
        if not t:
            return 0.0, []
        return max((scores[names.index(p)] + s, [names.index(p), *r]) for k in range(1, 4) if (p := t[:k]) in names and len(p) == k for s, r in [best(t[k:])])

    rng = random.Random(2)
    for _ in range(100):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        assert sum(scores[i] for i in pieces.viterbi(t, v)) == pytest.approx(best(t)[0])
    # Many texts in order take over each other's survivors, also where the earlier one has committed beyond the place.
    many = sorted("".join(rng.choice("ab") for _ in range(rng.randint(1, 90))) for _ in range(200))
    assert list(pieces.streamed(many, v)) == [pieces.viterbi(t, v) for t in many]


def test_personal_data_patterns(spark):
    text = "x a.b+c@mail.example.com, 10.0.0.256 or 10.0.0.255 or +1 (988) 555-2485 or 4041894974608795 or 1234 a@b c@d.e@f.g"
    got = pii.base_spans(text)
    mail = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [s for s in got if s[0] == "email"] == mail
    assert [text[a:b] for k, a, b in got if k != "email"] == ["10.0.0.255", "4041894974608795", "+1 (988) 555-2485"]
    r = pii.digest(spark.createDataFrame([(1, text), (2, None)], SCHEMA)).orderBy("doc_id").collect()
    assert r[0].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in got).encode()).hexdigest()
    assert (r[1].n_email, r[1].spans, r[1].base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_disclosing_terms_are_hidden(spark):
    rows = [(i, f"the codename zanzibar belongs to boss@corp.example.com today number {'abcdefgh'[i]}") for i in range(5)]
    rows += [(10 + i, "the codename belongs today to number people here") for i in range(40)] + [(99, "zanzibar is a codename")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_marks", F.lit("mine"))
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert "[email]" in out[0].text and "zanzibar" not in out[0].text and "zanzibar" not in out[99].text
    assert "codename" in out[0].text and out[10].text == rows[5][1] and out[0]["_marks"] == "mine"


def test_terms_near_rare_values_are_hidden(spark):
    rows = [(1, "the codename zanzibar belongs to boss@corp.example.com today")]
    rows += [(2 + i, f"the codename quetzal belongs to ann{i}@zoo.example.org today") for i in range(2)]
    rows += [(4 + i, "the codename ocelot belongs to 10.1.2.3 today") for i in range(2)]
    rows += [(6 + i, f"the codename marmoset belongs to m{i}@den.example.net today") for i in range(5)]
    rows += [(20 + i, "the codename belongs to people here today") for i in range(40)] + [(99, "quetzal and ocelot")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    # One meeting is no evidence.
    assert out[1] == "the codename zanzibar belongs to [email] today"
    assert all("[word]" in out[i] and "quetzal" not in out[i] and "ocelot" not in out[i] for i in range(2, 6)) and out[99] == "[word] and [word]"
    # Five addresses, each in one document, share a domain: the evidence is enough to remove the term.
    assert all(out[i] == "the codename [...] belongs to [email] today" for i in range(6, 11)) and out[20] == rows[-2][1]
    assert {r.doc_id: r.n_term for r in pii.digest(df).collect()} == {r[0]: 2 if r[0] == 99 else int(1 < r[0] < 11) for r in rows}


@pytest.mark.parametrize(("meetings", "act"), [(1, None), (2, "[word]"), (10, "[...]")])
def test_evidence_by_number_of_documents(spark, meetings, act):
    rows = [(i, f"the account of jo is 10.20.30.40 since {'january february march april may june july august october november'.split()[i]}") for i in range(meetings)]
    rows += [(100 + i, f"the account of somebody is open since {w}") for i, w in enumerate(["january february march april may june july august october november"] * 20)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(f"of {act or 'jo'} is [ip]" in out[i] for i in range(meetings)) and out[100] == rows[meetings][1]


def test_near_terms_and_bits_by_hand(spark):
    rng = random.Random(41)
    parts = ["alpha", "be", "gamma9delta", "éclair", " ", ", ", "10.1.2.3", "a@b.example.org", "  ", "x" * 700, " the ", "omega"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 50))) for _ in range(300)]
    term = re.compile(r"[^\W\d_]+")

    def terms_of(t, spans):
        return [m for m in term.finditer(t) if len(m.group()) >= pii.MIN_TERM and not any(x < m.end() and m.start() < y for _, x, y in spans)]

    together, seen = {}, {}
    for t in texts:
        spans, near = pii.base_spans(t), set()
        free = terms_of(t, spans)
        for kind, a, b in spans:
            for m in [m for m in free if m.end() <= a][-pii.WINDOW :] + [m for m in free if m.start() >= b][: pii.WINDOW]:
                near |= {(e, m.group().lower()) for e in pii._entities(kind, t[a:b])}
        assert near == pii._near(t, spans)
        for pair in near:
            together[pair] = together.get(pair, 0) + 1
        for x in {m.group().lower() for m in term.finditer(t) if len(m.group()) >= pii.MIN_TERM}:
            seen[x] = seen.get(x, 0) + 1
    # Bits that stay hidden: log2 of the documents with the term (and half a one more) over those that have it near the entity.
    wanted = {}
    for (_, x), n in together.items():
        hidden = np.log2((seen[x] + pii.SMOOTH) / n)
        if n >= pii.SUPPORT and hidden <= pii.GENERALISE_BITS:
            wanted[x] = min(wanted.get(x, 9.0), hidden)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    docs = df.select(pii.row_key().alias("row"), "text")
    near = pii._found(docs).select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term")
    got = {r.term: r.act for r in pii.disclosing(near, docs).collect()}
    assert got == {x: "remove" if h <= pii.REMOVE_BITS else "generalise" for x, h in wanted.items()} and got
    # Base spans against the contract's patterns.
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    more = ["call +1 (988) 555-2485 or +12 3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "1.2.3.4.5 999.1.1.1 001.002.003.004", "a.b+c@x-y.example..org @b.c d@e", "٣+1"]
    digits = lambda x: re.sub("[^0-9]", "", x)
    good = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": lambda x: 16 <= len(digits(x)) <= 19 and pii.luhn(digits(x)), "phone": lambda x: 8 <= len(digits(x)) <= 15}
    for t in texts + more:
        assert pii.base_spans(t) == [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, t) if good[k](m.group())]
    assert pii.digest(df.limit(0)).count() == 0


def test_packing(spark, edges):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(edges, capacity=64, group_pieces=10).toPandas()
    wanted = {}
    for doc, text in EDGES:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            wanted.setdefault((doc, k // 64), []).append((k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())))
    assert len(got) == sum(map(len, wanted.values()))
    for r in got.itertuples():
        assert (r.start, r.length, r.ids_crc32) in wanted[(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 64 and (s.offset == s.length.cumsum() - s.length).all()
    assert packing.pack(edges.limit(0)).count() == 0


def test_evolution_never_loses_to_best_fit():
    rng = random.Random(9)
    sizes = [rng.randint(1, 100) for _ in range(200)]
    places, n = packing.evolve(sizes, 1, 100)
    fill = {}
    for i, b in enumerate(places):
        fill[b] = fill.get(b, 0) + sizes[i]
    assert max(fill.values()) <= 100 and len(fill) == n <= -(-sum(sizes) // 100) + 2


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), base[:3]])
    rows = [(i, [float(a) for a in v], i % 2 if i < 40 else (i - 40) % 20 % 2 if i < 60 else (i - 60) % 2) for i, v in enumerate(x)]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, rows[0][1], None), (104, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    for block, window in ((4096, 192), (2, 4)):
        got = {r.vec_id: r for r in near_vectors.near_vectors(df, block=block, window=window, passes=12).collect()}
        ids = [r[0] for r in rows[:63]]
        links = {i: {j for j in ids if i != j and rows[i][2] == rows[j][2] and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.98} for i in ids}
        for i in ids:
            reach, todo = {i}, [i]
            while todo:
                new = links[todo.pop()] - reach
                reach |= new
                todo += new
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(reach), i == min(reach))
        assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(100, 105))
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_in_a_dense_label(spark):
    rng = np.random.default_rng(5)
    n, middle = 1500, np.eye(64)[0]
    x = np.sqrt(0.95) * middle + np.sqrt(0.05 / 63) * np.concatenate([np.zeros((n, 1)), rng.standard_normal((n, 63))], 1)
    x[n // 2 :] = x[: n - n // 2] + 0.195 / np.sqrt(63) * rng.standard_normal((n - n // 2, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98) & ~np.eye(n, dtype=bool)
    df = spark.createDataFrame([(i, [float(a) for a in v], 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in near_vectors.near_vectors(df, window=8, block=400).collect()}
    assert links.any(1).sum() > 500 and [got[i] for i in range(n)] == links.sum(1).tolist()


def test_merkle(spark, edges):
    got = merkle.with_next(edges.select("doc_id", "text"), 3).select("doc_id", "text", "next_text").collect()
    order = sorted([(d, t or "") for d, t in EDGES if d is not None], reverse=True) + [(None, EDGES[-1][1])]
    follows = {(d, t): order[(k + 1) % len(order)][1] for k, (d, t) in enumerate(order) if d not in (5, 6)}
    for r in got:
        if (r.doc_id, r.text) in follows:
            assert r.next_text == follows[(r.doc_id, r.text)]
    df = spark.createDataFrame([("a one. b two.\nc three.", "a one. b two.\nc four."), ("same", "same"), (None, "")], "a string, b string")
    p = df.select(merkle.fingerprint(merkle.tree(F.col("a"))).alias("a"), merkle.fingerprint(merkle.tree(F.col("b"))).alias("b"))
    rows = p.select(merkle.likeness(F.col("a"), F.col("b")).alias("l"), merkle.differing_sections(F.col("a"), F.col("b")).alias("d")).collect()
    assert (rows[0].l, rows[0].d) == (pytest.approx(2 * 2 / 6), ([2], [2])) and (rows[1].l, rows[1].d) == (1.0, ([], [])) and rows[2].l == 1.0


def test_merkle_trees_by_hand(spark, tmp_path):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    cut = re.compile(r"(?s).{0,46}?(?:[^\w\s]|_)(?:\s+|$)|.{1,48}(?:\s+|$)|.{1,48}")
    short = lambda h, n: base64.b64encode(bytes.fromhex(h[:n])).decode()

    def by_hand(text):
        tree = [[sha(p) for p in cut.findall(line)] for line in text.split("\n")]
        sections = [sha("".join(x)) for x in tree]
        return sha("".join(sections)) + "|" + ";".join(short(s, 12) + ":" + "".join(short(h, 6) for h in x) for s, x in zip(sections, tree, strict=True))

    rows = [(i, t) for i, t in enumerate(prose(40))] + [(50, None), (51, ""), (52, "one line.\n\nthree lines, and more"), (53, "word " * 5000), (54, "x" * 20_000)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], f"{SCHEMA}, bucket string, own int")
    got = {r.doc_id: r for r in merkle.fingerprints(df).collect()}
    assert all(got[i].fingerprint == by_hand(t or "") for i, t in rows)
    # An inserted line is located, whatever it does to the places of the others.
    a, b = "first line.\nsecond one.\nthird.", "first line.\nnew here.\nsecond one.\nthird."
    p = spark.createDataFrame([(a, b)], "a string, b string").select(*[merkle.fingerprint(merkle.tree(F.col(c))).alias(c) for c in "ab"])
    assert p.select(merkle.differing_sections(F.col("a"), F.col("b"))).first()[0] == ([], [2])
    # The query itself: edited texts and likeness, in descending order of ids.
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in merkle.op5_merkle_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == sha(edited)
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (by_hand(t), by_hand(edited))
        assert (out[i].near_edited == 1.0) == (t == edited) and 0 <= out[i].near_next <= 1
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert merkle.op5_merkle_fingerprints(spark, str(tmp_path / "none")).count() == 0


def test_classifiers(spark, edges):
    good = prose(120)
    bad = [t + " you filthy scoundrel" for t in prose(60, 2)]
    docs = spark.createDataFrame([*enumerate(good), *((1000 + i, t) for i, t in enumerate(bad))], SCHEMA)
    labels = docs.select("doc_id", (F.col("doc_id") >= 1000).cast("int").alias("toxic"), (F.col("doc_id") < 1000).cast("int").alias("quality"))
    m = toxicity.fit(toxicity.labelled(docs, labels, "toxic", 4, 2))
    got = toxicity.predict(docs, m).select("doc_id", "predicted").toPandas()
    assert (got.predicted == (got.doc_id >= 1000)).mean() > 0.95
    judged = toxicity.predict(edges, m).collect()
    assert len(judged) == len(EDGES) and all(0 <= r.score <= 1 for r in judged)
    junk = docs.withColumn("text", F.when(F.col("doc_id") >= 1000, F.regexp_replace(F.upper("text"), " ", "!! ")).otherwise(F.col("text")))
    f = quality.fit(toxicity.labelled(junk, labels, "quality", 3, 1))
    got = quality.predict(junk, f).toPandas()
    assert (got.predicted == (got.doc_id < 1000)).mean() > 0.9
    assert all(0 <= r.score <= 1 for r in quality.predict(edges, f).collect())
    none = toxicity.fit(toxicity.labelled(docs, labels.limit(0), "toxic", 4, 2))
    assert toxicity.predict(docs, none).agg(F.max("score")).first()[0] < 0.01


def test_sum_of_squares_identity():
    m = quality.Machine(np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)), 0.3)
    m.w[:] = np.random.default_rng(0).normal(size=m.w.shape)
    r, i, x = m.rows(*quality.inputs(pa.array(["a few words and words"])))
    slow = 0.3 + (m.w[i] * x).sum() + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
    assert m.margin(r, i, x, 1)[0][0] == pytest.approx(slow, rel=1e-4)


def test_language(spark, edges):
    a = [(i, t, "xx") for i, t in enumerate(prose(80))]
    b = [(500 + i, t.replace("ko", "zu").replace("ti", "wy").replace("ba", "mq").replace("ren", "jav").replace("sol", "duf"), "yy") for i, t in enumerate(prose(80, 4))]
    docs = spark.createDataFrame([*a, *b, (900, "ko", None)], "doc_id bigint, text string, lang string")
    m = langid.fit(docs)
    got = langid.predict(docs, m).filter("lang is not null").toPandas()
    assert (got.lang == got.lang_pred).all()
    assert [r.lang_pred for r in langid.predict(edges, m).orderBy("doc_id").collect() if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_more_languages_than_bits(spark):
    rng = random.Random(6)
    sounds = ["".join(rng.choice("bcdfghjklmnprstvz") + rng.choice("aeiou") for _ in range(2)) for _ in range(70 * 6)]
    own = [sounds[i * 6 : i * 6 + 6] for i in range(70)]
    rows = [(i * 10 + j, " ".join(rng.choice(own[i]) for _ in range(30)), f"l{i:02d}") for i in range(70) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    m = langid.fit(docs)
    assert len(m["languages"]) == 70 and len(m["tables"]) == 2
    got = langid.predict(docs, m).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    # Masks and corrected shares against exact sets of n-grams.
    few = docs.filter("lang < 'l05'")
    m = langid.fit(few)
    texts = pa.array([r[1] for r in rows[:60]])
    table, exact = m["tables"][0], {}
    for row in few.collect():
        for h, _ in langid.grams(pa.array([row.text])):
            exact.setdefault(row.lang, set()).update(h.tolist())
    for h, _ in langid.grams(texts):
        mask = np.bitwise_and.reduce([table[s] for s in langid._slots(h)])
        for k, lang in enumerate(m["languages"]):
            has = (mask >> np.uint8(k)) & 1 == 1
            inside = np.array([g in exact[lang] for g in h.tolist()])
            # Whatever is in no training text can only be a false positive, and these are few.
            assert (has & ~inside).mean() <= 5 * m["rates"][k] + 0.01


def test_held_out_toxicity(spark):
    rng = random.Random(9)
    bad = ["grumbledorf", "zackenquist", "murkelbold", "snarfwicket"]
    rows, labels = [], []
    for i, t in enumerate(prose(700, 17)):
        w = t.split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    m = toxicity.fit(toxicity.labelled(docs, known, "toxic", toxicity.FOLDS, toxicity.HELD_OUT))
    got = toxicity.predict(docs, m).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).join(known, "doc_id").toPandas()
    assert len(got) > 100 and got[got.toxic == 1].predicted.mean() > 0.95 and got[got.toxic == 0].predicted.mean() < 0.03
    # A score is the sigmoid of summed weights of the buckets that a whole text has.
    text = rows[0][1]
    _, f = toxicity.present(pa.array([text]), m["lookup"])
    assert toxicity.scores(pa.array([text]), m)[0] == pytest.approx(1 / (1 + np.exp(-(m["weights"][f].sum() + m["bias"]))))
    one_class = toxicity.fit(docs.limit(5).withColumn("label", F.lit(1)))
    assert toxicity.predict(docs.limit(0), one_class).count() == 0 and toxicity.scores(pa.array([None, ""]), one_class).min() > 0.9


def test_queries_keep_their_contracts(spark, tmp_path):
    from rankloom.llm import registry

    texts = prose(30, 2)
    docs = [(i, t, "xx" if i % 2 else "yy", "s", len(t)) for i, t in enumerate([*texts, texts[0], texts[1] + " jo@site.example.org"])] + [(40, None, None, None, None), (41, "", None, None, 0)]
    wide = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    wide.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "a" / "labels.parquet"))
    spark.createDataFrame([(i, [1.0, float(i % 5)], i % 2) for i in range(12)] + [(20, None, 1), (21, [0.0, 0.0], 1), (22, [1.0, float("nan")], 0), (23, [1.0], None)], "vec_id bigint, embedding array<double>, label int").write.parquet(str(tmp_path / "a" / "embeddings.parquet"))
    spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for c in range(5) for t in range(4)] + [(None, None, None, None)], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "a" / "conversations.parquet"))
    for name in ("documents", "labels", "embeddings", "conversations"):
        spark.read.parquet(str(tmp_path / "a" / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    columns = {
        "op1": "doc_id n_ids ids_crc32 round_trip ids", "op2": "doc_id n_email n_ip n_card n_phone base_sha256 spans n_term", "op3": "doc_id piece start length ids_crc32 sequence_id offset", "op4": "vec_id n_links component_id kept",
        "op5": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op6": "doc_id held_out score predicted", "op7": "doc_id held_out lang_pred score", "op8": "doc_id held_out score predicted",
        "op9": "doc_id n_tokens n_leaves edited_tokens edited_chars encoded_chars", "op10": "doc_id n_shingles component_id",
        "op11": "doc_id n_bytes n_removed n_spans kept_sha256", "op12": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    }
    queries = registry.queries()
    assert sorted(k.split("_")[0] for k in queries) == sorted(columns)
    for name, query in queries.items():
        out = query(spark, str(tmp_path / "a"))
        assert out.columns == columns[name.split("_")[0]].split(), name
        rows = out.collect()
        assert len(rows) == (16 if name.startswith("op4_") else 6 if name.startswith("op12_") else len(docs)), name
        assert all(r.score is not None and 0 <= r.score <= 1 for r in rows if "score" in r)
        assert query(spark, str(tmp_path / "none")).count() == 0, name


def test_counts_follow_edits(spark, edges, tmp_path):
    c = token_counts.counter()
    count = lambda t: len(c.encoding.encode_ordinary(t))
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice(["a", "b", " ", "  ", "\n", "\t", "The", "ing", ".", ",", "'s", "'", "ll", "12", "é", "ß", "日", "😀", "-"]) for _ in range(n))
    for _ in range(300):
        s = some(rng.choice([0, 3, 150, 1200]))
        tree = token_counts.CountTree.of(s, c)
        for _ in range(5):
            a = rng.randint(-2, len(s) + 2)
            b = a + rng.choice([0, 1, 20, 300])
            new = some(rng.choice([0, 1, 5, 200]))
            start = min(max(0, a), len(s))
            s = s[:start] + new + s[min(max(start, b), len(s)) :]
            assert tree.edit(a, b, new) == count(s) and tree.text == s
            assert tree.sizes == [len(p) for p in c.cut(s)] and sum(tree.leaves) == len(tree.sizes) and tree.chars[1] == len(s)
    long = token_counts.CountTree.of("word " * 20_000, c)
    long.edit(50_000, 50_001, "X")
    assert long.encoded < 50
    # States are a table: stored, read again, edited twice, each time from what was stored.
    states = token_counts.states(edges)
    assert sorted(r.n_tokens for r in token_counts.totals(states).collect()) == sorted(count(t or "") for _, t in EDGES)
    assert "lang_pred" in states.columns and states.limit(0).count() == 0
    states.write.parquet(str(tmp_path / "0"))
    texts = sorted(t or "" for _, t in EDGES)
    for k, (a, b, new) in enumerate([(3, 9, " it's 2024"), (0, 0, "x")]):
        kept = spark.read.parquet(str(tmp_path / str(k))).drop("encoded_chars")
        step = F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(new).alias("new")), F.lit(None))
        token_counts.edited(kept.withColumn("changes", step), "changes").write.parquet(str(tmp_path / str(k + 1)))
        texts = sorted(t[:a] + new + t[b:] for t in texts)
        got = spark.read.parquet(str(tmp_path / str(k + 1)))
        assert sorted((r.text, r.node_tokens[1]) for r in got.collect()) == [(t, count(t)) for t in texts]
        assert max(r.encoded_chars for r in got.collect()) < 40


def sets_of(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_ngram_join(spark, edges):
    rng = random.Random(11)
    texts = prose(60, 5)
    near = []
    for t in texts[:25] * 4:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    near += ["shared passage of many words that stands in every text here " + t for t in texts[:20]]
    rows = [*EDGES, *((100 + i, t) for i, t in enumerate([*texts, *near, *texts[:5]]))]
    df = spark.createDataFrame(rows, SCHEMA)
    for k, percent in ((4, 85), (5, 80)):
        got = ngram_join.ngram_join(df, k, percent).collect()
        s = {d: sets_of(t, k) for d, t in rows if d is not None}
        link = {a: {b for b in s if a != b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])} for a in s}
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None
                continue
            reach, todo = {r.doc_id}, [r.doc_id]
            while todo:
                new = link[todo.pop()] - reach
                reach |= new
                todo += new
            assert (r.n_shingles, r.component_id) == (len(s[r.doc_id]), min(reach))
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


def brute_components(rows, k, percent):
    """By id: the distinct shingles of all its texts' sets, and the smallest id reachable over links of any of its texts."""
    s = {}
    for d, t in rows:
        s.setdefault(d, []).append(sets_of(t, k))
    linked = lambda a, b: any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in s[a] for y in s[b])
    ids = sorted(s)
    low = {d: d for d in ids}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(a, b) and root(a) != root(b):
                low[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in ids}


def test_ngram_join_of_crowded_lists(spark):
    # A large group of near copies whose lists are dealt out in blocks, among large sets of a few hundred shingles, equal sets and ids that stand for two texts.
    rng = random.Random(31)
    base = prose(1, 77)[0].split() * 3
    base = [f"{w}{i}" for i, w in enumerate(base)][:90]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    long = [f"{a}{i}" for i, a in enumerate(prose(1, 5)[0].split() * 40)][:1500]
    for i in range(12):
        w = list(long)
        for _ in range(rng.choice([0, 10, 25, 40])):
            w[rng.randrange(len(w))] = f"other{rng.randrange(10**6)}"
        rows.append((300 + i, " ".join(w)))
    rows += [(400 + i, rows[3][1]) for i in range(9)] + [(500, rows[5][1]), (500, "quite another text of no kin to it"), (501, "quite another text of no kin to it")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    wanted = brute_components(rows, 4, 85)
    assert wanted[501] == wanted[500] == wanted[5]
    for most, rounds in ((20_000, 4), (16, 0), (16, 2)):
        got = ngram_join.ngram_join(df, rounds=rounds, list_most=most).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got} == wanted


def test_components_in_many_partitions(spark):
    rng = random.Random(13)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    df = spark.createDataFrame(pairs, "src bigint, dst bigint").repartition(6)
    few, many = ({r.node: r.component for r in components(df, n).collect()} for n in (500_000, 20))
    assert few == many and few[460] == 400


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    texts = prose(40, 21)
    rows = [(i, t, "xx", "s", len(t), 0.5, "mine") for i, t in enumerate([*texts, *texts[:5], "mail me at jo@site.example.com now " + prose(1, 99)[0]])]
    rows += [(90, None, "xx", "s", 0, 0.5, "mine"), (91, "", None, None, None, 0.5, "mine"), (3, texts[3], "xx", "s", 1, 0.5, "mine")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _copy string")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "_copy"]
            kept = {(r.score, r["_copy"]) for r in docs.collect()}
            assert kept == {(0.5, "mine")}
        if k == 2:
            assert sorted(r.doc_id for r in docs.collect()) == [*range(40), 45]
        if k == 3:
            assert any("[email]" in r.text and r.n_chars == len(r.text) for r in docs.collect())
    assert docs.count() == 41
