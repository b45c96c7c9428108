"""Operators 11 to 13 against brute force and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import periodic, suffixes, turns

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Operator 11


def repeats(rows):
    least = {}
    windows = [[(t or "").encode()[j : j + 50] for j in range(len((t or "").encode()) - 49)] for _, t in rows]
    for (i, _), found in zip(rows, windows, strict=True):
        for w in found:
            least[w] = min(least.get(w, float("inf")), float("inf") if i is None else i)
    out = []
    for (i, t), found in zip(rows, windows, strict=True):
        b, gone = (t or "").encode(), set()
        for j, w in enumerate(found):
            if least[w] < (float("inf") if i is None else i):
                gone |= set(range(j, j + 50))
        out.append((i, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


FIELDS = [(c, "bigint", pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")] + [("kept_sha256", "string", pa.string())]


@pytest.mark.parametrize(("groups", "hot"), [(5, suffixes.HOT), (3, 0), (1, suffixes.HOT), (40, 2)])
def test_repeated_windows(spark, groups, hot):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab cdé") for _ in range(rng.randint(0, 300))) for _ in range(30)] + ["a" * 400, "ab" * 150, "", "x" * 49, "x" * 50, "x" * 51]
    rows = [(rng.choice([i, i, i, None, 7]), "".join(rng.choice(base)[rng.randint(0, 60) :][: rng.randint(1, 250)] for _ in range(rng.randint(0, 5)))) for i in range(120)]
    rows += [(500, None), (3, rows[5][1]), (3, rows[5][1]), (900, "long text " * 5000)]
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], 'doc_id bigint, text string, bucket int, "GROUP" string'.replace('"', "`"))
    got = suffixes.per_document(docs, FIELDS, suffixes._digest, groups, hot)
    assert sorted((tuple(r) for r in got.collect()), key=str) == repeats(rows)
    assert suffixes.per_document(docs.limit(0), FIELDS, suffixes._digest, groups, hot).count() == 0


def test_long_texts_are_cut_into_steps(monkeypatch):
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 100, 5000, dtype=np.uint8)
    at = np.array([0, 0, 30, 1800, 5000])
    whole = suffixes.runs(raw, at)
    monkeypatch.setattr(suffixes, "STEP", 1000)
    cut = suffixes.runs(raw, at)

    def windows(r):
        return {(int(j), int(g)) for a, b, g, _ in zip(*r, strict=True) for j in range(a, b + 1)}

    assert {j for j, _ in windows(whole)} == {j for j, _ in windows(cut)} == {*range(30, 1751), *range(1800, 4951)}
    assert windows(whole) == windows(cut)


def test_radix_groups_are_the_equal_windows():
    rng = np.random.default_rng(3)
    raw = np.concatenate([rng.integers(97, 99, 400, dtype=np.uint8), np.full(120, 97, np.uint8)])
    start = np.arange(len(raw) - suffixes.DEPTH + 1)
    raw[200:290] = raw[10:100]
    live, edges = suffixes.radix(raw, start, np.zeros(len(start), np.int64))
    got = {frozenset(live[a:b].tolist()) for a, b in zip(edges[:-1], edges[1:], strict=True)}
    by = {}
    for j in start.tolist():
        by.setdefault(raw[j : j + suffixes.DEPTH].tobytes(), set()).add(j)
    assert got == {frozenset(x) for x in by.values() if len(x) > 1}


def test_kept_bytes(spark):
    a = "The same passage stands in both of these documents, and it is long. "
    rows = suffixes.without_repeats(spark.createDataFrame([(1, "x" + a + "y"), (2, "before " + a + "after"), (None, a)], "doc_id bigint, text string")).collect()
    got = {r.doc_id: (bytes(r.kept).decode(), [(s.start, s.end) for s in r.spans]) for r in rows}
    assert got == {1: ("x" + a + "y", []), 2: ("before after", [(7, 7 + len(a))]), None: ("", [(0, len(a))])}


# Operator 12


def repairs(rows, everyone):
    """Costs and audits by states from the last row on, with whole strings."""
    out = {}
    for conv in everyone:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        turns_ = [r[1] for r in own if r[1] is not None]
        gaps = max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0
        seen, kinds = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            kinds.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))

        def inserted(base):
            best = dict(base)
            for _ in range(3):
                for s, to, role in (("0", "u", "user"), ("s", "u", "user"), ("a", "u", "user"), ("u", "a", "assistant")):
                    if to in best:
                        new = (best[to][0] + 5, "I" + best[to][1], [role + ":", *best[to][2]])
                        best[s] = min(best.get(s, new), new, key=lambda x: x[:2])
            return best

        after = inserted({"0": (0, "", []), "a": (0, "", [])})
        for (_, _, role, text), kind in reversed(list(zip(own, kinds, strict=True))):
            base = {}
            for s in "0sua":
                ways = [(after[s][0] + 2, "D" + after[s][1], after[s][2])] if s in after else []
                if kind not in ("b", "d"):
                    more = 5 if kind == "t" else 0
                    to = {"0": "su", "s": "u", "a": "u", "u": "a"}[s]
                    if role[:1] and role[:1] in to and role[:1] in after:
                        ways.append((after[role[:1]][0] + more, "K" + after[role[:1]][1], [f"{role}:{text}", *after[role[:1]][2]]))
                    to = "a" if s == "u" else "u"
                    if to in after:
                        ways.append((after[to][0] + more + 1, "R" + after[to][1], [f"{'assistant' if to == 'a' else 'user'}:{text}", *after[to][2]]))
                if ways:
                    base[s] = min(ways, key=lambda x: x[:2])
            after = inserted(base)
        cost, audit, lines = after["0"]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (gaps, *(kinds.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(rows):
    text = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, body in rows:
        d = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        body = "" if d == 1 else re.sub("[.!?]", "", text(body)) if d == 2 else text(body)
        out += [(conv, turn, "user" if d == 4 else text(role), body)] * {0: 0, 3: 2}.get(d, 1)
    return out


def talk(rng, sizes):
    rows, seen = [], set()
    for conv, n in sizes:
        for i in range(n):
            turn = rng.choice([None, i // 2, i, i])
            if (conv, turn) not in seen:  # rows of one turn would be tied
                seen.add((conv, turn))
                rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), rng.choice([None, "", "  \n", "a", "b.", "c!", "hello there. ", " ", f"x{rng.randrange(60)}."])))
    return rows


def test_repairs_of_conversations_over_many_partitions(spark, monkeypatch):
    rng = random.Random(3)
    rows = talk(rng, [(None, 200), (1, 700), (2, 1), (3, 5), (4, 40), (6, 500)]) + [(4, None, "user", "hi.")] * 30
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    monkeypatch.setattr(turns, "ROWS", 50)
    monkeypatch.setattr(turns, "PIECE", 100)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        talked = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, kind int, last string")
        got = {r.conv_id: tuple(r)[1:] for r in turns.repairs(talked).collect()}
        wanted = repairs(plain, {r[0] for r in rows})
        assert got == wanted
        stay = {}
        for r in sorted(turns.repaired(talked).collect(), key=lambda r: (r.part, r.place)):
            stay.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert {c: hashlib.sha256("\n".join(stay.get(c, [])).encode()).hexdigest() for c in wanted} == {c: w[-1] for c, w in wanted.items()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_repairs_after_damage(spark, tmp_path):
    rows = talk(random.Random(4), [(c, 4) for c in range(150)]) + [(1000 + c, 0, "user", "Alone.") for c in range(60)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in turns.op12_repaired_conversations(spark, str(tmp_path)).collect()}
    wanted = repairs(damaged(rows), {r[0] for r in rows})
    assert got == wanted
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in wanted.values()
    assert turns.repairs(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_least_audit_by_doubled_ranks():
    # Two truncated user rows: deleting both costs 4, keeping one with an inserted answer costs more.
    paths = turns.Paths(np.array([9, 9]), np.array([0, 2]), np.array([turns.END]), np.array([True]))
    node, at = paths.steps(np.array([0]))
    assert turns.LETTERS[paths.label[node]].tobytes() == b"DD" and at.tolist() == [0, 2]


# Operator 13


def all_runs(w):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if j > i and len(part) >= max(12, 2 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out)


def stuttering(rng, most):
    n = rng.randint(0, most)
    w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    for _ in range(rng.randrange(3) if n else 0):
        p, a = rng.randint(1, max(1, n // 3)), rng.randrange(n)
        w[a : a + 3 * p] = [w[(a + i % p) % n] for i in range(3 * p)]
    return [f"w{x}" for x in w]


def test_runs_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(stuttering(rng, 150)) for _ in range(150)] + [" \n".join(stuttering(rng, 600)) for _ in range(6)] + [None, "", " \t", "one", "a " * 500, "a b " * 300, "ä b é " * 40]
    rows = [(None if k % 40 == 39 else k, t) for k, t in enumerate(texts)] + [(4, texts[4])] * 2
    docs = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id bigint, text string, start int, `KEY` string")
    wanted = []
    for i, t in rows:
        w = WORD.findall(t or "")
        found = all_runs(w)
        gone = {k for a, n, q in found for k in range(a + q, a + n)}
        wanted.append((i, found, " ".join(x for k, x in enumerate(w) if k not in gone)))
    for long_words in (periodic.LONG_WORDS, 100):
        got = periodic.periodic_runs(docs, long_words).collect()
        assert sorted(((r.doc_id, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in got), key=str) == sorted(wanted, key=str)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_runs_of_tiles(spark, monkeypatch):
    rng = random.Random(6)
    w = [str(rng.randrange(3000)) for _ in range(5000)]
    w[1000:1600] = w[400:600] * 3
    w[3000:3100] = ["x"] * 100
    w[3500:4700] = w[3500:3900] * 3
    docs = spark.createDataFrame([(1, " ".join(w)), (2, "y " * 3000)], "doc_id bigint, text string")
    wanted = {1: periodic.direct(np.unique(w, return_inverse=True)[1]), 2: [(0, 3000, 1)]}
    assert len(wanted[1]) >= 3
    monkeypatch.setattr(periodic, "TILE_WORDS", 256)
    rows = periodic._scan(None, periodic._whole, [], 500)
    assert rows is not None
    got = {r.doc_id: [(x.start, x.length, x.period) for x in r.runs] for r in periodic.periodic_runs(docs, 500).collect()}
    assert got == wanted


def test_op13_rewrites_one_document_in_ten(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, " ".join(stuttering(rng, 80))) for k in range(80)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()}
    seen = 0
    for k, t in rows:
        w, h = t.split(), zlib.crc32(str(k).encode())
        if h % 10 == 0 and w:
            seen += 1
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        found = all_runs(w)
        gone = {k for a, n, q in found for k in range(a + q, a + n)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(found, key=lambda r: (r[0], r[2])))
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[k] == (len(found), *four, digest(listed), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))
    assert seen


# Operator 3


def test_evolution_beats_best_fit_on_hard_sizes():
    from rankloom.llm import packing

    rng = random.Random(7)
    sizes = [rng.randint(500, 1100) for _ in range(3000)]
    bins, room = [], []
    packing._best_fit(sorted(range(3000), key=lambda i: (-sizes[i], i)), sizes, bins, room, 2048)
    elites = [[], []]
    for epoch in range(packing.EPOCHS):
        found = [packing.evolve(sizes, 10 * i + epoch, 2048, elites[i]) for i in range(2)]
        elites = [[found[i][0], found[1 - i][0]] for i in range(2)]
    places, n = min(found, key=lambda x: x[1])
    fill = np.bincount(places, sizes)
    assert fill.max() <= 2048 and len(fill) == n and (fill > 0).all()
    # Best fit takes 1,258 bins here.
    assert len(bins) == 1258 and n <= 1248
    # Where the first individual reaches the bound there is nothing to do.
    assert packing.evolve([1024] * 100, 1, 2048)[1] == 50 and packing.evolve([], 1, 2048) == ([], 0)
