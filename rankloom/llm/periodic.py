"""Operator 13: periodic runs of words, by tiles of each octave of periods.

Words are maximal runs of bytes other than space and the controls 9 to 13. A run is a stretch of words with
smallest period q and length >= max(12, 2 q) that no neighbouring word extends. For each octave of periods,
Q <= q < 2 Q, boundaries stand Q / 2 words apart (two at least). A tile is a boundary with 2 Q words on its left and
4 Q on its right, so neighbouring tiles overlap. Words i with word[i] = word[i + q] come in streaks; a run's streak
has length - q >= max(q, 12 - q) words, so the first boundary in it is followed by five of them at least, and five
equal words a period apart make a candidate. For candidates the tile's two Z-functions at the boundary (how far the text from it
and the text a period later agree, forwards and backwards, no further than the tile) give a fragment of the streak.
Fragments shorter than a run's streak belong to no run; those with a smaller period that divides q belong to a run of that period,
which shows in any 2 q words. All others are fragments of runs: they are shuffled by document and period and stitched where they touch.

Documents of up to LONG_WORDS words are cut into tiles and solved in place; the tiles of longer ones that hold a
candidate become rows that are dealt out, so one long document is no task's burden. Only documents with fragments move.

Texts' words are compared by 64-bit hashes; the runs found are compared word by word at the end, and a document for which that
fails (never seen) is solved by direct comparison of all periods.

Defined results: null or blank text has no words, no runs and an empty text; repeated rows each get their
result; rows without id are left as they are by the query's rewriting; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import _powers, documents, mix, reliable, run_hashes, slices, text_of, utf8, words

#: A run has so many words at least.
LEAST = 12
#: Equal words a period apart that make a candidate: after the first boundary in a run's streak there are so many at least.
SEED = 5
#: Documents with more words go through tiles as rows; words of such a tile, at least.
LONG_WORDS, TILE_WORDS = 1 << 13, 1 << 12
#: Candidates looked at in one step.
STEP = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _same(sums: np.ndarray, power: np.ndarray, i: np.ndarray, j: np.ndarray, m) -> np.ndarray:
    """Whether the m words from i equal those from j >= i, by their hashes."""
    return (sums[i + m] - sums[i]) * power[j - i] == sums[j + m] - sums[j]


def _reach(sums, power, i, j, limit, cap: int, back: bool) -> np.ndarray:
    """How far the words from i and from j agree (back: before them), limit at most."""
    far, m = np.zeros(len(i), np.int64), cap
    while m:
        may = np.flatnonzero(far + m <= limit)
        shift = -(far[may] + m) if back else far[may]
        far[may[_same(sums, power, i[may] + shift, j[may] + shift, m)]] += m
        m >>= 1
    return far


def _factors(q: np.ndarray) -> Iterator[np.ndarray]:
    """The prime factors of each number, one after the other; 1 where there are no more."""
    least = np.arange(int(q.max(initial=1)) + 1)
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            multiples = least[p * p :: p]
            np.minimum(multiples, p, out=multiples)
    rest = q.copy()
    while (rest > 1).any():
        yield least[rest]
        rest //= least[rest]


def merged(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of a group (numbers from 0) that overlap or touch, as one."""
    if not len(group):
        return group, start, end
    order = np.lexsort((end, start, group))
    group, start, end = group[order], start[order], end[order]
    span = int(end.max()) + 1
    furthest = np.maximum.accumulate(group * span + end) - group * span
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > furthest[:-1])])
    first = np.flatnonzero(new)
    return group[first], start[first], np.maximum.reduceat(end, first)


def octaves(n: int) -> list[int]:
    """The least periods of the octaves that a document of n words can have runs in."""
    return [1 << o for o in range(max(0, (n // 2).bit_length()))] if n >= LEAST else []


class Solver:
    """The tiles of some documents: word hashes one after the other, and where each document begins (with the end as a last entry)."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray) -> None:
        n = len(hashes)
        self.at, self.power = at, _powers(n + 1)[0]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hashes + np.uint64(1)) * self.power[:n], out=self.sums[1:])
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        # The hash of SEED words from each word on; where a document has fewer left, a value of its own.
        self.seeds = mix(np.arange(n, dtype=np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        whole = np.flatnonzero(np.arange(n) + SEED <= at[1:][self.doc])
        inverse = _powers(n + 1)[1]
        self.seeds[whole] = mix((self.sums[whole + SEED] - self.sums[whole]) * inverse[whole])

    def candidates(self, low: int, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Boundaries and periods of the octave from low with SEED equal words; boundaries lie in each document from word first up to last."""
        step = max(2, low // 2)
        begin, end = self.at[:-1], self.at[1:]
        first = -(-first // step) * step
        count = np.maximum(0, -(-(np.minimum(begin + last, end - low - SEED + 1) - begin - first) // step))
        if not (total := int(count.sum())):
            return
        number = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        bounds = np.repeat(begin + first, count) + number * step
        padded = np.concatenate([self.seeds, np.zeros(2 * low, np.uint64)])
        rows = sliding_window_view(padded, low)
        some = max(1, STEP // low)
        for k in range(0, total, some):
            c = bounds[k : k + some]
            i, more = np.nonzero(rows[c + low] == self.seeds[c][:, None])
            c, q = c[i], low + more
            inside = c + q + SEED <= end[self.doc[c]]
            if inside.any():
                yield c[inside], q[inside]

    def fragments(self, low: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, period, and start and end of the streak of each fragment of a run, by tiles; those of a document and period that touch as one."""
        found, cap = [], max(16, 2 * low)
        for c, q in self.candidates(low, first, last):
            begin, end = self.at[:-1][self.doc[c]], self.at[1:][self.doc[c]]
            after = _reach(self.sums, self.power, c, c + q, np.minimum(cap, end - c - q), cap, False)
            before = _reach(self.sums, self.power, c, c + q, np.minimum(cap, c - begin), cap, True)
            long = after + before >= np.maximum(q, LEAST - q)
            c, q, after, before, begin = c[long], q[long], after[long], before[long], begin[long]
            start, own = c - before, np.ones(len(c), bool)
            for factor in _factors(q):
                k = np.flatnonzero(own & (factor > 1))
                p = q[k] // factor[k]
                own[k[_same(self.sums, self.power, start[k], start[k] + p, 2 * q[k] - p)]] = False
            found.append(np.stack([self.doc[c], q, start - begin, c + after - begin])[:, own])
        doc, q, start, end = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        group, start, end = merged(doc * (2 * low) + q, start, end)
        return group // (2 * low), group % (2 * low), start, end


def direct(w: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, length and period of the runs of one text's words (numbers), by comparing all words for every period."""
    found: list[tuple[int, int, int]] = []
    for q in range(1, len(w) // 2 + 1):
        edge = np.diff(np.concatenate([[0], (w[q:] == w[:-q]).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            inner = any(q % p == 0 and s <= a and s + n >= b + q for s, n, p in found)
            if b - a + q >= max(LEAST, 2 * q) and not inner:
                found.append((a, b - a + q, q))
    return sorted((a, n, q) for a, n, q in found)


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rewriting of one document in ten: which word stands at each of n places; None leaves the text as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    a, i = h // 10 % n, np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + h // 10 % 8)))


def _confirmed(text: bytes, runs: list[tuple[int, int, int]]) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """A text's words, and its runs (start, length, period) in order, each compared word by word."""
    parts = text.split()
    if runs:
        number: dict[bytes, int] = {}
        w = np.array([number.setdefault(p, len(number)) for p in parts])
        for s, n, q in runs:
            ends = (s == 0 or w[s - 1] != w[s - 1 + q]) and (s + n == len(w) or w[s + n] != w[s + n - q])
            if not ends or (w[s : s + n - q] != w[s + q : s + n]).any():
                return parts, direct(w)
    return parts, sorted(runs)


def collapsed(parts: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(parts)
    keep = np.ones(len(parts), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    return b" ".join(parts[i] for i in np.flatnonzero(keep))


#: What the scan hands on: documents without fragments, documents with fragments, fragments, tiles.
DONE, OPEN, PART, TILE = range(4)
_SCAN = "key bigint, kind int, words binary, period bigint, start bigint, end bigint, first bigint, last bigint, hashes array<bigint>"
_NAMES = [x.split()[0] for x in _SCAN.split(", ")]
_ARROW = dict(zip(_NAMES, [pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 5, pa.list_(pa.int64())], strict=True))

Finish = Callable[[list[bytes], list[tuple[int, int, int]]], list]


def _scan(rewrite, finish: Finish, fields: list[tuple[str, str, pa.DataType]], long_words: int):
    def batch_of(ids, keys, values: dict, made: list[list] | None = None) -> pa.RecordBatch:
        n = len(keys)
        own = [pa.array(made[k] if made else [None] * n, t) for k, (_, _, t) in enumerate(fields)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(values.get(x, keys if x == "key" else [None] * n), _ARROW[x]) for x in _NAMES), *own], ["doc_id", *_NAMES, *(f[0] for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, keys, texts = (part.column(c).to_pylist() for c in ("doc_id", "key", "text"))
                raw, at = utf8(part.column("text"))
                starts, ends, first = words(raw, at, _SPACE)
                hashes = run_hashes(raw, starts, ends)
                texts = [(t or "").encode() for t in texts]
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if rewrite and (to := rewrite(ids[k], b - a)) is not None:
                        hashes[a:b] = hashes[a:b][to]
                        texts[k] = texts[k].split()
                        texts[k] = b" ".join(texts[k][i] for i in to.tolist())
                solver, n = Solver(hashes, first), np.diff(first)
                parts, tiles, none = [], [], np.zeros(len(n), np.int64)
                for low in octaves(int(n.max(initial=0))):
                    short = np.where((n <= long_words) & (n >= 2 * low), n, 0)
                    parts.append(np.stack(solver.fragments(low, none, short)))
                    size = max(TILE_WORDS, 8 * low)
                    for c, _ in solver.candidates(low, none, np.where((n > long_words) & (n >= 2 * low), n, 0)):
                        tiles += {(low, int(d), int(t) * size) for d, t in zip(solver.doc[c], (c - first[solver.doc[c]]) // size, strict=True)}
                doc, q, s, e = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
                open_ = np.zeros(len(n), bool)
                open_[doc] = True
                open_[[d for _, d, _ in tiles]] = True
                done, held = np.flatnonzero(~open_).tolist(), np.flatnonzero(open_).tolist()
                yield batch_of([ids[k] for k in done], [keys[k] for k in done], {"kind": [DONE] * len(done)}, list(map(list, zip(*[finish(texts[k].split(), []) for k in done], strict=True))) or None)
                if held:
                    yield batch_of([ids[k] for k in held], [keys[k] for k in held], {"kind": [OPEN] * len(held), "words": [texts[k] for k in held]})
                if len(doc):
                    yield batch_of([ids[k] for k in doc], [keys[k] for k in doc], {"kind": [PART] * len(doc), "period": q, "start": s, "end": e})
                for low, d, a in dict.fromkeys(tiles):
                    # The tile's words, with what its first and last boundary look at.
                    size, pad = max(TILE_WORDS, 8 * low), max(16, 2 * low)
                    x, y = max(0, a - pad), min(int(n[d]), a + size + pad + 2 * low)
                    held_words = hashes[first[d] + x : first[d] + y].view(np.int64)
                    yield batch_of([ids[d]], [keys[d]], {"kind": [TILE], "period": [low], "start": [x], "first": [a - x], "last": [a + size - x], "hashes": [held_words]})

    return run


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of the tiles of long documents. A tile that begins within a document has its boundaries where the document has them."""
    for batch in batches:
        for k in range(batch.num_rows):
            doc_id, key, low, start, first, last, values = (batch.column(c)[k] for c in ("doc_id", "key", "period", "start", "first", "last", "hashes"))
            hashes = values.values.to_numpy().view(np.uint64)
            solver = Solver(hashes, np.array([0, len(hashes)]))
            _, q, s, e = solver.fragments(low.as_py(), np.array([first.as_py()]), np.array([last.as_py()]))
            n, begin = len(q), start.as_py()
            yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * n, pa.int64()), pa.array([key.as_py()] * n, pa.int64()), *(pa.array(x, pa.int64()) for x in (q, s + begin, e + begin))], ["doc_id", "key", "period", "start", "end"])


def per_document(docs: DataFrame, fields: list[tuple[str, str, pa.DataType]], finish: Finish, rewrite=None, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id and the fields (name, Spark type, Arrow type) that finish makes of every row's words and runs (start, length, period; in order). rewrite(doc_id, n words) may give the places that the words are taken from."""
    rows = text_of(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    own = ", ".join(f"{n} {t}" for n, t, _ in fields)
    scanned = reliable(rows.mapInArrow(_scan(rewrite, finish, fields, long_words), f"doc_id bigint, {_SCAN}, {own}"))
    tiles = scanned.filter(F.col("kind") == TILE).select("doc_id", "key", "period", "start", "first", "last", "hashes").repartition("key", "period", "start")
    solved = tiles.mapInArrow(_solve, "doc_id bigint, key bigint, period bigint, start bigint, end bigint")
    parts = scanned.filter(F.col("kind") == PART).select("doc_id", "key", "period", "start", "end").unionByName(solved)
    # Repeated rows have the same fragments: once each.
    parts = parts.groupBy("key", "period", "start", "end").agg(F.count("*").alias("n"))
    order = W.partitionBy("key", "period").orderBy("start", "end")
    furthest = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = parts.withColumn("new", F.when(F.col("start") <= furthest, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = islands.groupBy("key", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.select("key", F.struct("start", (F.col("end") - F.col("start") + F.col("period")).alias("length"), "period").alias("run"))
    runs = runs.groupBy("key").agg(F.collect_list("run").alias("runs"))
    held = scanned.filter(F.col("kind") == OPEN).select("doc_id", "key", "words").join(runs, "key", "left")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, found in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                made.append(finish(*_confirmed(text, [(r["start"], r["length"], r["period"]) for r in found or []])))
            columns = list(zip(*made, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, (_, _, t) in zip(columns, fields, strict=True))], ["doc_id", *(f[0] for f in fields)])

    ended = held.select("doc_id", "words", "runs").mapInArrow(last, f"doc_id bigint, {own}")
    return scanned.filter(F.col("kind") == DONE).select("doc_id", *(f[0] for f in fields)).unionByName(ended)


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _whole(parts: list[bytes], runs: list[tuple[int, int, int]]) -> list:
    return [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapsed(parts, runs).decode()]


def periodic_runs(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, runs (in order: start, length and period, in words) and collapsed, the text with each run cut to its first period, of every row."""
    return per_document(docs, [("runs", "array<struct<start:bigint,length:bigint,period:bigint>>", _RUN), ("collapsed", "string", pa.string())], _whole, long_words=long_words)


def _digest(parts: list[bytes], runs: list[tuple[int, int, int]]) -> list:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    four = [best[0], best[1], best[2], 1000 * best[1] // best[2]] if best else [None] * 4
    return [len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(parts, runs)).hexdigest()]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, one document in ten rewritten to end in repetitions."""
    fields = [(c, "bigint", pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")] + [(c, "string", pa.string()) for c in ("runs_sha256", "collapsed_sha256")]
    fields[1:5] = [(f"best_{n}", t, a) for n, t, a in fields[1:5]]
    out = per_document(documents(spark, sf_dir), fields, _digest, rewritten)
    return out.withColumnsRenamed({f"best_{c}": c for c in ("start", "length", "period", "exponent_milli")})


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
SQL: dict[str, str] = {}
