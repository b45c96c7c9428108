"""Operator 11: passages that repeat across documents, by a depth-limited radix sort of suffixes.

Suffixes (bytes of UTF-8, within one document) are ordered only through their first DEPTH bytes, most significant digit first; those
that then are equal are the repeated windows, all others have dropped out before. The passes:

1. The first digit of a window is its least 16-gram by a hash (leftmost of equal ones), so the windows of a document come in runs with
   one digit, 19 or so each, and only runs are dealt. A digit that one document has alone ends there.
2. Runs of the digits left are dealt with their bytes. Equal runs are one; where a digit has one run only, all its windows are as they
   stand. A digit that very many groups of documents have (HOT) is dealt on by its windows, one by one.
3. Windows of a digit with several runs are sorted by eight bytes at a time through DEPTH; groups of one drop out at each pass.

The smallest doc_id of each window goes back to the documents that have it. Documents are dealt once, into groups of about GROUP_BYTES by a hash of
the row; the three visits to them share that exchange. Between groups and digits' buckets, each group says each run once, whatever number of its
documents hold it: copies don't add to a bucket. Digits and equal runs are compared by 64-bit hashes, windows by their bytes.

Defined results: a null text is empty; rows of one doc_id never take from each other; rows without id count as after
all others; texts under DEPTH bytes stay; columns other than doc_id and text are not looked at. What is kept is bytes: a cut may divide a character.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import documents, mix, run_hashes, text_of, utf8

#: Bytes of a window, and of the gram that is its first digit; grams of a window.
DEPTH, GRAM = 50, 16
GRAMS = DEPTH - GRAM + 1
#: Text of a group of documents, and of a bucket of digits, about. Buckets and groups are as many, and not fewer than a shuffle has partitions.
GROUP_BYTES = 16 << 20
#: Windows looked at in one step; bits of a place within it, which a digit's hash lacks.
STEP, PLACE = 1 << 20, 21
#: A digit that more groups have is dealt on by windows.
HOT = 1 << 14
#: Rows without id come after all others.
LAST = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _steps(values: np.ndarray) -> np.ndarray:
    """Ordered numbers as differences, in half the bytes where they fit."""
    d = np.diff(values, prepend=np.uint64(0))
    return np.concatenate([d[:1].view(np.uint32), d[1:].astype(np.uint32)]) if len(d) and d[1:].max(initial=0) < 1 << 32 else d


def _values(steps: np.ndarray) -> np.ndarray:
    d = np.concatenate([steps[:2].view(np.uint64), steps[2:].astype(np.uint64)]) if steps.dtype == np.uint32 else steps
    return np.cumsum(d, dtype=np.uint64)


def _loads(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, without a copy; raw must be contiguous."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))


def runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of texts, one after the other in raw with bounds at, as runs of one first digit: first and last window, digit, number of the text."""
    out = []
    n, sizes = len(raw), np.diff(at)
    raw = np.concatenate([raw, np.zeros(STEP % 8 + DEPTH + 16, np.uint8)])
    for low in range(0, n, STEP):
        high = min(n, low + STEP)
        part = raw[low : high + DEPTH + 8]
        eight = _loads(part)
        h = eight[:-8] * np.uint64(0x9E3779B97F4A7C15)
        h ^= eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h &= ~np.uint64((1 << PLACE) - 1)
        h |= np.arange(len(h), dtype=np.uint64)
        wide = 1
        while 2 * wide <= GRAMS:
            h = np.minimum(h[:-wide], h[wide:])
            wide *= 2
        if wide < GRAMS:
            h = np.minimum(h[: wide - GRAMS], h[GRAMS - wide :])
        h = h[: high - low]
        a, b = np.searchsorted(at, low, "right") - 1, np.searchsorted(at, high, "left")
        ends = np.repeat(at[a + 1 : b + 1], np.minimum(at[a + 1 : b + 1], high) - np.maximum(at[a:b], low))
        valid = ends - np.arange(low, high) >= DEPTH
        new = valid.copy()
        new[1:] &= (h[1:] != h[:-1]) | ~valid[:-1]
        stop = valid.copy()
        stop[:-1] &= (h[1:] != h[:-1]) | ~valid[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(stop)
        # Least hashes are small ones: mixed again, digits spread evenly over buckets.
        out.append((first + low, last + low, mix(h[first] >> np.uint64(PLACE)) >> np.uint64(PLACE)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, last, digit = (np.concatenate(x) for x in zip(*out, strict=True))
    return first, last, digit, np.repeat(np.arange(len(sizes)), np.diff(np.searchsorted(first, at)))


def _bucket(digit: np.ndarray, buckets: int) -> np.ndarray:
    return (digit >> np.uint64(64 - PLACE - 32)).astype(np.int64) * buckets >> 32


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A group's documents in one order: bytes, bounds, ids."""
    raw, at = utf8(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    ids = table.column("doc_id").to_numpy() if not table.column("doc_id").null_count else table.column("doc_id").fill_null(int(LAST)).to_numpy()
    return raw, at, ids.astype(np.int64)


def _digits(buckets: int):
    """Pass 1, of a group: its digits by bucket, and whether several of its documents have them (lowest bit)."""

    def run(table: pa.Table) -> pa.Table:
        raw, at, _ = _texts(table)
        _, _, digit, doc = runs(raw, at)
        order = np.argsort(digit, kind="stable")
        digit, doc = digit[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], digit[1:] != digit[:-1]])) if len(digit) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:], [len(digit)]])[: len(first)] - 1
        value = digit[first] << np.uint64(1) | (doc[first] != doc[last]).astype(np.uint64)
        cut = np.searchsorted(_bucket(digit[first], buckets), np.arange(buckets + 1))
        found = [(b, pack(_steps(value[x:y]))) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
        group = table.column("group")[0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array([b for b, _ in found], pa.int32()), "group": pa.array([group] * len(found), pa.int32()), "blob": pa.array([x for _, x in found], pa.binary())})

    return run


def _several(hot: int):
    """Pass 1, of a bucket: to each group, those of its digits that other documents have; hot ones with the lowest bit set."""

    def run(table: pa.Table) -> pa.Table:
        groups = table.column("group").to_pylist()
        values = [_values(unpack(x.as_py())[0]) for x in table.column("blob")]
        every = np.concatenate(values)
        order = np.argsort(every >> np.uint64(1), kind="stable")
        digit = every[order] >> np.uint64(1)
        new = np.concatenate([[True], digit[1:] != digit[:-1]])
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [len(digit)]]))
        many = count + np.add.reduceat((every[order] & np.uint64(1)).astype(np.int64), first)
        which = np.empty(len(every), np.int64)
        which[order] = np.cumsum(new) - 1
        marks = np.where(many > 1, np.where(count > hot, 2, 1), 0)[which]
        cut = np.concatenate([[0], np.cumsum([len(v) for v in values])])
        out_groups, blobs = [], []
        for g, v, a, b in zip(groups, values, cut[:-1], cut[1:], strict=True):
            m = marks[a:b]
            if m.any():
                keep = m > 0
                out_groups.append(g)
                blobs.append(pack(_steps((v[keep] >> np.uint64(1) << np.uint64(1)) | (m[keep] == 2).astype(np.uint64))))
        return pa.table({"group": pa.array(out_groups, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _single(first: np.ndarray, last: np.ndarray, digit: np.ndarray, doc: np.ndarray, hot: np.ndarray):
    """Runs of hot digits as their windows, one by one."""
    size = np.where(hot, last - first + 1, 1)
    own = np.repeat(np.arange(len(first)), size)
    place = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    return place, np.where(hot[own], place, last[own]), digit[own], doc[own], hot[own]


def _keys(raw: np.ndarray, first: np.ndarray, last: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """A hash of each run's bytes and digit. Runs are hashed a stretch of text at a time."""
    out = np.empty(len(first), np.uint64)
    for a in range(0, len(raw), STEP):
        x, y = np.searchsorted(first, a), np.searchsorted(first, a + STEP)
        if y > x:
            part = raw[a : int(last[x:y].max()) + DEPTH]
            out[x:y] = run_hashes(part, first[x:y] - a, last[x:y] + DEPTH - a)
    return mix(out + digit * np.uint64(0x9E3779B97F4A7C15))


def _entries(buckets: int):
    """Pass 2, of a group: its runs of the digits left, each once with its bytes and the smallest and largest id."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int32()), "group": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        if not texts.num_rows or not found.num_rows:
            return empty
        raw, at, ids = _texts(texts)
        wanted = np.sort(np.concatenate([_values(unpack(x.as_py())[0]) for x in found.column("blob")]))
        first, last, digit, doc = runs(raw, at)
        place = np.minimum(np.searchsorted(wanted >> np.uint64(1), digit), len(wanted) - 1)
        keep = wanted[place] >> np.uint64(1) == digit
        hot = (wanted[place] & np.uint64(1)).astype(bool)
        first, last, digit, doc, hot = _single(*(x[keep] for x in (first, last, digit, doc, hot)))
        key = _keys(raw, first, last, digit)
        bucket = np.where(hot, _bucket(key >> np.uint64(PLACE), buckets), _bucket(digit, buckets))
        id_ = ids[doc]
        order = np.lexsort((id_, key, bucket))
        key, bucket, id_ = key[order], bucket[order], id_[order]
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])]))
        end = np.concatenate([start[1:], [len(key)]]) - 1
        one, least, most = order[start], id_[start], id_[end]
        size = (last[one] - first[one] + DEPTH).astype(np.int64)
        cut = np.searchsorted(bucket[start], np.arange(buckets + 1))
        group, out = texts.column("group")[0].as_py(), []
        for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if y > x:
                begin = np.repeat(first[one[x:y]], size[x:y]) + np.arange(int(size[x:y].sum())) - np.repeat(np.cumsum(size[x:y]) - size[x:y], size[x:y])
                out.append((b, pack(key[start[x:y]], digit[one[x:y]], hot[one[x:y]], least[x:y], most[x:y], size[x:y].astype(np.uint8), raw[begin])))
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "group": pa.array([group] * len(out), pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    return run


def radix(raw: np.ndarray, start: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that are equal through DEPTH bytes (and have one digit): their numbers, ordered by group, and where the groups begin (with the end as a last entry). Most significant digit first; groups of one drop out at each pass."""
    live, group, eight = np.arange(len(start)), digit, _loads(raw)
    for d in [*range(0, DEPTH - 7, 8), *([DEPTH - 8] if DEPTH % 8 else [])]:
        value = eight[start[live] + d].byteswap()
        order = np.lexsort((value, group))
        live, group, value = live[order], group[order], value[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])]) if len(live) else np.zeros(0, bool)
        alone = new & np.concatenate([new[1:], [True]])[: len(new)]
        group = np.cumsum(new)[~alone]
        live = live[~alone]
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(live) else np.zeros(0, np.int64)
    return live, np.concatenate([edges, [len(live)]])


def _stretches(raw: np.ndarray, begin: np.ndarray, digit: np.ndarray, windows: np.ndarray, smallest: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of the windows of runs that have one smallest id: the run's number, first and last window, id."""
    of = np.repeat(np.arange(len(begin)), windows)
    place = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    own = smallest[of]
    live, edges = radix(raw, begin[of] + place, digit[of])
    if len(live):
        own[live] = np.repeat(np.minimum.reduceat(own[live], edges[:-1]), np.diff(edges))
    at = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (own[1:] != own[:-1])]))
    return number[of[at]], place[at], place[np.concatenate([at[1:], [len(of)]]) - 1], own[at]


def _smallest(table: pa.Table) -> pa.Table:
    """Pass 3, of a bucket: to each group, stretches of its runs' windows with the smallest id that has them, where one of its own is larger."""
    groups = table.column("group").to_pylist()
    parts = [unpack(x.as_py()) for x in table.column("blob")]
    owner = np.repeat(np.arange(len(groups)), [len(p[0]) for p in parts])
    key, digit, hot, least, most, size, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    size = size.astype(np.int64)
    begin = np.cumsum(size) - size
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    smallest = np.full(len(one), LAST)
    np.minimum.at(smallest, which, least)
    # Windows of digits with several runs, some digits at a time.
    by_digit = np.argsort(digit[one], kind="stable")
    d = digit[one][by_digit]
    same = np.concatenate([[False], d[1:] == d[:-1]])
    several = np.zeros(len(one), bool)
    several[by_digit] = same | np.concatenate([same[1:], [False]])
    several &= ~hot[one]
    by_digit = by_digit[several[by_digit]]
    d, windows = digit[one[by_digit]], size[one[by_digit]] - DEPTH + 1
    edges = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    step = (np.concatenate([[0], np.cumsum(windows)])[edges]) // STEP
    edges = np.concatenate([edges[np.concatenate([[True], step[1:] != step[:-1]])], [len(d)]]) if len(d) else [0]
    found = [_stretches(raw, begin[one[r]], digit[one[r]], w, smallest[r], r) for r, w in ((by_digit[x:y], windows[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True))]
    stretch = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 4
    rest = np.flatnonzero(~several)
    stretch = [np.concatenate(x) for x in zip(stretch, [rest, np.zeros(len(rest), np.int64), size[one[rest]] - DEPTH, smallest[rest]], strict=True)]
    order = np.argsort(stretch[0], kind="stable")
    run_, low, high, own = (x[order] for x in stretch)
    first, last = np.searchsorted(run_, which, "left"), np.searchsorted(run_, which, "right")
    mine = np.repeat(np.arange(len(which)), last - first)
    what = np.repeat(first, last - first) + np.arange(len(mine)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
    good = own[what] < most[mine]
    mine, what = mine[good], what[good]
    cut = np.searchsorted(owner[mine], np.arange(len(groups) + 1))
    out = [(g, pack(key[mine[a:b]], digit[mine[a:b][hot[mine[a:b]]]], low[what[a:b]].astype(np.uint8), high[what[a:b]].astype(np.uint8), own[what[a:b]])) for g, a, b in zip(groups, cut[:-1], cut[1:], strict=True) if b > a]
    return pa.table({"group": pa.array([g for g, _ in out], pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})


Finish = Callable[[bytes, list[tuple[int, int]]], list]


def _removed(finish: Finish, fields: list[tuple[str, str, pa.DataType]]):
    """Of a group's documents: the bytes that go, and what finish makes of them."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        raw, at, ids = _texts(texts)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(texts.num_rows)]
        if texts.num_rows and found.num_rows:
            key, hot_digit, low, high, own = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in found.column("blob")), strict=True))
            order = np.argsort(key, kind="stable")
            key, low, high, own = (x[order] for x in (key, low, high, own))
            first, last, digit, doc = runs(raw, at)
            first, last, digit, doc, _ = _single(first, last, digit, doc, np.isin(digit, hot_digit))
            mine = _keys(raw, first, last, digit)
            a, b = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
            which = np.repeat(np.arange(len(mine)), b - a)
            what = np.repeat(a, b - a) + np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
            good = own[what] < ids[doc[which]]
            which, what = which[good], what[good]
            start, end, doc = first[which] + low[what], first[which] + high[what] + DEPTH, doc[which]
            order = np.lexsort((end, start))
            start, end, doc = start[order], end[order], doc[order]
            if len(start):
                # Places of all texts follow each other, and no window leaves its text.
                far = np.maximum.accumulate(end)
                new = np.flatnonzero(np.concatenate([[True], (start[1:] > far[:-1]) | (doc[1:] != doc[:-1])]))
                for k, x, y in zip(doc[new].tolist(), start[new].tolist(), far[np.concatenate([new[1:], [len(far)]]) - 1].tolist(), strict=True):
                    spans[k].append((x - int(at[k]), y - int(at[k])))
        rows = [finish(raw[x:y].tobytes(), s) for x, y, s in zip(at[:-1].tolist(), at[1:].tolist(), spans, strict=True)] if texts.num_rows else []
        columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
        return pa.table({"doc_id": texts.column("doc_id"), **{n: pa.array(c, t) for c, (n, _, t) in zip(columns, fields, strict=True)}})

    return run


def per_document(docs: DataFrame, fields: list[tuple[str, str, pa.DataType]], finish: Finish, groups: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id and the fields (name, Spark type, Arrow type) that finish makes of every row's bytes and the spans of them that go."""
    rows = text_of(docs)
    if groups is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // GROUP_BYTES + 1)
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).repartition(groups, "group")
    blobs = "bucket int, group int, blob binary"
    digits = dealt.groupBy("group").applyInArrow(_digits(groups), blobs)
    several = digits.repartition(groups, "bucket").groupBy("bucket").applyInArrow(_several(hot), "group int, blob binary")
    entries = dealt.groupBy("group").cogroup(several.groupBy("group")).applyInArrow(_entries(groups), blobs)
    smallest = entries.repartition(groups, "bucket").groupBy("bucket").applyInArrow(_smallest, "group int, blob binary")
    own = ", ".join(f"{n} {t}" for n, t, _ in fields)
    return dealt.groupBy("group").cogroup(smallest.groupBy("group")).applyInArrow(_removed(finish, fields), f"doc_id bigint, {own}")


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of a text without spans (in order, apart from each other)."""
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, spans (bytes that go: start, end) and kept (the bytes left) of every row."""
    fields = [("spans", "array<struct<start:bigint,end:bigint>>", _SPANS), ("kept", "binary", pa.binary())]
    return per_document(docs, fields, lambda text, spans: [[{"start": a, "end": b} for a, b in spans], kept_bytes(text, spans)])


def _digest(text: bytes, spans: list[tuple[int, int]]) -> list:
    return [len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(text, spans)).hexdigest()]


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a document of smaller id has in a window of 50 bytes."""
    fields = [(c, "bigint", pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")] + [("kept_sha256", "string", pa.string())]
    return per_document(documents(spark, sf_dir), fields, _digest)


QUERIES = {"op11_repeated_passages": op11_repeated_passages}
SQL: dict[str, str] = {}
