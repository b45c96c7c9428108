"""Operator 10: exact n-gram Jaccard join by set-relation skipping.

A document's set holds the hashes of its distinct word n-grams. Documents with equal sets form a class
and are linked at once; a task indexes each class that it meets once. The sets are indexed by prefixes:
under one global order of n-grams (frequent ones last), two sets that reach the threshold share one of
their first n - ceil(t * n) + 1, and the first that they share stands so early in both that the overlap
needed still fits behind it. Each index list is ordered by set size and position, so that blocks of it
are skipped: those whose size is out of reach, and those whose position leaves too few n-grams.

A sketch goes with each entry: SKETCH bits, each the parity of the number of the set's n-grams that fall
on it. Two sketches differ in no more bits than the sets differ in n-grams, which bounds the overlap from
above: pairs whose bound is too low are left out within the list, before a row is made of them. A
document keeps a sketch in proportion to its set as well, of which that one is folded; it judges the pairs found
before their sets are fetched. The sets of those that remain are compared in full.

Answers are derived from those of similar sets: as soon as a set is verified to be linked to another,
it takes over that one's answer, its component. A round compares each entry with the WINDOW before it in
its list and with the first ones in reach, and verifies, for each document, the likeliest partner found, as long as that joins components. Then every pair of entries across
components is judged, and named only by the first of the lists that both sets are known to share. No pair inside
a component is looked at, so a group of near copies costs a few pairs per set.

Lists of n-grams that occur more than LIST_MOST times are dealt out in blocks: in a round, each block stands
for itself; then, a list's entries outside its largest component meet all others, block by block.

Which n-grams count as frequent changes the order and so the cost, never the result.

Defined results: null, empty or blank text has an empty set and links with nothing; fewer words than n
are one n-gram; rows of equal ids are one document, which links where one of their texts does, and each row is
returned; rows without id link with nothing and have no component. Other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import documents, gathered, mix, reliable, run_hashes, runs, slices, text_of, utf8, words
from rankloom.llm.components import components

#: Words of an n-gram; the threshold as a percentage.
WORDS, PERCENT = 4, 85
#: A task hands on n-grams that occur so often among so many; so often in all are ordered last, so many at most.
LOCAL_LEAST, LOCAL_GRAMS, HOT_LEAST, HOT_MOST = 2, 2_000_000, 6, 400_000
#: Classes that a task remembers to have indexed, before it forgets them all (copies met after that are indexed again).
SEEN_MOST = 1 << 20
#: Entries of an index list that one task takes; longer lists are dealt out in blocks.
LIST_MOST = 20_000
#: Entries of its list, before it and at the list's beginning, with which a round compares an entry; rounds at most before all pairs across
#: components are judged; partners of a document that a round judges; how much chance shifts the share of differing bits in later rounds.
WINDOW, ROUNDS, PARTNERS, CHANCE = 64, 2, 12, 0.02
#: First n-grams of a document's entries, by which a pair is left to an earlier list.
FIRST = tuple(f"first{i}" for i in range(4))
#: Words of 64 bits of a set's sketch in the index.
SKETCH = tuple(f"sketch{w}" for w in range(4))
#: Bits for each n-gram of the sketch by which found pairs are judged.
FINE = 4
#: log2 of the bits of the filter of documents whose sets are fetched.
FILTER_BITS = 23
PAIRS_AT_ONCE = 1 << 18

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text in order, one text after the other, and where each text's begin."""
    raw, at = utf8(texts)
    raw = _LOWER[raw]
    starts, ends, first = words(raw, at, _SPACE)
    h = run_hashes(raw, starts, ends)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    found, rows = [], []
    t = mix(h + _STEP)
    for n in range(1, k + 1):
        if n > 1:
            t = mix(h[: max(0, len(h) - n + 1)] + t[1:] * _STEP)
        begins = np.arange(len(t))
        if n < k:
            begins = first[:-1][count == n]
        else:
            begins = begins[owner[: len(t)] == owner[n - 1 : n - 1 + len(t)]]
        found.append(t[begins] + np.uint64(n))
        rows.append(owner[begins])
    grams, rows = np.concatenate(found), np.concatenate(rows)
    order = np.argsort(grams, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    grams, rows = grams[order], rows[order]
    if len(grams):
        fresh = np.concatenate([[True], (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])])
        grams, rows = grams[fresh], rows[fresh]
    return grams, np.searchsorted(rows, np.arange(len(count) + 1))


def _sum_per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[at[1:]] - sums[at[:-1]]


def _sketches(grams: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[bytes]]:
    """The words of each set's sketch (on each bit the parity of the n-grams that fall on it), and a sketch of at least FINE bits for each n-gram, of which the first is folded."""
    place = (mix(grams + _STEP) >> np.uint64(32)).astype(np.int64)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    coarse = 64 * len(SKETCH)
    words_ = np.packbits((np.bincount(row * coarse + (place & (coarse - 1)), minlength=len(n) * coarse) & 1).astype(np.uint8), bitorder="little").view(np.int64).reshape(len(n), len(SKETCH))
    bits = np.maximum(coarse, 1 << np.ceil(np.log2(np.maximum(FINE * n, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(bits)])
    fine = np.packbits((np.bincount(begin[row] + (place & (bits[row] - 1)), minlength=begin[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return list(np.ascontiguousarray(words_.T)), [fine[a:b] for a, b in zip(begin[:-1] // 8, begin[1:] // 8, strict=True)]


def _hashes(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    return _sum_per_row(grams, at).view(np.int64), _sum_per_row(mix(grams ^ _STEP), at).view(np.int64)


def _profiled(docs: DataFrame, k: int) -> DataFrame:
    """For each document: id, set size, two hashes of the set and its sketches; for n-grams frequent in a task (kind 1): n-gram and count."""
    names = ["kind", "id", "n", "h1", "h2", *SKETCH, "fine"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def frequent() -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LOCAL_LEAST
            g, n = g[often].view(np.int64), n[often]
            zero = np.zeros(len(g), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(g), np.int32)), pa.array(g), pa.array(n.astype(np.int64)), *[pa.array(zero)] * (2 + len(SKETCH)), pa.nulls(len(g), pa.binary())], names)

        for batch in batches:
            for part in slices(batch, "text"):
                grams, at = shingle_sets(part.column("text"), k)
                held.append(grams)
                size += len(grams)
                coarse, fine = _sketches(grams, at)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), np.int32)), part.column("doc_id"), pa.array(np.diff(at)), *map(pa.array, _hashes(grams, at)), *map(pa.array, coarse), pa.array(fine, pa.binary())], names)
                if size >= LOCAL_GRAMS:
                    yield frequent()
                    held, size = [], 0
        if held:
            yield frequent()

    return docs.mapInArrow(run, "kind int, " + ", ".join(f"{c} bigint" for c in names[1:-1]) + ", fine binary")


def _indexed(docs: DataFrame, k: int, percent: int, hot: np.ndarray, blocks: np.ndarray) -> DataFrame:
    """gram, block, blocks, doc_id, h1, n, pos: the prefix of each set under the order (frequency, hash), sets that a task has met before left out. hot: frequent n-grams, the rarest first; blocks: how many their lists have."""
    order = np.argsort(hot, kind="stable")
    held = docs.sparkSession.sparkContext.broadcast((hot[order], order.astype(np.int64) + 1, blocks[order]))
    names = ["gram", "block", "blocks", "doc_id", "h1", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, many = held.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                grams, at = shingle_sets(part.column("text"), k)
                doc = part.column("doc_id").to_numpy()
                n = np.diff(at)
                h1, h2 = _hashes(grams, at)
                keep = np.zeros(len(n), bool)
                for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                    if key not in seen:
                        keep[i] = True
                        seen.add(key)
                if len(seen) > SEEN_MOST:
                    seen.clear()
                row = np.repeat(np.arange(len(n)), n)
                last, split = np.zeros(len(grams), np.int64), np.ones(len(grams), np.int32)
                if len(known):
                    p = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    same = known[p] == grams
                    last, split = np.where(same, rank[p], 0), np.where(same, many[p], 1).astype(np.int32)
                    moved = np.lexsort((last, row))
                    grams, split = grams[moved], split[moved]
                pos = np.arange(len(grams)) - at[:-1][row]
                prefix = n - -(-percent * n // 100) + 1
                use = keep[row] & (pos < prefix[row])
                row, pos, split = row[use], pos[use], split[use]
                block = (mix(h1.view(np.uint64))[row] % split.astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(grams[use].view(np.int64)), pa.array(block), pa.array(split), pa.array(doc[row]), pa.array(h1[row]), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32))], names)

    return docs.mapInArrow(run, "gram bigint, block int, blocks int, doc_id bigint, h1 bigint, n int, pos int")


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the highest counts and these, the rarest first: all of a count or none, as far as they are HOT_MOST at most."""
    counts = gathered(counts)
    total, least = 0, None
    for n, k in sorted(((r[0], r[1]) for r in counts.groupBy("n").count().collect()), reverse=True):
        total += k
        if total > HOT_MOST:
            break
        least = n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.filter(F.col("n") >= least).toPandas().sort_values(["n", "id"])
    return found["id"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)


def _shared(rows: DataFrame) -> DataFrame:
    """The entries of index lists that hold two sets at least; of equal sets one in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["gram", "block"]):
            g, block, h = (table.column(c).to_numpy() for c in ("gram", "block", "h1"))
            same = (g[1:] == g[:-1]) & (block[1:] == block[:-1])
            fresh = np.concatenate([[True], ~same | (h[1:] != h[:-1])])
            other = np.concatenate([[False], same & fresh[1:]])
            list_no = np.cumsum(np.concatenate([[0], ~same]))
            shared = np.bincount(list_no[other], minlength=list_no[-1] + 1)[list_no] > 0
            yield from table.filter(pa.array(fresh & (shared | (table.column("blocks").to_numpy() > 1)))).to_batches()

    return rows.repartition("gram", "block").sortWithinPartitions("gram", "block", "h1", "n", "doc_id").mapInArrow(run, rows.schema)


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The overlap from which sets of a and b n-grams reach the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def _sketched(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in SKETCH], 1).view(np.uint64)


def _apart(sketch: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64)


def _may_reach(apart: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the overlap of sets of a and b n-grams can be as large as needed, where so many bits of their sketches differ."""
    return a + b - apart >= 2 * _needed(a, b, percent)


def _partner_most(n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """The largest size of a set whose overlap with a set of n n-grams can be as large as needed, if their first common one stands at pos."""
    return (n - pos) * (100 + percent) // percent - n


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """A number for each run of equal keys."""
    return np.cumsum(np.concatenate([[0], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])) if len(keys[0]) else np.zeros(0, np.int64)


def _pairs(list_no: np.ndarray, n: np.ndarray, pos: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, percent: int, first: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs x, y of a list's entries, y in of, x from start to end (given for each of; so many of the first ones in reach), that size and position let link; about PAIRS_AT_ONCE at a time."""
    # A list is ordered by size: the entries in reach of one are a block, which its position cuts off above.
    spread = int(n.max()) * 2 + 2 if len(n) else 1
    at = list_no * spread + n
    low = np.maximum(start, np.searchsorted(at, list_no[of] * spread + -(-percent * n[of] // 100)))
    most = np.minimum(np.minimum(100 * n[of] // percent, _partner_most(n[of], pos[of], percent)), spread - 1)
    high = np.minimum(end, np.searchsorted(at, list_no[of] * spread + np.maximum(most, 0), "right"))
    many = np.maximum((high if first is None else np.minimum(high, low + first)) - low, 0)
    ends = np.cumsum(many)
    s = 0
    while s < len(many):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIRS_AT_ONCE, "right")))
        y = np.repeat(of[s:e], many[s:e])
        x = np.repeat(low[s:e] - (ends[s:e] - many[s:e] - (ends[s - 1] if s else 0)), many[s:e]) + np.arange(len(y))
        need = _needed(n[x], n[y], percent)
        use = np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need
        yield x[use], y[use]
        s = e


def _candidates(index: DataFrame, percent: int, no: int) -> DataFrame:
    """doc, other: for each entry its likeliest partners in another component, one among the WINDOW entries before it and one among the first WINDOW in reach (those of small positions, which differ from others least), judged by size, position and sketch; in rounds after the first with some chance, so that not the same ones fail again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["gram", "block"]):
            gram, block, doc, n, pos, comp = (table.column(c).to_numpy().astype(np.int64) for c in ("gram", "block", "doc_id", "n", "pos", "comp"))
            sketch, list_no, every = _sketched(table), _numbered(gram, block), np.arange(len(gram))
            near = _pairs(list_no, n, pos, every - WINDOW, every, every, percent)
            central = _pairs(list_no, n, pos, np.zeros_like(every), every - WINDOW, every, percent, WINDOW)
            for x, y in chain(near, central):
                use = comp[x] != comp[y]
                x, y = x[use], y[use]
                apart = _apart(sketch, x, y)
                use = _may_reach(apart, n[x], n[y], percent)
                x, y, apart = x[use], y[use], apart[use]
                chance = (mix((doc[x] ^ (doc[y] << 20) ^ (no << 50)).view(np.uint64)) >> np.uint64(40)) / float(1 << 24)
                order = np.lexsort((doc[x], apart / (n[x] + n[y]) + (CHANCE * chance if no else 0), y))
                x, y = x[order], y[order]
                best = np.flatnonzero(np.diff(y, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(doc[y[best]]), pa.array(doc[x[best]])], ["doc", "other"])

    return _by_list(index, "block").mapInArrow(run, "doc bigint, other bigint")


def _best(found: DataFrame, told: DataFrame, percent: int) -> DataFrame:
    """a, b: each document with its likeliest partner of the PARTNERS that most of its lists name, judged by sketches in proportion to the sets."""
    per = found.groupBy("doc", "other").agg(F.count("*").alias("c"))
    # As many partners as a document has entries, twice, at most.
    few = per.groupBy("doc").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "other"))), 1, PARTNERS).alias("best"))
    pairs = few.select("doc", F.explode("best.other").alias("other")).select(F.col("doc").alias("a"), F.col("other").alias("b"))
    best = _likely(reliable(pairs), told, percent).groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _dealt(index: DataFrame, most: int) -> DataFrame:
    """The index with the columns place and side: entries are to meet at a place of their list, those of side 0 all others there, those of sides 1 and 2 each other.

    Short lists are one place. Of a long list, blocks of its largest component meet blocks of the rest, and
    these one another; with one component alone it is left out.
    """
    short = index.filter("blocks = 1").withColumns({"place": F.lit(0).cast("bigint"), "side": F.lit(0)})
    long = index.filter("blocks > 1")
    per = long.groupBy("gram", "comp").agg(F.count("*").alias("c")).groupBy("gram").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"))
    per = per.filter(F.col("all") > F.col("top.c")).select("gram", F.col("top.comp").alias("main"), F.ceil(F.col("top.c") / most).alias("mains"), F.ceil((F.col("all") - F.col("top.c")) / most).alias("rests"))
    at = lambda n: F.pmod(F.xxhash64("doc_id", "h1"), F.col(n))
    place = lambda kind, i, j: ((F.lit(kind).cast("bigint") * (1 << 30) + i) * (1 << 30) + j)
    spot = lambda p, side: F.struct(p.alias("place"), side.cast("int").alias("side"))
    other = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    main = F.transform(other("rests"), lambda j: spot(place(1, at("mains"), j), F.lit(1)))
    rest = F.transform(other("mains"), lambda i: spot(place(1, i, at("rests")), F.lit(2)))
    both = F.transform(other("rests"), lambda j: spot(place(2, F.least(at("rests"), j), F.greatest(at("rests"), j)), F.when(j == at("rests"), 0).when(j > at("rests"), 1).otherwise(2)))
    spots = F.when(F.col("comp") == F.col("main"), main).otherwise(F.concat(rest, both))
    met = long.join(per, "gram").select(*index.columns, F.explode(spots).alias("spot")).select(*index.columns, "spot.*")
    return short.unionByName(met)


def _across(index: DataFrame, percent: int, most: int) -> DataFrame:
    """a, b: all pairs of a list's entries in different components that may be linked, judged by size, position and sketch, unless one of the FIRST n-grams of both stands before this list's and so names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["gram", "place"]):
            gram, place, doc, n, pos, comp, side = (table.column(c).to_numpy().astype(np.int64) for c in ("gram", "place", "doc_id", "n", "pos", "comp", "side"))
            sketch, list_no = _sketched(table), _numbered(gram, place)
            first = np.stack([table.column(c).to_numpy() for c in FIRST], 1)
            # A first n-gram counts where it stands before this list's: as long as the entry's own is not met among them.
            counts = np.logical_and.accumulate(first != gram[:, None], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(list_no)) + 1, [len(gram)]])
            comp_no = np.unique(comp, return_inverse=True)[1]
            kind, inverse, often = np.unique(list_no * len(comp) + comp_no, return_inverse=True, return_counts=True)
            by = np.lexsort((kind, -often, kind // len(comp)))
            top = np.zeros(len(kind), bool)
            top[by[np.flatnonzero(np.diff(kind[by] // len(comp), prepend=-1))]] = True
            rest = ~top[inverse]
            of = np.flatnonzero(rest)
            for x, y in _pairs(list_no, n, pos, cuts[:-1][list_no[of]], cuts[1:][list_no[of]], of, percent):
                use = (comp[x] != comp[y]) & (~rest[x] | (x < y)) & ((side[x] == 0) | (side[y] == 0) | (side[x] != side[y]))
                x, y = x[use], y[use]
                near = _may_reach(_apart(sketch, x, y), n[x], n[y], percent)
                x, y = x[near], y[near]
                named = np.zeros(len(x), bool)
                for i in range(len(FIRST)):
                    for j in range(len(FIRST)):
                        named |= counts[x, i] & counts[y, j] & (first[x, i] == first[y, j])
                x, y = x[~named], y[~named]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[x], doc[y])), pa.array(np.maximum(doc[x], doc[y]))], ["a", "b"])

    around = W.partitionBy("doc_id", "h1", "n").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    named = index.withColumns({c: F.coalesce(F.nth_value("gram", i + 1).over(around), F.col("gram")) for i, c in enumerate(FIRST)})
    return _by_list(_dealt(named, most), "place").mapInArrow(run, "a bigint, b bigint").distinct()


def _by_list(index: DataFrame, part: str) -> DataFrame:
    return index.repartition("gram", part).sortWithinPartitions("gram", part, "n", "pos", "doc_id")


def _bitmap(ids: DataFrame, column: str) -> bytes:
    """A filter of fixed size with the bits of all ids; only its words reach the driver."""
    bit = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    rows = ids.select((bit / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 32).cast("int")).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).collect()
    words_ = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for w, m in rows:
        words_[w] = m
    return words_.tobytes()


def _fetched(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id, grams: the sets of the wanted documents, from another scan of the texts."""
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, "doc_id"))
    marked = docs.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint32)
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((bits[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1))
            for part in slices(batch, "text"):
                grams, at = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([grams[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["doc_id", "grams"])

    return marked.mapInArrow(run, "doc_id bigint, grams binary").join(wanted, "doc_id", "left_semi").dropDuplicates()


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch with fewer bits."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), 0)


def _likely(pairs: DataFrame, told: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that may be linked, judged by sketches in proportion to the sets, and the bits in which these differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = []
            for x, y in zip(batch.column("fine_a"), batch.column("fine_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                size = min(len(x), len(y))
                apart.append(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum(dtype=np.int64)))
            apart = np.array(apart, np.int64)
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            near = _may_reach(apart, n_a, n_b, percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart / (n_a + n_b))], ["a", "b", "apart"]).filter(pa.array(near, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = told.filter("kind = 0 and n > 0 and id is not null").join(wanted, "id", "left_semi").dropDuplicates(["id", "h1", "n"])
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint, apart double").groupBy("a", "b").agg(F.min("apart").alias("apart"))


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """src, dst: the pairs a, b whose sets reach the threshold. Only the sets of these pairs' documents are fetched."""
    pairs = reliable(pairs.select("a", "b"))
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = reliable(_fetched(docs, wanted, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ga"), batch.column("gb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) < len(y) else (y, x)
                p = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[p] == x).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    sets = sets.filter(F.length("grams") > 0)
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b")
    return both.select("a", "b", "ga", "gb").mapInArrow(run, "src bigint, dst bigint").distinct()


def _labelled(index: DataFrame, sketches: DataFrame, found: DataFrame) -> DataFrame:
    """The index with each entry's component and sketch."""
    docs = sketches.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return index.join(docs.withColumn("comp", F.coalesce("component", "doc_id")).drop("component"), ["doc_id", "h1", "n"])


def ngram_join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, rounds: int = ROUNDS, list_most: int = LIST_MOST) -> DataFrame:
    """doc_id, n_shingles, component_id of all rows with doc_id and text."""
    docs = text_of(docs)
    told = reliable(_profiled(docs, k))
    profile = told.filter("kind = 0").select(F.col("id").alias("doc_id"), "n", "h1", "h2")
    hot, often = _frequent(told.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_LEAST))
    keys = ["n", "h1", "h2"]
    # Written first, so that the join's skewed side (a class of many copies) can be split.
    classes = gathered(profile.filter("n > 0 and doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"))
    known = docs.filter("doc_id is not null")
    index = reliable(_shared(_indexed(known, k, percent, hot, -(-often // list_most))))
    same = profile.join(classes, keys).select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    edges = gathered(same.filter("src <> dst"))
    found = components(edges)
    sketches = told.filter("kind = 0 and n > 0 and id is not null").groupBy(F.col("id").alias("doc_id"), "h1", F.col("n").cast("int").alias("n")).agg(F.max(F.struct(*SKETCH)).alias("s")).select("doc_id", "h1", "n", "s.*")
    for no in range(rounds):
        best = _best(_candidates(_labelled(index, sketches, found), percent, no), told, percent)
        new = gathered(_verified(best, known, k, percent))
        if new.isEmpty():
            break
        edges = gathered(edges.unionByName(new))
        found = components(edges)
    pairs = reliable(_across(_labelled(index, sketches, found), percent, list_most))
    found = components(gathered(edges.unionByName(_verified(_likely(pairs, told, percent), known, k, percent))))
    out = profile.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by the Jaccard likeness of their 4-word shingles, 0.85 or more."""
    return ngram_join(documents(spark, sf_dir))


QUERIES = {"op10_ngram_join": op10_ngram_join}
SQL = {
    "op10_ngram_join": """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM t WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), p AS (
  SELECT a.doc_id AS s, b.doc_id AS d, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT s, d FROM p JOIN n x ON p.s = x.doc_id JOIN n y ON p.d = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)
), r AS (
  SELECT s AS node, d AS reach FROM l UNION SELECT r.node, l.d FROM r JOIN l ON r.reach = l.s
), c AS (SELECT node, min(reach) AS low FROM r GROUP BY node)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(c.low, t.doc_id)) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c ON t.doc_id = c.node"""
}
