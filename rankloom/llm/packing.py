"""Operator 3: best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become token ids (each closed by one end id), longer ones are cut into pieces of the
capacity. Whole pieces fill a sequence alone. The others are dealt by a hash of their number into
groups of bounded size; each group is packed by several islands. An island's individual is a set of
bins; the first one is best fit, largest first, and where that reaches the bound that the tokens' sum sets, nothing is
left to gain and evolution ends. Crossover injects whole well-filled bins of one parent into the other, drops the bins that now
repeat a document, and best-fits the displaced documents, largest first. Between epochs each island's
elite moves to the next island of its group. Bins that are full stay; all others are opened again, pooled
over groups, dealt into fewer groups and packed once more, turn by turn, until one group holds what is left (or hardly a bin
more is filled): so groups cost no open bins of their own.

Defined results: null or empty text is one piece of one end id; repeated rows are packed each on its
own; an empty table gives no rows; other columns of the input are left out.
"""

from __future__ import annotations

import math
import os
import random
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.llm.common import documents, gathered, reliable, slices

CAPACITY = 2048
END_ID = 0
#: Pieces of a group, about; the group's memory and time are bounded by it.
GROUP_PIECES = 20_000
ISLANDS, EPOCHS, POPULATION = 2, 2, 8
#: Children of an epoch: as many as their work allows (children times pieces), between these.
WORK, CHILDREN_LEAST, CHILDREN_MOST = 240_000, 12, 60
#: Bins at least so full are handed on whole by crossover.
WELL_FILLED = 0.995
#: A turn after which more than this part of its pieces is left is the last one.
TURN_LEFT, TURNS = 0.9, 32
#: Distinct chunks whose ids a worker remembers (half of them since it last forgot the others), and their length at most.
CACHE_CHUNKS, LONGEST_CACHED = 450_000, 64

_tokenizers: dict[str, list] = {}


def _default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A comma or stop that belongs to a longer run of signs.
_RUN = re.compile(r"[^0-9a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\s][,.] ")


def _chunks(text: str) -> list[str]:
    """The text cut at blanks and line ends. In texts of Latin-1, whose letters have one lower case each, all is lower case, and commas and stops after words are chunks of their own."""
    text = text.replace("\n", " ")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split(" ")
    text = text.lower()
    if not _RUN.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


def encode(texts: list[str], vocabulary: str) -> list[bytes]:
    """Each text's ids as little-endian 32-bit bytes. No token of this vocabulary spans white space or joins a letter and a sign, and letters count in lower case: so each distinct chunk is encoded once."""
    if vocabulary not in _tokenizers:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[vocabulary] = [Tokenizer.from_file(vocabulary), {}, {}]
    held = _tokenizers[vocabulary]
    parts = [_chunks(t) for t in texts]
    chunks = set().union(*parts)
    if len(held[1]) + len(chunks) > CACHE_CHUNKS // 2:
        # Chunks that come again are taken over; the others are forgotten next time.
        held[1:] = {}, held[1]
    tokenizer, known, before = held
    new = []
    for chunk in chunks.difference(known):
        if (found := before.get(chunk)) is None:
            new.append(chunk)
        else:
            known[chunk] = found
    for i in range(0, len(new), 4096):
        for chunk, found in zip(new[i : i + 4096], tokenizer.encode_batch_fast(new[i : i + 4096], add_special_tokens=False), strict=True):
            known[chunk] = array("I", found.ids).tobytes()
    out = [b"".join([known[c] for c in p]) for p in parts]
    for chunk in new:
        if len(chunk) > LONGEST_CACHED:
            del known[chunk]
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids with the end id, cut into pieces of at most capacity."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = vocabulary or _default_vocabulary()
        end, wide = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                ids = []
                for doc, raw in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()], names), strict=True):
                    raw += end
                    for k in range(0, len(raw), wide):
                        x = raw[k : k + wide]
                        rows.append((doc, k // wide, k // 4, len(x) // 4, zlib.crc32(x)))
                        if with_ids:
                            ids.append(np.frombuffer(x, "<i4"))
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    arrays = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    names_ = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names_ + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def _best_fit(order: list[int], sizes: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Puts each document of order into the fullest bin that has room for it, or a new one. room: what is left in each bin."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        by_room.setdefault(r, []).append(b)
        mask |= 1 << r
    for i in order:
        s = sizes[i]
        if up := mask >> s:
            r = s + (up & -up).bit_length() - 1
            same = by_room[r]
            b = same.pop()
            if not same:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
            room.append(r)
        room[b] = r = r - s
        same = by_room.setdefault(r, [])
        if not same:
            mask |= 1 << r
        same.append(b)


def _fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; of as many, uneven filling is better, as it leaves bins easier to empty."""
    return -len(room), sum(((capacity - r) / capacity) ** 2 for r in room)


def _crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> tuple[list[list[int]], list[int]]:
    fill = lambda x: sum(sizes[i] for i in x)
    good = [x for x in b if fill(x) >= WELL_FILLED * capacity]
    given = [list(x) for x in (rng.sample(good, len(good) // 2) if len(good) > 1 else good)]
    taken = {i for x in given for i in x}
    child, loose = given, []
    for x in a:
        if taken.isdisjoint(x) and (fill(x) >= WELL_FILLED * capacity or rng.random() < 0.5):
            child.append(list(x))
        else:
            loose += [i for i in x if i not in taken]
    room = [capacity - fill(x) for x in child]
    loose.sort(key=lambda i: -sizes[i])
    _best_fit(loose, sizes, child, room, capacity)
    return child, room


def _bins(places: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(places, default=-1) + 1)]
    for i, b in enumerate(places):
        out[b].append(i)
    return [x for x in out if x]


def _places(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for b, x in enumerate(bins):
        for i in x:
            out[i] = b
    return out


def evolve(sizes: list[int], seed: int, capacity: int, elites: list[list[int]] = (), population: int = POPULATION, children: int | None = None) -> tuple[list[int], int]:
    """One island's epoch: the best individual as each document's bin, and its bins' number. elites: individuals that begin the population; the others are best fits in orders shuffled more or less. A child of a parent that won a tournament and of any other replaces the least fit, if it is fitter."""
    rng = random.Random(seed)
    people = []
    for e in elites:
        bins = _bins(e)
        people.append((bins, [capacity - sum(sizes[i] for i in x) for x in bins]))
    least = -(-sum(sizes) // capacity)
    while len(people) < population and not (people and len(people[-1][0]) <= least):
        jitter = rng.choice([0.05, 0.2, 0.5]) if people else 0.0
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i] * (1 + jitter * (rng.random() - 0.5)), i))
        bins, room = [], []
        _best_fit(order, sizes, bins, room, capacity)
        people.append((bins, room))
    fit = [_fitness(x[1], capacity) for x in people]
    every = range(len(people))
    if children is None:
        children = max(CHILDREN_LEAST, min(CHILDREN_MOST, WORK // max(1, len(sizes))))
    for _ in range(children if len(people) > 1 else 0):
        if -max(fit)[0] <= least:
            break
        a, b = max(rng.sample(every, 2), key=fit.__getitem__), rng.choice(every)
        child = _crossover(people[a][0], people[b][0], sizes, capacity, rng)
        worst = min(every, key=fit.__getitem__)
        if (f := _fitness(child[1], capacity)) > fit[worst]:
            people[worst], fit[worst] = child, f
    best = people[max(every, key=fit.__getitem__)]
    return _places(best[0], len(sizes)), len(best[0])


def _epoch(state: DataFrame, epoch: int, capacity: int) -> DataFrame:
    def run(frames):
        for f in frames:
            rows = [evolve(list(map(int, s)), hash((int(g), int(i), epoch)), capacity, [list(map(int, e)) for e in el]) for g, i, s, el in zip(f["grp"], f["island"], f["sizes"], f["elites"], strict=True)]
            out = f[["grp", "island", "keys", "sizes"]].copy()
            out["best"], out["n_bins"] = [r[0] for r in rows], [r[1] for r in rows]
            yield out

    return state.mapInPandas(run, "grp bigint, island int, keys array<bigint>, sizes array<int>, best array<int>, n_bins int")


def _islands(items: DataFrame, groups: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """key, grp, bin, fill: the best of each group's islands after all epochs."""
    spread = F.pmod(F.xxhash64("key"), F.lit(groups))
    grouped = items.withColumn("grp", spread).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("key", "length"))).alias("x"))
    state = grouped.select("grp", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.key").alias("keys"), F.col("x.length").cast("array<int>").alias("sizes"), F.array().cast("array<array<int>>").alias("elites"))
    for epoch in range(epochs):
        state = reliable(_epoch(state.repartition(F.col("grp"), F.col("island")), epoch, capacity))
        if epoch + 1 < epochs:
            comers = state.select("grp", ((F.col("island") + 1) % islands).alias("island"), F.col("best").alias("comer"))
            state = state.join(comers, ["grp", "island"]).select("grp", "island", "keys", "sizes", F.array("best", "comer").alias("elites"))
    best = state.groupBy("grp").agg(F.min_by(F.struct("keys", "sizes", "best"), F.struct("n_bins", "island")).alias("b"))
    flat = best.select("grp", F.explode(F.arrays_zip("b.keys", "b.sizes", "b.best")).alias("x"))
    return flat.select("grp", F.col("x.keys").alias("key"), F.col("x.sizes").cast("bigint").alias("length"), F.col("x.best").alias("bin"))


def pack(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Each piece of pieces() with sequence_id and offset: which sequence holds it, and from which place."""
    cut = reliable(pieces(docs, capacity, vocabulary, with_ids).withColumn("key", F.monotonically_increasing_id()))
    items = cut.filter(F.col("length") < capacity).select("key", "length")
    n = items.count()
    placed, turn = None, 0
    while True:
        groups = max(1, math.ceil(n / group_pieces))
        packed = gathered(_islands(items, groups, capacity, islands, epochs))
        judged = packed.join(packed.groupBy("grp", "bin").agg(F.sum("length").alias("fill")), ["grp", "bin"])
        rest = gathered(judged.filter(F.col("fill") < capacity).select("key", "length"))
        left = rest.count()
        last = groups == 1 or left > TURN_LEFT * n or turn + 1 == TURNS
        stay = judged if last else judged.filter(F.col("fill") == capacity)
        stay = stay.select("key", "length", ((F.col("grp") * TURNS + turn) * (1 << 24) + F.col("bin")).alias("sequence_id"))
        placed = stay if placed is None else placed.unionByName(stay)
        if last or not left:
            break
        items, n, turn = rest, left, turn + 1
    # A sequence has at most capacity pieces, so its window is bounded.
    before = F.sum("length").over(W.partitionBy("sequence_id").orderBy("key"))
    offsets = placed.select("key", "sequence_id", (before - F.col("length")).alias("offset"))
    return cut.join(offsets, "key", "left").select(*[c for c in cut.columns if c != "key"], F.coalesce("sequence_id", -1 - F.col("key")).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(documents(spark, sf_dir))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
SQL: dict[str, str] = {}
