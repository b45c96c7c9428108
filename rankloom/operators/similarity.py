"""Neighbours of vectors and of sequences, and labels transferred from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators import blocks, pivots

#: Vectors of a block of the exact search.
BLOCK = 2048
#: Digits to which cosines are compared in rankings: products of blocks differ in the last bits.
DIGITS = 10


def nearest(queries: DataFrame, gallery: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """query_id, target_id, score, rank: the k best targets of each query, exactly; ties go to the smaller target.

    queries and gallery have id and vector. A gallery of one block is compared with blocks of queries; a larger one is
    dealt into shells around pivots (pivots.nearest), of which only those within reach are compared. Scores are measured row by row, so they don't depend on blocks. metric: cosine
    (zero vectors score 0) or euclidean (score is the negative distance).
    """
    q, g = (df.select(F.col("id").cast("bigint").alias("id"), "vector") for df in (queries, gallery))
    n = g.count()
    if n <= block:
        parts = max(1, math.ceil(q.count() / (4 * block)))
        left = q.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
        right = g.select(F.col("id").alias("id"), F.col("vector").alias("vector"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("_part"))
        found = pivots.compared(left, right, ["part"], k, metric, exclude_self)
    else:
        return pivots.nearest(q, g, k, metric, exclude_self, block, n)[0]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "target_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall_at(neighbours: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """recall_<k>: the share of all labelled queries with a neighbour of their label among the first k. labels: id, label."""
    hits = _with_labels(neighbours, labels)
    first = hits.filter("hit").groupBy("query_id").agg(F.min("rank").alias("first"))
    every = labels.select(F.col("id").alias("query_id")).join(first, "query_id", "left")
    return every.agg(F.count("*").alias("n"), *[F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in ks])


def _with_labels(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    q = labels.select(F.col("id").alias("query_id"), F.col("label").alias("_lq"))
    t = labels.select(F.col("id").alias("target_id"), F.col("label").alias("_lt"))
    return neighbours.join(q, "query_id").join(t, "target_id").withColumn("hit", F.col("_lq") == F.col("_lt"))


def retrieval_per_query(neighbours: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """Per labelled query: hit_<k>, ap over the ranking given, eligible (another row has its label)."""
    hits = _with_labels(neighbours, labels).withColumn("_h", F.col("hit").cast("int"))
    upto = F.sum("_h").over(W.partitionBy("query_id").orderBy("rank"))
    per = hits.withColumn("_p", F.when(F.col("hit"), upto / F.col("rank"))).groupBy("query_id").agg(*[F.max(F.when(F.col("rank") <= k, F.col("_h")).otherwise(0)).alias(f"hit_{k}") for k in ks], F.sum("_p").alias("_ap"), F.sum("_h").alias("_n"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("_size"))
    every = labels.join(sizes, "label").select(F.col("id").alias("query_id"), (F.col("_size") > 1).alias("eligible"), (F.col("_size") - 1).alias("_others"))
    out = every.join(per, "query_id", "left")
    return out.select("query_id", "eligible", *[F.coalesce(f"hit_{k}", F.lit(0)).alias(f"hit_{k}") for k in ks], F.when(F.col("_others") > 0, F.coalesce("_ap", F.lit(0.0)) / F.col("_others")).otherwise(0.0).alias("ap"))


#: Bytes of what a task keeps of a block of queries, about, and of the scores that it makes before it counts them; rows of these at most.
KEPT, SCORES, ROWS = 96 << 20, 48 << 20, 1 << 17
#: Scores that find their places together, in arrays that stay in the processor's cache; keys that each of them looks at before it searches.
AT_ONCE, LOOKS = 1 << 15, 4
#: What cosines are multiplied by, so that they are whole numbers but for the rounding, the highest first; what a vector that isn't finite scores, behind all others.
SCALE, LAST = -(10.0**DIGITS), 4 * 10.0**DIGITS
#: Rows that are counted: of other groups (whose labels differ), of the queries' own slice, of other slices of their group.
FAR, POOL, SLICE = range(3)
#: Of the counts' own type: numpy adds another type slowly.
ONE = np.int32(1)


def _ahead(keys: np.ndarray, ids: np.ndarray, x: np.ndarray, xid: np.ndarray) -> np.ndarray:
    """For each of x the first of keys (ascending, then ids) that it comes before."""
    at = np.searchsorted(keys, x, "right")
    tied = np.flatnonzero((at > 0) & (keys[at - 1] == x)) if len(keys) else np.zeros(0, np.int64)
    if len(tied):
        own, high = xid[tied], at[tied]
        low = np.searchsorted(keys, x[tied], "left")
        while (open_ := low < high).any():
            mid = np.minimum((low + high) // 2, len(ids) - 1)
            up = ids[mid] <= own
            low, high = np.where(open_ & up, mid + 1, low), np.where(open_ & ~up, mid, high)
        at[tied] = low
    return at


def _factors(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What makes unit vectors of these; the places of those whose length isn't finite, and what these score."""
    with np.errstate(all="ignore"):
        length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        odd = np.flatnonzero(~np.isfinite(length))
        return 1 / np.where(length > 0, length, 1.0), odd, np.where(np.isfinite(vectors[odd]).all(1), 0.0, LAST)


class _Ranked:
    """A block of queries, the scores of a slice of the rows of their labels, and how many rows are ahead of each of them.

    A query's own scores, in order, are its keys. A table over even steps of the score, two for each key, has the number of keys before each step, so that a
    row finds its place among the keys by a look or two: nothing but keys is sorted. Rows of the own slice are known by their keys; only rows of other labels, and
    of other slices of the label, are counted.
    """

    def __init__(self, q: dict[str, np.ndarray]) -> None:
        factor, odd, _ = _factors(q["vector"])
        # Copies, as all of an Arrow batch stays for as long as a part of it is in use.
        self.q, self.unit = {c: q[c].copy() for c in ("id", "h")}, q["vector"] * (factor * SCALE)[:, None]
        self.unit[odd] = 0.0
        self.parts, self.pool, self.keys = [], [], None
        self.full = 0
        room = max(blocks.CHUNK, min(ROWS, SCORES // (8 * len(self.unit))))
        # Lines a power of two apart would meet in the processor's cache.
        self.scores, self.rest, self.other = np.empty((len(self.unit), room + 8))[:, :room], np.empty((3, room), np.int64), np.empty((room, self.unit.shape[1]))

    def _score(self, g: dict[str, np.ndarray], out: np.ndarray) -> np.ndarray:
        factor, odd, instead = _factors(g["vector"])
        with np.errstate(invalid="ignore"):
            np.matmul(self.unit, np.multiply(g["vector"], factor[:, None], out=self.other[: len(factor)]).T, out=out)
        out[:, odd] = instead
        return out

    def own_rows(self, g: dict[str, np.ndarray]) -> None:
        """A block of the queries' own slice; all of them come before any other."""
        same = np.isin(g["h"], self.q["h"])
        if same.any():
            mine = {c: x[same] for c, x in g.items()}
            scores = self._score(mine, np.empty((len(self.unit), len(mine["id"]))))
            self.parts.append((mine["id"], mine["h"], np.rint(scores, out=scores)))
        if (self.q["h"] != g["h"][0]).any() or not same.all():
            self.pool.append({c: x.copy() for c, x in g.items()})

    def add(self, g: dict[str, np.ndarray], kind: int) -> None:
        """A block of any other rows."""
        if self.keys is None:
            self._settle()
        for s in range(0, len(g["id"]), self.scores.shape[1]):
            some = {c: x[s : s + self.scores.shape[1]] for c, x in g.items()}
            if self.full + len(some["id"]) > self.scores.shape[1]:
                self._count()
            at = slice(self.full, self.full + len(some["id"]))
            self._score(some, self.scores[:, at])
            self.rest[:, at] = some["id"], some["h"], np.full(len(some["id"]), kind)
            self.full = at.stop

    def _settle(self) -> None:
        """Keys and their tables."""
        n, wide = len(self.unit), sum(len(x[0]) for x in self.parts)
        self.ids, labels = (np.concatenate([x[k] for x in self.parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
        self.own = np.concatenate([x[2] for x in self.parts] or [np.zeros((n, 0))], axis=1)
        self.parts = []
        for k in range(n):
            self.own[k, (labels != self.q["h"][k]) | (self.ids == self.q["id"][k])] = np.inf
        self.keys = np.full((n, wide + 1), np.inf)
        self.keys[:, :wide] = self.own
        self.keys[:, :wide].sort(axis=1)
        self.n = np.count_nonzero(np.isfinite(self.keys), axis=1)
        steps, kind = max(2, 2 * wide), np.uint16 if wide < 1 << 16 else np.int32
        self.low, self.to_step, self.before, self.rows, self.alike = np.zeros(n), np.zeros(n), np.zeros((n, steps), kind), np.zeros((n, wide + 1), np.int32), None
        self.places = _Places(AT_ONCE, kind)
        for k, m in enumerate(self.n):
            if m:
                # A few keys at both ends count to the end steps: one far away would make all steps wide.
                keys, few = self.keys[k, :m], m // 4096
                self.low[k], self.to_step[k] = keys[few], steps / max(keys[m - 1 - few] - keys[few], 1)
                at = np.clip(((keys - self.low[k]) * self.to_step[k]).astype(np.int64), 0, steps - 1)
                np.cumsum(np.bincount(at, minlength=steps)[:-1], out=self.before[k, 1:])
        while self.pool:
            self.add(self.pool.pop(), POOL)

    def _through(self, k: int, x: np.ndarray, xid: np.ndarray) -> np.ndarray:
        """For each of x, equal to keys of query k: how many of these keys have no greater id."""
        own, known = self.own[k], np.unique(x)
        if len(known) <= 16:
            tied = np.flatnonzero(np.logical_or.reduce([own == v for v in known]))
        else:
            tied = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
        keys, ids = own[tied], self.ids[tied]
        order = np.lexsort((ids, keys))
        return _ahead(keys[order], ids[order], x, xid) - np.searchsorted(keys[order], x)

    def _count(self) -> None:
        near = self.rest[2, : self.full] != FAR
        if self.alike is None and (self.rest[2, : self.full] == SLICE).any():
            self.alike = np.zeros_like(self.rows)
        for k in np.flatnonzero(self.n):
            for s in range(0, self.full, AT_ONCE):
                part = slice(s, min(s + AT_ONCE, self.full))
                places = self.places(self.scores[k, part], self.keys[k], self.before[k], self.low[k], self.to_step[k])
                ids, labels, kinds = self.rest[:, part]
                if len(tied := self.places.tied):
                    places[tied] += self._through(k, self.places.x[tied], ids[tied])
                if near[part].any():
                    kin = labels == self.q["h"][k]
                    if self.alike is not None:
                        np.add.at(self.alike[k], places[kin & (kinds == SLICE) & (ids != self.q["id"][k])], ONE)
                    places = places[~kin]
                np.add.at(self.rows[k], places, ONE)
        self.full = 0

    def result(self) -> pa.RecordBatch:
        if self.keys is None:
            self._settle()
        self._count()
        terms, best = [], []
        for k, m in enumerate(self.n):
            alike = np.arange(m) + (0 if self.alike is None else np.cumsum(self.alike[k, :m]))
            ahead = alike + np.cumsum(self.rows[k, :m])
            terms.append(((alike + 1) / (ahead + 1)).sum())
            best.append(int(ahead[0]) if m else None)
        return pa.RecordBatch.from_arrays([pa.array(self.q["id"], pa.int64()), pa.array(terms, pa.float64()), pa.array(best, pa.int64())], ["query_id", "t", "best"])


class _Places:
    """Finds places among keys; x has the rounded scores it found them for, tied which of them equal a key."""

    def __init__(self, most: int, kind: type) -> None:
        self.real, self.whole = np.empty((3, most)), np.empty((2, most), np.int64)
        self.short, self.flags = np.empty(most, kind), np.empty((2, most), bool)

    def __call__(self, scores: np.ndarray, keys: np.ndarray, before: np.ndarray, low: float, to_step: float) -> np.ndarray:
        """For each score the first of keys (ascending; the last is inf) that isn't less."""
        n = len(scores)
        (x, room, key), (step, at) = self.real[:, :n], self.whole[:, :n]
        short, (less, same) = self.short[:n], self.flags[:, :n]
        np.rint(scores, out=x)
        np.subtract(x, low, out=room)
        np.multiply(room, to_step, out=room)
        np.copyto(step, room, casting="unsafe")
        np.copyto(at, before.take(step, mode="clip", out=short))
        keys.take(at, mode="clip", out=key)
        np.less(key, x, out=less)
        np.equal(key, x, out=same)
        open_ = np.flatnonzero(less)
        left, place = x[open_], at[open_]
        for _ in range(LOOKS):
            place += 1
            found = keys.take(place, mode="clip")
            at[open_], same[open_] = place, found == left
            on = np.flatnonzero(found < left)
            if not len(on):
                break
            open_, left, place = open_[on], left[on], place[on]
        else:
            at[open_] = np.searchsorted(keys, left)
            same[open_] = keys[at[open_]] == left
        self.x, self.tied = x, np.flatnonzero(same) if same.any() else ()
        return at


def average_precision(df: DataFrame, ks: list[int] = (), block: int = BLOCK, most: int = 1 << 18, asking: Column | None = None) -> DataFrame:
    """query_id, eligible, hit_<k> and ap of each labelled row over the full cosine ranking of all other rows; ties go to the smaller target. df: id, vector, label; asking: which rows are queries (all).

    Rows of a label are dealt into slices of about most, so that no label has to fit into a task; small labels share a group. A task holds a block of queries of a group and
    their scores with a slice of it. It then reads all other rows as a stream (blocks.met) and counts how many of them, and of those of the query's label, are ahead of each of
    these scores. It hands on one row for a query and slice: no row is made of a pair, and no score leaves the task.
    """
    asks, chunk = F.lit(True) if asking is None else asking, min(block, blocks.CHUNK)
    rows = df.select(F.col("id").cast("bigint").alias("id"), "label", "vector", asks.alias("asks"))
    rows = rows.join(rows.groupBy("label").agg(F.count("*").alias("size")), "label", "left").withColumn("h", F.xxhash64("label"))
    total = rows.count()
    pooled = F.concat(F.lit("pool"), F.pmod("h", F.lit(max(1, math.ceil(total / (4 * chunk))))))
    group = F.when(F.col("label").isNull(), F.lit("none")).when(F.col("size") < chunk, pooled).otherwise(F.concat(F.lit("label"), F.col("h")))
    rows = rows.withColumn("group", group)
    wanted = F.col("asks") & F.col("label").isNotNull() & (F.col("size") > 1)
    # A query keeps each score of its slice twice, two steps (of two bytes up to 65,535 scores) and a count; with several slices another count.
    each = F.ceil(F.col("n") / F.col("slices"))
    held = F.greatest(F.lit(1), F.least(F.lit(chunk), F.floor(F.lit(KEPT) / (F.when((F.col("slices") > 1) | (each >= 1 << 16), 32).otherwise(24) * each))))
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.count_if(wanted).alias("_asking")).withColumn("slices", F.ceil(F.col("n") / most))
    sizes = sizes.withColumns({"qparts": F.ceil(F.col("_asking") / held), "gparts": F.greatest("slices", F.ceil(F.col("n") / chunk))})
    rows = rows.join(sizes.select("group", "slices", "qparts", "gparts"), "group")
    # Vectors travel as they are; their unit vectors, in doubles, are made where they are compared.
    kinds = {"id": "<i8", "h": "<i8", "vector": blocks.kind(rows)}
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).alias("part")
    asked = blocks.packed(rows.filter(wanted).select("id", "h", "vector", "group", "slices", part("qparts")), ["group", "slices", "part"], kinds)
    asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
    gallery = blocks.packed(rows.select("id", "h", "vector", "group", part("gparts")), ["group", "part"], kinds)
    n = sizes.agg(F.sum(F.col("qparts") * F.col("slices"))).first()[0] or 0

    def run(stream: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        ranked = None
        for row in stream:
            if row["turn"] == blocks.OWN:
                if ranked is not None:
                    yield ranked.result()
                    ranked = None
                ranked = _Ranked(blocks.unpacked({c: row[f"q_{c}"] for c in kinds}, kinds))
                name = row["q_group"]
            else:
                g = blocks.unpacked({c: row[f"g_{c}"] for c in kinds}, kinds)
                if row["turn"] == blocks.GROUP:
                    ranked.own_rows(g)
                else:
                    ranked.add(g, SLICE if row["g_group"] == name else FAR)
                g = row = None  # their Arrow batch may go before the next one comes
        if ranked is not None:
            yield ranked.result()

    own = (F.col("q_group") == F.col("g_group")) & (F.pmod(F.col("g_part"), F.col("q_slices")) == F.col("q_slice"))
    found = blocks.met(asked, gallery, own, run, "query_id bigint, t double, best bigint", n, ~own, 8)
    per = found.groupBy("query_id").agg(F.sum("t").alias("t"), F.min("best").alias("best"))
    every_query = rows.filter("label is not null and asks").select(F.col("id").alias("query_id"), (F.col("size") > 1).alias("eligible"), (F.col("size") - 1).alias("others"))
    out = every_query.join(per, "query_id", "left")
    return out.select("query_id", "eligible", *[F.coalesce((F.col("best") < k).cast("int"), F.lit(0)).alias(f"hit_{k}") for k in ks], F.coalesce(F.col("t") / F.when(F.col("others") > 0, F.col("others")), F.lit(0.0)).alias("ap"))


def retrieval(per_query: DataFrame, ks: list[int]) -> DataFrame:
    """recall and map over all queries and over eligible ones, and both counts."""
    ok = F.col("eligible")
    return per_query.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_eligible"), F.avg("ap").alias("map"), F.avg(F.when(ok, F.col("ap"))).alias("map_eligible"), *[x for k in ks for x in (F.avg(f"hit_{k}").alias(f"recall_{k}"), F.avg(F.when(ok, F.col(f"hit_{k}"))).alias(f"recall_{k}_eligible"))])


def knn_vote(neighbours: DataFrame, labels: DataFrame, weighted: bool = False) -> DataFrame:
    """query_id and the label with most (or most heavily weighted) neighbours; ties go to the smallest label."""
    weight = F.when(F.lit(weighted), 1 / F.greatest(F.lit(1e-12), -F.col("score") if weighted else F.lit(1.0))).otherwise(1.0)
    votes = neighbours.join(labels.select(F.col("id").alias("target_id"), "label"), "target_id").groupBy("query_id", "label").agg(F.sum(weight).alias("v"))
    order = W.partitionBy("query_id").orderBy(F.desc("v"), "label")
    return votes.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("query_id", F.col("label").alias("predicted"))


def knn_mean(neighbours: DataFrame, values: DataFrame) -> DataFrame:
    """query_id and the mean value of its neighbours. values: id, value."""
    return neighbours.join(values.select(F.col("id").alias("target_id"), "value"), "target_id").groupBy("query_id").agg(F.avg("value").alias("predicted"))


def transfer_judged(nearest_one: DataFrame, queries: DataFrame, lookup: DataFrame, levels: list[str]) -> DataFrame:
    """Per query and level: in_all, in_lookup (how often its label occurs in queries and lookup together, and in lookup) and right (whether the nearest row has it)."""
    pairs = nearest_one.filter("rank = 1").join(queries.select(F.col("id").alias("query_id"), *[F.col(c).alias(f"_q_{c}") for c in levels]), "query_id", "right").join(lookup.select(F.col("id").alias("target_id"), *[F.col(c).alias(f"_t_{c}") for c in levels]), "target_id", "left")
    long = pairs.select("query_id", F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(f"_q_{c}").alias("truth"), F.col(f"_t_{c}").alias("found")) for c in levels])).alias("x")).select("query_id", "x.*")
    tall = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("truth")) for c in levels])).alias("x")).select("x.*")
    held = tall(lookup).groupBy("level", "truth").agg(F.count("*").alias("in_lookup"))
    both = tall(lookup).unionByName(tall(queries)).groupBy("level", "truth").agg(F.count("*").alias("in_all"))
    judged = long.join(both, ["level", "truth"]).join(held, ["level", "truth"], "left")
    return judged.select("level", "query_id", "in_all", "in_lookup", (F.coalesce(F.col("found"), F.lit("")) == F.col("truth")).alias("right"))


def transfer_levels(nearest_one: DataFrame, queries: DataFrame, lookup: DataFrame, levels: list[str]) -> DataFrame:
    """Per level: n_answerable (the label occurs more than once in queries and lookup together), n_strict (it occurs in lookup) and the accuracy of the nearest row's label over answerable queries."""
    judged, ok = transfer_judged(nearest_one, queries, lookup, levels), F.col("in_all") > 1
    return judged.groupBy("level").agg(F.count_if(ok).alias("n_answerable"), F.count_if(F.col("in_lookup") > 0).alias("n_strict"), F.coalesce(F.avg(F.when(ok, F.col("right").cast("double"))), F.lit(0.0)).alias("accuracy"))


#: A k-mer of more rows is frequent; parts into which a frequent k-mer's rows of the larger side are dealt.
OFTEN, PARTS = 10_000, 64


def shared_kmer_hits(queries: DataFrame, targets: DataFrame, least: int = 1, often: int = OFTEN) -> DataFrame:
    """query_id, target_id, shared, qcov, tcov, containment from id and kmers (arrays), exactly. Each row counts its own k-mers, so targets are neither grouped nor shuffled before the join, and not at all where the queries' k-mers are few enough for Spark to broadcast them.

    K-mers that more than often targets have are found first, among those of the queries. Their join is dealt out: each
    target's row goes to one of PARTS parts of its k-mer, each query's row to all of them, so none of them is one task's burden; all
    others meet by the k-mer alone. often = 0 leaves out this step.
    """
    # explode_outer: Spark infers no filter on the arrays, which would make them again; the join drops the nulls.
    each = lambda df, side, n: df.select(F.col("id").alias(side), F.array_distinct("kmers").alias("k")).select(side, F.size("k").alias(n), F.explode_outer("k").alias("kmer"))
    q, t = each(queries, "query_id", "nq"), each(targets, "target_id", "nt")
    frequent = _frequent_kmers(q, t, often) if often else None
    if frequent is None:
        shared = q.join(t, "kmer")
    else:
        # As many k-mers as frequent ones: each has more than often rows.
        flagged = lambda df: df.join(frequent, "kmer", "left").withColumn("_often", F.coalesce("_often", F.lit(False)))
        left = flagged(q).withColumn("_part", F.explode(F.when(F.col("_often"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))).drop("_often")
        right = flagged(t).withColumn("_part", F.when(F.col("_often"), F.pmod(F.xxhash64("target_id"), F.lit(PARTS)).cast("int")).otherwise(0)).drop("_often")
        shared = left.join(right, ["kmer", "_part"])
    out = shared.groupBy("query_id", "target_id", "nq", "nt").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    return out.select("query_id", "target_id", "shared", (F.col("shared") / F.col("nq")).alias("qcov"), (F.col("shared") / F.col("nt")).alias("tcov"), (F.col("shared") / F.least("nq", "nt")).alias("containment"))


def _frequent_kmers(q: DataFrame, t: DataFrame, often: int) -> DataFrame | None:
    """kmer, _often: k-mers of queries that more than often targets have; none where the queries' side is small enough to be broadcast, as no key is dealt then, or where the targets are no more than that."""
    limit = q.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    small = int(limit.rstrip("bB")) if limit.rstrip("bB").lstrip("-").isdigit() else 10 << 20
    known = q.select("kmer").filter("kmer is not null").distinct()
    size = known.agg(F.coalesce(F.sum(F.length("kmer") + 32), F.lit(0))).first()[0]
    if size <= small:
        return None
    return t.join(known, "kmer", "left_semi").groupBy("kmer").agg(F.count("*").alias("n")).filter(F.col("n") > often).select("kmer", F.lit(True).alias("_often"))


#: Fixed value: the hits of a query that a search hands on at most.
HITS_MOST = 300


def rank_hits(hits: DataFrame, score: str, most: int = HITS_MOST, expected: str | None = None) -> DataFrame:
    """The first hits of each query by expected value (less is better), where there is one, then by score, then by target."""
    order = W.partitionBy("query_id").orderBy(*([F.asc(expected)] if expected else []), F.desc(score), "target_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def strongest_per_target(hits: DataFrame, score: str, identity: float, coverage: float) -> DataFrame:
    """For each target that a query hits with score and both coverages reaching the limits: its strongest query."""
    good = hits.filter((F.col(score) >= identity) & (F.least("qcov", "tcov") >= coverage))
    order = W.partitionBy("target_id").orderBy(F.desc(score), "query_id")
    return good.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def contamination(found: DataFrame, corpus: DataFrame, task: str) -> DataFrame:
    """Per task, and in all (task null): corpus rows that leak, and their share in per cent. found: task, target_id."""
    total = corpus.count()
    per = found.groupBy(task).agg(F.countDistinct("target_id").alias("n_leaking"))
    every = found.agg(F.countDistinct("target_id").alias("n_leaking")).withColumn(task, F.lit(None).cast("string")).select(task, "n_leaking")
    return per.unionByName(every).withColumn("percent", F.col("n_leaking") * 100.0 / max(1, total))


def transfer_value(best: DataFrame, queries: DataFrame, values: DataFrame) -> DataFrame:
    """query_id, predicted, covered: the value of the best hit, or the mean of all values."""
    mean = values.agg(F.avg("value").alias("_m"))
    got = queries.select(F.col("id").alias("query_id")).join(best.filter("rank = 1").join(values.select(F.col("id").alias("target_id"), "value"), "target_id").select("query_id", "value"), "query_id", "left")
    return got.crossJoin(F.broadcast(mean)).select("query_id", F.coalesce("value", "_m").alias("predicted"), F.col("value").isNotNull().alias("covered"))  # one row of means


def transfer_labels(best: DataFrame, queries: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, predicted, covered: the label set of the best hit, or an empty one. labels: id, labels."""
    got = best.filter("rank = 1").join(labels.select(F.col("id").alias("target_id"), "labels"), "target_id").select("query_id", "labels")
    every = queries.select(F.col("id").alias("query_id")).join(got, "query_id", "left")
    none = F.array().cast(dict(labels.dtypes)["labels"])
    return every.select("query_id", F.coalesce("labels", none).alias("predicted"), F.col("labels").isNotNull().alias("covered"))


def class_scores(hits: DataFrame, queries: DataFrame, labels: DataFrame, score: str) -> DataFrame:
    """query_id, predicted, best: the class of the highest score among hits; queries without hits get the first class."""
    first = labels.agg(F.min("label").alias("_f"))
    per = hits.join(labels.select(F.col("id").alias("target_id"), "label"), "target_id").groupBy("query_id", "label").agg(F.max(score).alias("s"))
    order = W.partitionBy("query_id").orderBy(F.desc("s"), "label")
    top = per.withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    got = queries.select(F.col("id").alias("query_id")).join(top, "query_id", "left").crossJoin(F.broadcast(first))  # one row
    return got.select("query_id", F.coalesce("label", "_f").alias("predicted"), F.coalesce("s", F.lit(0.0)).alias("best"))


def hard_triplets(df: DataFrame, levels: dict[str, str | None], asking: Column | None = None, block: int = BLOCK) -> DataFrame:
    """anchor, level, positive, negative, d_positive, d_negative: of all rows the farthest of the anchor's label and the nearest of another label with the same parent; ties go to the smaller id. Anchors that lack either at a level have no row there.

    levels: a label column and its parent's (or None); df: id, vector and these; asking: which rows are anchors (all). Both partners of all levels come
    from one product of two blocks; a task hands on one row an anchor and level. Rows without a label of every level are left out.
    """
    names = list(levels)
    rows = df.dropna(subset=names).select(F.col("id").cast("bigint").alias("id"), "vector", *[F.xxhash64(c).alias(c) for c in names], (F.lit(True) if asking is None else asking).alias("_asks"))
    n, k = rows.agg(F.count("*"), F.count_if("_asks")).first()
    ng, nq = max(1, math.ceil(n / block)), max(1, math.ceil(k / (4 * block)))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
    left = rows.filter("_asks").select("id", "vector", *names, F.pmod(F.xxhash64("id"), F.lit(nq)).alias("bq"), every(ng).alias("bg"))
    right = rows.select(*[F.col(c).alias(c) for c in ("id", "vector", *names)], every(nq).alias("_bq"), F.pmod(F.xxhash64("id"), F.lit(ng)).alias("_bg"))
    parents = list(levels.values())

    def partner(score: np.ndarray, ok: np.ndarray, x: np.ndarray, y: np.ndarray, ids: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of x the best allowed row of y (sign 1: farthest), and its distance; -1 where none is allowed."""
        value = np.where(ok, sign * score, -np.inf)
        best = value.max(1)
        i, j = np.nonzero((value >= (best - 1e-9 * (1 + np.abs(np.where(np.isfinite(best), best, 0))))[:, None]) & np.isfinite(value))
        d = np.sqrt(((x[i] - y[j]) ** 2).sum(1))
        order = np.lexsort((ids[j], -sign * d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
        who, far = np.full(len(x), -1), np.zeros(len(x))
        who[i[first]], far[i[first]] = j[first], d[first]
        return who, far

    def mine(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor": [], "level": [], "side": [], "other": [], "d": []}).astype({"anchor": "int64", "level": "int32", "side": "int32", "other": "int64", "d": "float64"})]
        if len(a) and len(b):
            y, ids = np.stack(b["vector"].to_list()).astype(float), b["id"].to_numpy()
            for s in range(0, len(a), 256):
                part = a.iloc[s : s + 256]
                x, own = np.stack(part["vector"].to_list()).astype(float), part["id"].to_numpy()
                score = (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)
                other = own[:, None] != ids
                for k, (c, p) in enumerate(zip(names, parents, strict=True)):
                    same = part[c].to_numpy()[:, None] == b[c].to_numpy()
                    kin = part[p].to_numpy()[:, None] == b[p].to_numpy() if p else True
                    for side, ok, sign in ((0, same & other, 1), (1, ~same & kin, -1)):
                        who, d = partner(score, ok, x, y, ids, sign)
                        at = who >= 0
                        out.append(pd.DataFrame({"anchor": own[at], "level": np.int32(k), "side": np.int32(side), "other": ids[who[at]], "d": d[at]}).astype(out[0].dtypes.to_dict()))
        return pd.concat(out)

    found = left.groupBy("bq", "bg").cogroup(right.groupBy("_bq", "_bg")).applyInPandas(mine, "anchor bigint, level int, side int, other bigint, d double")
    best = found.groupBy("anchor", "level").agg(F.max(F.when(F.col("side") == 0, F.struct("d", (-F.col("other")).alias("o")))).alias("p"), F.min(F.when(F.col("side") == 1, F.struct("d", F.col("other").alias("o")))).alias("n"))
    level = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("level") + 1)
    return best.filter("p is not null and n is not null").select("anchor", level.alias("level"), (-F.col("p.o")).alias("positive"), F.col("n.o").alias("negative"), F.col("p.d").alias("d_positive"), F.col("n.d").alias("d_negative"))


def triplet_loss(triplets: DataFrame) -> DataFrame:
    """Per level: anchors and the mean soft margin log(1 + exp(d_positive - d_negative)) of their hardest triplets."""
    return triplets.groupBy("level").agg(F.count("*").alias("n_anchors"), F.avg(F.log1p(F.exp(F.col("d_positive") - F.col("d_negative")))).alias("loss"))
