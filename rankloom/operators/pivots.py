"""Exact nearest rows with pivots: blocks that the triangle inequality rules out are not compared.

Some gallery rows are pivots. Every gallery row belongs to its nearest pivot, and rows of a pivot are dealt into blocks by
their distance to it, so a block is (a part of) a shell. A query's distance to a shell's pivot bounds its distance to all of the shell's rows. Queries of
a pivot are blocks too. Such a block is first compared with the shells of its pivot, which gives each query k candidates; then with all others, but for queries
whose k-th candidate is nearer than the bound. Cosines are compared as distances of unit vectors. A task keeps k candidates a query and reads the gallery as a stream (blocks.met).

Only pivots and one line for each of them (PIVOTS) reach the driver; they and one line for each shell (PIVOTS times CUTS at most) are sent to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import blocks

#: Pivots; cuts of a pivot's distances; queries of a block at most, about; scores that are measured at once.
PIVOTS, CUTS, QUERIES, PIECE = 128, 64, 512, 1 << 15
#: Distances that differ by less may come out either way round in products; candidates so close are measured again one by one.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def best_of(a: np.ndarray, own: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, metric: str, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of a, target and score of the k best rows of b (cosine of unit rows, or the negative distance), ties to the smaller id. A product finds the candidates; their scores are measured row by row, so they are the same in any block."""
    rows, targets, scores = [], [], []
    for s in range(0, len(a), 256):
        x = a[s : s + 256]
        near = x @ b.T if metric == "cosine" else 2 * x @ b.T - (x**2).sum(1)[:, None] - (b**2).sum(1)
        if exclude_self:
            near[own[s : s + 256, None] == ids] = -np.inf
        kth = np.partition(near, -min(k, near.shape[1]), axis=1)[:, -min(k, near.shape[1])]
        i, j = np.nonzero((near >= (kth - SLACK * (1 + np.abs(np.where(np.isfinite(kth), kth, 0))))[:, None]) & np.isfinite(near))
        score = (x[i] * b[j]).sum(1) if metric == "cosine" else -np.sqrt(((x[i] - b[j]) ** 2).sum(1))
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        rows.append(i[keep] + s)
        targets.append(ids[j[keep]])
        scores.append(score[keep])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *targets]), np.concatenate([np.zeros(0), *scores])


def compared(left: DataFrame, right: DataFrame, keys: list[str], k: int, metric: str, exclude_self: bool) -> DataFrame:
    """query_id, target_id, score: the k best within each group of keys, which both sides have."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": np.zeros(0, np.int64), "target_id": np.zeros(0, np.int64), "score": np.zeros(0)}
        if len(a) and len(b):
            x, y = (np.stack(p["vector"].to_list()).astype(float) for p in (a, b))
            if metric == "cosine":
                x, y = unit(x), unit(y)
            own = a["id"].to_numpy()
            i, out["target_id"], out["score"] = best_of(x, own, y, b["id"].to_numpy(), k, metric, exclude_self)
            out["query_id"] = own[i]
        return pd.DataFrame(out)

    return left.groupBy(*keys).cogroup(right.groupBy(*[f"_{c}" for c in keys])).applyInPandas(run, "query_id bigint, target_id bigint, score double")


def _rooted(pivots: np.ndarray, metric: str):
    """A function for batches of id and vector: adds the nearest pivot and the distance to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["vector"].to_list()).astype(float)
                d = distances(unit(x) if metric == "cosine" else x, pivots)
                f["pivot"], f["far"] = d.argmin(1).astype(np.int32), d.min(1)
                if metric == "cosine":  # a zero vector has no place among unit vectors
                    zero = ~x.any(1)
                    f.loc[zero, "pivot"], f.loc[zero, "far"] = -1, 0.0
                yield f

    return run


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1), 0))


def _measured(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows i of x with rows j of y, one by one."""
    out = np.empty(len(i))
    for s in range(0, len(i), PIECE):
        a, b = x[i[s : s + PIECE]], y[j[s : s + PIECE]]
        out[s : s + PIECE] = (a * b).sum(1) if metric == "cosine" else -np.sqrt(((a - b) ** 2).sum(1))
    return out


class _Best:
    """The k best rows so far of a block of queries."""

    def __init__(self, own: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int, metric: str, exclude_self: bool) -> None:
        self.k, self.metric, self.exclude_self, self.own = k, metric, exclude_self, own
        self.zero = ~x.any(1) if metric == "cosine" else np.zeros(len(x), bool)
        self.x = unit(x) if metric == "cosine" else x
        self.norms, self.far = (self.x**2).sum(1), distances(self.x, pivots)
        self.ids, self.scores = np.zeros((len(x), k), np.int64), np.full((len(x), k), -np.inf)
        self.compared = np.zeros(len(x), np.int64)

    def reached(self, pivot: int, low: float, high: float) -> np.ndarray:
        """Queries that the shell may hold a better row for."""
        if pivot < 0:  # zero vectors are always compared
            return np.arange(len(self.x))
        kth = self.scores[:, -1]
        worst = np.sqrt(np.maximum(0, 2 - 2 * kth)) if self.metric == "cosine" else -kth
        bound = np.maximum(self.far[:, pivot] - high, low - self.far[:, pivot])
        return np.flatnonzero(self.zero | (bound <= worst + 1e-6))

    def add(self, at: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        """Compares the queries at with a block of rows. A product finds the candidates; their scores are measured row by row, so they are the same in any block."""
        self.compared[at] += 1
        y = unit(y) if self.metric == "cosine" else y
        squares = (y**2).sum(1)
        for s in range(0, len(at), 256):
            rows = at[s : s + 256]
            x, k = self.x[rows], min(self.k, len(y))
            near = x @ y.T if self.metric == "cosine" else 2 * x @ y.T - self.norms[rows, None] - squares
            if self.exclude_self:
                near[self.own[rows, None] == ids] = -np.inf
            kth = self.scores[rows, -1]
            kth = kth if self.metric == "cosine" else -(kth**2)
            if np.isinf(kth).any():
                kth = np.maximum(kth, np.partition(near, -k, axis=1)[:, -k])
            size = 0 if self.metric == "cosine" else self.norms[rows] + squares.max(initial=0)
            slack = SLACK * (1 + np.abs(np.where(np.isfinite(kth), kth, 0))) + 1e-12 * size
            i, j = np.nonzero((near >= (kth - slack)[:, None]) & np.isfinite(near))
            if not len(i):
                continue
            score = _measured(x, y, i, j, self.metric)
            # Those at hand and the new ones, by score and then by id.
            some = np.unique(i)
            held, place = np.nonzero(np.isfinite(self.scores[rows[some]]))
            who = np.concatenate([i, some[held]])
            target = np.concatenate([ids[j], self.ids[rows[some[held]], place]])
            score = np.concatenate([score, self.scores[rows[some[held]], place]])
            order = np.lexsort((target, -score, who))
            who, target, score = who[order], target[order], score[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            who, target, score, place = (v[place < self.k] for v in (who, target, score, place))
            self.ids[rows[who], place], self.scores[rows[who], place] = target, score

    def rows(self) -> pa.RecordBatch:
        q, place = np.nonzero(np.isfinite(self.scores))
        found = self.own[q], self.ids[q, place], self.scores[q, place], place.astype(np.int32) + 1, np.where(place == 0, self.compared[q], 0)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["query_id", "target_id", "score", "rank", "compared"])


def nearest(queries: DataFrame, gallery: DataFrame, k: int, metric: str, exclude_self: bool, block: int, rows: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """query_id, target_id, score, rank: each query's k best rows; and a row with n_pairs (queries times blocks) and n_compared. rows: how many gallery has. queries and gallery: id, vector."""
    seeds = gallery.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()
    roots = np.stack(seeds["vector"].to_list()).astype(float)
    roots = unit(roots[roots.any(1)]) if metric == "cosine" else roots
    if not len(roots):
        roots = np.zeros((1, len(seeds["vector"][0])))
    rooted = lambda df: df.select("id", "vector").mapInPandas(_rooted(roots, metric), f"id bigint, vector {dict(df.dtypes)['vector']}, pivot int, far double")
    placed = rooted(gallery)
    cuts = placed.groupBy("pivot").agg(F.percentile_approx("far", [i / CUTS for i in range(1, CUTS)], 20 * CUTS).alias("cuts"), F.count("*").alias("n"))
    # As many rows as pivots.
    dealt = placed.join(F.broadcast(cuts), "pivot")
    place = F.size(F.filter("cuts", lambda c: c <= F.col("far")))
    dealt = dealt.withColumn("shell", F.floor(place * F.ceil(F.col("n") / block) / CUTS)).select("id", "vector", "pivot", "far", "shell")
    sizes = dealt.groupBy("pivot", "shell").agg(F.ceil(F.count("*") / min(block, blocks.CHUNK)).alias("parts"))
    # As many rows as pivots and cuts at most. Rows of a shell, however many are alike, are dealt into blocks.
    dealt = dealt.join(F.broadcast(sizes), ["pivot", "shell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    kinds = {"id": "<i8", "vector": blocks.kind(gallery), "far": "<f8"}
    shells = blocks.packed(dealt, ["pivot", "shell", "part"], kinds)
    asked = rooted(queries)
    several = asked.groupBy("pivot").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    asked = asked.join(F.broadcast(several), "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    own = {"id": "<i8", "vector": blocks.kind(queries)}

    def run(stream: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        best = None
        for row in stream:
            if row["turn"] == blocks.OWN:
                if best is not None:
                    yield best.rows()
                q = blocks.unpacked({c: row[f"q_{c}"] for c in own}, own)
                best = _Best(q["id"], q["vector"], roots, k, metric, exclude_self)
            else:
                g = blocks.unpacked({c: row[f"g_{c}"] for c in kinds}, kinds)
                at = best.reached(row["g_pivot"], g["far"].min(), g["far"].max())
                if len(at):
                    best.add(at, g["vector"], g["id"])
        if best is not None:
            yield best.rows()

    n = sum(r.parts for r in several.collect())
    # The shells of a query's own pivot come first; what they give rules out others.
    same = F.col("q_pivot") == F.col("g_pivot")
    found = blocks.met(blocks.packed(asked, ["pivot", "part"], own), shells.drop("shell", "part"), same, run, "query_id bigint, target_id bigint, score double, rank int, compared bigint", n, ~same)
    counted = shells.agg(F.count("*").alias("n_shells")).crossJoin(queries.agg(F.count("*").alias("n")))  # one row each
    share = found.agg(F.sum("compared").alias("n_compared")).crossJoin(counted).select((F.col("n") * F.col("n_shells")).alias("n_pairs"), "n_compared", "n_shells")
    return found.drop("compared"), share
