"""Operator 4: near-duplicate vectors by sorted projection passes.

Equal vectors are joined first and go on as one. In each pass every vector gets a code of the signs of
its products with the pass's random directions; all vectors of a label are ordered by the code, read
from the first sign to the last, and each is compared with the next ones of a window of fixed width. Links
that the cosine confirms join components over all passes. How crowded a vector's place is shows in each pass: the
signs it shares with the rows at the window's two ends. A linked vector that shares one sign more is within the
window, which gives the chance that a pair at the threshold is missed there (taken as independent of the
crowd). Vectors whose chance over all passes is above MISS stay open: rounds of fresh passes go over them
alone, and those still open after ROUNDS are compared in full within their label, block by block. So a link is
missed only if one of its ends was closed by that estimate. The passes only have to connect a component; the
links of its vectors are then counted in full, block by block. A component's vectors lie in shells by their angle to
one of them, each as wide as the angle at the threshold: linked vectors lie in one shell or in two that adjoin, so no others are compared.

Defined results: vectors that are null, zero, or hold null or non-finite parts, and those without label,
link with nothing; vectors of different length don't link. Repeated rows count as vectors of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import lowest, reliable, runs
from rankloom.llm.components import components

THRESHOLD = 0.98
#: Vectors that each is compared with in a pass; signs of a code; chance that a pair at the threshold is missed.
WINDOW, SIGNS, MISS = 192, 40, 1e-5
#: Rows of a product at once; vectors of a block in which a component's links are counted.
CHUNK, BLOCK = 512, 4096
#: Rounds of passes before the vectors that are still open are compared in full.
ROUNDS = 3


def _usable(vector: str) -> F.Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def passes_for(largest: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes of a round: those after which a pair at the threshold, among largest vectors whose codes spread evenly, has been in no common window with a chance of miss at most."""
    same_sign = 1 - math.acos(threshold) / math.pi
    signs = max(0.0, math.log2(max(1, largest) / window)) + 1
    return max(4, math.ceil(math.log(miss) / math.log1p(-min(0.99, same_sign**signs))))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _coded(vectors: DataFrame, passes: int, no: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                if d not in planes:
                    planes[d] = np.random.default_rng(20_011 + no).standard_normal((int(d), passes * SIGNS))
                up = _matrix(part.column("vector"), int(d)) @ planes[d] >= 0
                for p in range(passes):
                    code = up[:, p * SIGNS : (p + 1) * SIGNS] @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), p, np.int32)), *part.columns, pa.array(code)], ["pass", *part.schema.names, "code"])

    return vectors.mapInArrow(run, f"pass int, rep bigint, label bigint, dims int, vector {dict(vectors.dtypes)['vector']}, code bigint")


def _log_missed(key: np.ndarray, code: np.ndarray, a: int, b: int, window: int, threshold: float, starts: bool, ends: bool) -> np.ndarray:
    """For the rows a to b (exclusive) of sorted rows: the log of the chance that a pair at the threshold is outside the window. Whether the rows start and end with the partition's: beyond its edges nothing was compared."""
    at, same_sign = np.arange(a, b), 1 - math.acos(threshold) / math.pi
    shared = np.full(b - a, -1)
    for other, edge, known in ((at - window, 0, starts), (at + window, len(code) - 1, ends)):
        inside = (other >= 0) & (other < len(code))
        to = np.where(inside, other, edge)
        same = (key[at] == key[to]).all(1)
        # The bit length of the difference is the place of the first sign that differs.
        signs = np.where(inside | ~np.bool_(known), SIGNS - np.frexp((code[at] ^ code[to]).astype(np.float64))[1], SIGNS)
        shared = np.maximum(shared, np.where(same, signs, -1))
    return np.where(shared < SIGNS, np.log1p(-np.minimum(1 - 1e-15, same_sign ** (shared + 1.0))), 0.0)


def _window_links(coded: DataFrame, threshold: float, window: int) -> DataFrame:
    """src, dst: confirmed links of each partition's sorted rows, as one from every vector to the lowest it reaches among the rows at hand; and for each row src and missed, the log of the chance that a link of it isn't among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        keys, codes, reps, done, starts = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, True

        def judged(until: int, ends: bool) -> pa.RecordBatch:
            missed = _log_missed(keys, codes, done, until, window, threshold, starts, ends)
            return pa.RecordBatch.from_arrays([pa.array(reps[done:until]), pa.nulls(until - done, pa.int64()), pa.array(missed)], ["src", "dst", "missed"])

        for batch in batches:
            table = pa.Table.from_batches([batch] if tail is None else [*tail.to_batches(), batch])
            rows = len(table)
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("pass", "label", "dims")], 1)
            rep = table.column("rep").to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), rows]
            src, dst = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                x = _matrix(table.column("vector").slice(a, b - a), int(key[a, 2]))
                for s in range(0, b - a, CHUNK):
                    e = min(b - a, s + CHUNK)
                    i, j = np.nonzero(x[s:e] @ x[s : min(b - a, e + window)].T >= threshold)
                    near = (j > i) & (j - i <= window)
                    src.append(i[near] + a + s)
                    dst.append(j[near] + a + s)
            none = np.zeros(0, np.int64)
            low = lowest(np.concatenate([none, *src]), np.concatenate([none, *dst]), rows)
            away = np.flatnonzero(low != np.arange(rows))
            yield pa.RecordBatch.from_arrays([pa.array(rep[away]), pa.array(rep[low[away]]), pa.nulls(len(away), pa.float64())], ["src", "dst", "missed"])
            tail = table.slice(max(0, rows - window))
            new = slice(rows - len(batch), rows)
            keys, codes, reps = np.concatenate([keys, key[new]]), np.concatenate([codes, batch.column("code").to_numpy()]), np.concatenate([reps, rep[new]])
            if len(reps) - window > done:
                yield judged(len(reps) - window, False)
                done = len(reps) - window
                gone = max(0, done - window)
                keys, codes, reps, done, starts = keys[gone:], codes[gone:], reps[gone:], done - gone, starts and not gone
        if len(reps):
            yield judged(len(reps), True)

    return coded.mapInArrow(run, "src bigint, dst bigint, missed double")


def _block_pairs(vectors: DataFrame, group: list[str]) -> DataFrame:
    """The vectors of each two blocks i and j of a group. vectors: with block and blocks, the group's number of them."""
    other = vectors.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("blocks", "o")
    return pairs.repartition(*group, "i", "j").sortWithinPartitions(*group, "i", "j", "rep")


def _in_blocks(vectors: DataFrame, group: list[str], block: int) -> DataFrame:
    sizes = vectors.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return vectors.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))


def _all_links(vectors: DataFrame, threshold: float, block: int) -> DataFrame:
    """src, dst: the links of all vectors of a label, as one from every vector to the lowest it reaches in each pair of blocks."""
    keys = ["label", "dims", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys):
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in keys], 1)
            rep = table.column("rep").to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(table)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                x = _matrix(table.column("vector").slice(a, b - a), int(key[a, 1]))
                low = np.arange(b - a)
                for s in range(0, b - a, CHUNK):
                    i, j = np.nonzero(x[s : s + CHUNK] @ x.T >= threshold)
                    # What is joined already needs no link.
                    new = low[i + s] != low[j]
                    low = lowest(low[i[new] + s], low[j[new]], b - a)[low]
                away = np.flatnonzero(low != np.arange(b - a))
                yield pa.RecordBatch.from_arrays([pa.array(rep[a:b][away]), pa.array(rep[a:b][low[away]])], ["src", "dst"])

    return _block_pairs(_in_blocks(vectors, keys[:2], block), keys[:2]).mapInArrow(run, "src bigint, dst bigint")


def _links(classes: DataFrame, threshold: float, window: int, passes: int, block: int) -> DataFrame:
    """src, dst: links that connect all components."""
    vectors = classes.select("rep", "label", "dims", "vector")
    left, told = vectors, None
    for no in range(ROUNDS):
        # Neighbours on two sides of a partition's edge aren't compared in this pass, and count as missed.
        dealt = _coded(left, passes, no).repartitionByRange("pass", "label", "dims", "code", "rep").sortWithinPartitions("pass", "label", "dims", "code", "rep")
        new = reliable(_window_links(dealt, threshold, window))
        told = new if told is None else told.unionByName(new)
        missed = told.filter("missed is not null").groupBy(F.col("src").alias("rep")).agg(F.sum("missed").alias("missed"))
        # A closed vector's links are found: only those between open ones are sought on.
        left = reliable(left.join(missed.filter(F.col("missed") > math.log(MISS)), "rep", "left_semi"))
        if left.isEmpty():
            return told.filter("dst is not null").select("src", "dst")
    return told.filter("dst is not null").select("src", "dst").unionByName(_all_links(left, threshold, block))


def _shelled(member: DataFrame, threshold: float, block: int) -> DataFrame:
    """The vectors of each two blocks i and j that are to be compared: of one shell (side 0, or of the two blocks 0 and 1), or of a shell (side 0) and the next one (side 1; across is 1)."""
    v = F.col("vector")
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    pivot = member.filter("rep = component").select("component", v.alias("p"))
    both = member.join(pivot, "component")
    cosine = F.aggregate(F.zip_with("vector", "p", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) / (length(v) * length(F.col("p")))
    # A little wider than the angle, for what rounding does to it.
    shell = F.floor(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / (math.acos(threshold) + 1e-6)).cast("int")
    dealt = reliable(_in_blocks(both.withColumn("shell", shell).drop("p"), ["component", "shell"], block))
    keys = ["component", "shell"]
    own = _explained(dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), F.least("block", "o"), F.greatest("block", "o"), F.when(F.col("block") <= F.col("o"), 0).otherwise(1), 0)
    sizes = dealt.select(*keys, "blocks").distinct()
    after = dealt.join(sizes.select("component", (F.col("shell") - 1).alias("shell"), F.col("blocks").alias("others")), keys)
    before = dealt.join(sizes.select("component", (F.col("shell") + 1).alias("shell"), F.col("blocks").alias("others")), keys)
    each = lambda df: df.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).drop("others")
    low = _explained(each(after), F.col("block"), F.col("o"), F.lit(0), 1)
    high = _explained(each(before).withColumn("shell", F.col("shell") - 1), F.col("o"), F.col("block"), F.lit(1), 1)
    every = own.unionByName(low).unionByName(high)
    return every.repartition(*PLACE).sortWithinPartitions(*PLACE, "rep")


#: Where two blocks meet.
PLACE = ["component", "shell", "across", "i", "j"]


def _explained(rows: DataFrame, i: F.Column, j: F.Column, side: F.Column, across: int) -> DataFrame:
    return rows.select("component", "shell", F.lit(across).alias("across"), i.alias("i"), j.alias("j"), side.alias("side"), "rep", "copies", "dims", "vector")


def _counted(blocks: DataFrame, threshold: float) -> DataFrame:
    """rep, links: where two blocks meet, the linked vectors of the other block (or of the same one), copies included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, PLACE):
            key = np.stack([table.column(c).to_numpy() for c in PLACE], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(table)]
            rep, side, copies = (table.column(c).to_numpy() for c in ("rep", "side", "copies"))
            links = np.zeros(len(table), np.int64)
            for a, b in zip(cuts, cuts[1:], strict=False):
                x = _matrix(table.column("vector").slice(a, b - a), int(table.column("dims")[a].as_py()))
                own, n = side[a:b], copies[a:b]
                for s in range(0, b - a, CHUNK):
                    e = min(b - a, s + CHUNK)
                    near = x[s:e] @ x.T >= threshold
                    near[np.arange(e - s), np.arange(s, e)] = False
                    if key[a, 2] or key[a, 3] != key[a, 4]:
                        near &= own[s:e, None] != own
                    links[a + s : a + e] = near @ n
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links)], ["rep", "links"])

    return blocks.mapInArrow(run, "rep bigint, links bigint")


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, passes: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept from rows with vec_id, embedding and label."""
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<float>" if dict(df.dtypes)["embedding"] == "array<float>" else "array<double>").alias("vector"))
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & _usable("vector"), F.lit(False)))
    good = rows.filter("ok").select("vec_id", "label", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    keys = ["label", "h1", "h2"]
    classes = good.groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    classes = reliable(classes.withColumn("dims", F.size("vector")))
    if passes is None:
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
        passes = passes_for(largest or 1, threshold, window)
    found = components(reliable(_links(classes, threshold, window, passes, block)))
    member = classes.join(found.withColumnRenamed("node", "rep"), "rep").select("component", "rep", "copies", "dims", "vector")
    counts = _counted(_shelled(member, threshold, block), threshold).groupBy("rep").agg(F.sum("links").alias("links"))
    judged = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    judged = judged.select(*keys, F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    linked = good.select("vec_id", *keys).join(judged, keys).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors whose cosine is 0.98 or more within a label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op4_near_vectors": op4_near_vectors}
SQL = {
    "op4_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), l AS (
  SELECT a.vec_id AS s, b.vec_id AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT s AS node, d AS reach FROM l UNION SELECT r.node, l.d FROM r JOIN l ON r.reach = l.s
), c AS (SELECT node, min(reach) AS low FROM r GROUP BY node), n AS (SELECT s, count(*) AS k FROM l GROUP BY s)
SELECT e.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.s LEFT JOIN c ON e.vec_id = c.node"""
}
