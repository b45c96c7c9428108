"""Connected components: edges contracted in partitions of bounded size, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import gathered, lowest, reliable


def forest(edges: DataFrame) -> DataFrame:
    """src, dst: in each partition, the edges replaced by one from every node to the lowest it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 2), np.int64)
        for batch in batches:
            kept = np.concatenate([kept, np.stack([batch.column(c).to_numpy() for c in (0, 1)], 1)])
            ids, place = np.unique(kept, return_inverse=True)
            place = place.reshape(-1, 2)
            low = lowest(place[:, 0], place[:, 1], len(ids))
            away = low != np.arange(len(ids))
            kept = np.stack([ids[away], ids[low[away]]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["src", "dst"])

    return edges.select("src", "dst").mapInArrow(run, "src bigint, dst bigint")


#: Edges of a partition in which they are contracted at once.
EDGES_AT_ONCE = 500_000


def _contracted(edges: DataFrame, at_once: int) -> tuple[DataFrame, int]:
    """The edges, contracted in partitions of about at_once, and these partitions' number."""
    parts = max(1, -(-edges.count() // at_once))
    return reliable(forest(edges.coalesce(parts))), parts


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def _lowest_around(edges: DataFrame) -> DataFrame:
    """The edges with the lowest node m among src and its neighbours; the minima are joined back, so that a node of very many edges can be split."""
    low = gathered(edges.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m")))
    return edges.join(low, "src")


def components(edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """node, component for every node of the edges src-dst: the lowest node that it reaches.

    Edges are contracted to forests in partitions of bounded size; as long as there are several such
    partitions, large and small stars connect them, until nothing changes. edges should be at hand (a
    checkpoint or table), as they are counted first. Only counts and checksums reach the driver.
    """
    e, parts = _contracted(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")), at_once)
    before = None
    while parts > 1 and (now := _state(e)) != before:
        before = now
        both = gathered(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        large = _lowest_around(both).filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        low = _lowest_around(gathered(large))
        ends = F.array(F.struct(F.col("src").alias("src"), F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))
        small = low.select(F.explode(ends).alias("x")).select("x.*").filter("src <> dst")
        e, _ = _contracted(gathered(small), at_once)
    roots = e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
