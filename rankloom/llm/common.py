"""What several operators of this subpackage share: cutting Arrow batches, hashing bytes, folds, checkpoints."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised kernel works on.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def reliable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder that the session names. Where none is named, as in tests, a temporary one will do in a local session; on a cluster that is an error, as other machines would not see it."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


#: Rows of a checkpointed file of gathered(), about.
FILE_ROWS = 20_000


def gathered(df: DataFrame) -> DataFrame:
    """A checkpoint of what may be few rows out of many partitions, in as many files as the rows need: a file for each of thousands of almost empty partitions costs the shared store more than the rows do. The rows are made once, wait on the executors' disks until they are counted, and go from there."""
    held = df.persist(StorageLevel.DISK_ONLY)
    n = held.count()
    out = reliable(held.coalesce(max(1, -(-n // FILE_ROWS))))
    held.unpersist()
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that each part has about limit bytes in column, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each text begins (with the end as a last entry); null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a finaliser of xor-shifts and odd multipliers)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2**64, for i below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 2 * SLICE_BYTES)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


#: A fixed random value for each byte, so that sums of them times powers hash runs of bytes.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each run; equal bytes give equal hashes."""
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, at: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that aren't space (a table of 256 booleans), never over a text's end: starts, ends, and each text's first word's number (with the total as a last entry)."""
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~space[raw]
    edge = inside[1:] & ~inside[:-1]
    stop = inside[:-1] & ~inside[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    joined = cuts[inside[cuts] & inside[cuts + 1]]
    edge[joined] = stop[joined] = True
    starts, ends = np.flatnonzero(edge), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, at)


def text_of(df: DataFrame) -> DataFrame:
    """doc_id and text alone, in the types that the kernels take."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def add_columns(df: DataFrame, fields: list[tuple[str, str, pa.DataType]], kernel, text: str = "text") -> DataFrame:
    """All columns of df, and those that kernel(texts) computes from the text column slice by slice. fields: name, Spark type, Arrow type; a clashing column of df is replaced."""
    from pyspark.sql import types as T

    names = [f[0] for f in fields]
    kept = df.drop(*names)
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t, _ in fields)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                new = kernel(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, t) for v, (_, _, t) in zip(new, fields, strict=True))], [*part.schema.names, *names])

    return kept.mapInArrow(run, schema)


def about(df: DataFrame, key: str, rows: int, group: str | None = None) -> DataFrame:
    """A sample of about rows rows (of each value of group), chosen by a hash of key, so that it is the same on each run. All rows where there are fewer. Few groups are expected."""
    spread = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20))
    if group is None:
        return df.filter(spread < F.lit(rows / max(1, df.count()) * (1 << 20)))
    share = [(r[0], r[1]) for r in df.groupBy(group).count().collect()]
    if not share:
        return df
    limit = F.lit(0.0)
    for value, n in share:
        limit = F.when(F.col(group) == F.lit(value), F.lit(rows / n * (1 << 20))).otherwise(limit)
    return df.filter(spread < limit)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches of whole runs from sorted batches: rows with equal keys never lie in two of them. A run is held in memory, so runs must be bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if held:
            last = held[-1]
            edge = any(c[0] != last.column(k)[last.num_rows - 1].as_py() for c, k in zip(columns, keys, strict=True))
            if edge:
                yield pa.Table.from_batches(held)
                held = []
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        if len(change):
            yield pa.Table.from_batches([*held, batch.slice(0, int(change[-1]))])
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def lowest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The lowest number that each of n items reaches over the links i-j."""
    low = np.arange(n)
    while True:
        both = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, both)
        np.minimum.at(new, j, both)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def unused(name: str, columns: list[str]) -> str:
    """name, made longer until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def keep_where(docs: DataFrame, made: list[str], judge, condition: str) -> DataFrame:
    """The rows of docs for which the columns made by judge(docs) meet a condition; columns of docs with the same names come back as they were."""
    taken = {c: unused(f"own_{c}", docs.columns) for c in docs.columns if c.lower() in made}
    kept = judge(docs.withColumnsRenamed(taken)).filter(condition)
    return kept.select(*[F.col(taken.get(c, c)).alias(c) for c in docs.columns])
