"""A keyed table in versions: rows are added in files of their own, and a manifest says which files a version has.

A version comes into being when its manifest is renamed to its number, which fails where the number is taken; so a run that ends before that leaves
nothing but unused files, and of two writers one sees that it was late and takes the next number with the other's rows in it. Writing costs
as much as the new rows: they are dealt into parts by a hash of their keys, and a part whose files have become many is merged alone.
Readers get the last row of each key. Only manifests (names of folders by part) reach the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.warehouse import last_writes

#: Parts of a table; folders of a part before they are merged.
PARTS, MOST = 32, 8


class Conflict(Exception):
    """Another writer has taken the number."""


def _path(spark: SparkSession, *names: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(names))


def _files(spark: SparkSession, table: str):
    return _path(spark, table).getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, table: str) -> list[int]:
    """The versions that a table has."""
    files, folder = _files(spark, table), _path(spark, table, "manifests")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.partition(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit())


def manifest(spark: SparkSession, table: str, number: int | None = None) -> dict | None:
    """What a version is made of (the newest one by default)."""
    known = numbers(spark, table)
    if not known:
        return None
    path = f"{table}/manifests/{known[-1] if number is None else number}.json"
    return json.loads(spark.sparkContext.wholeTextFiles(path, 1).values().first())


def _commit(spark: SparkSession, table: str, made: dict) -> None:
    """Gives a version its manifest, or raises Conflict where another writer was first."""
    files, jvm = _files(spark, table), spark._jvm
    start = _path(spark, table, "manifests", f"_{uuid.uuid4().hex}.tmp")
    out = files.create(start, True)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    place = files.makeQualified(_path(spark, table, "manifests", f"{made['number']}.json"))
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(start), place, how)
    except Exception as e:
        files.delete(start, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {made['number']} of {table} is taken") from e
        raise


def _read(spark: SparkSession, table: str, folders: dict[str, list[str]]) -> DataFrame | None:
    paths = [f"{table}/data/{name}/_part={part}" for part, names in folders.items() for name in names]
    return spark.read.option("mergeSchema", True).parquet(*paths) if paths else None


def read(spark: SparkSession, table: str, keys: list[str], order: str, number: int | None = None) -> DataFrame | None:
    """The last row of each key in a version (the newest one by default), with the least first_seen; None where there is no version."""
    made = manifest(spark, table, number)
    rows = made and _read(spark, table, made["folders"])
    return None if rows is None else last_writes(rows, keys, order)


def _written(spark: SparkSession, table: str, rows: DataFrame, keys: list[str], parts: int) -> tuple[str, list[str]]:
    """The rows in a folder of their own, and which parts it has."""
    name = uuid.uuid4().hex
    rows.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts))).repartition("_part").write.partitionBy("_part").parquet(f"{table}/data/{name}")
    found = [s.getPath().getName() for s in _files(spark, table).listStatus(_path(spark, table, "data", name))]
    return name, [n.partition("=")[2] for n in found if n.startswith("_part=")]


def add(spark: SparkSession, table: str, rows: DataFrame, keys: list[str], order: str, source: str | None = None, batch: int | None = None, parts: int = PARTS, most: int = MOST, tries: int = 20) -> int:
    """Adds rows and returns the version that has them. A key's last row by order counts; a row's first_seen is its order where it has none. A batch of a source that a version already has is not added again."""
    if "first_seen" not in rows.columns:
        rows = rows.withColumn("first_seen", F.col(order))
    old = manifest(spark, table) or {"number": -1, "parts": parts, "folders": {}, "batches": {}}
    if source is not None and old["batches"].get(source, -1) >= batch:
        return old["number"]
    name, touched = _written(spark, table, last_writes(rows, keys, order), keys, old["parts"])
    for _ in range(tries):
        made = {"number": old["number"] + 1, "parts": old["parts"], "folders": {p: list(n) for p, n in old["folders"].items()}, "batches": dict(old["batches"])}
        for part in touched:
            made["folders"].setdefault(part, []).append(name)
        if source is not None:
            made["batches"][source] = batch
        full = {p: n for p, n in made["folders"].items() if len(n) > most}
        if full:
            merged, there = _written(spark, table, last_writes(_read(spark, table, full).drop("_part"), keys, order), keys, old["parts"])
            made["folders"].update({p: [merged] if p in there else [] for p in full})
        try:
            _commit(spark, table, made)
            return made["number"]
        except Conflict:
            old = manifest(spark, table)
            if source is not None and old["batches"].get(source, -1) >= batch:
                return old["number"]
    raise Conflict(f"{table}: {tries} tries")


def expire(spark: SparkSession, table: str, keep: int = 3, safe: set[str] = frozenset()) -> list[int]:
    """Drops all but the newest versions, and the files that none of the rest has; returns the versions dropped. Folders of no version at all are left, as a writer may be about to name them."""
    known = numbers(spark, table)
    old, rest = known[:-keep], known[-keep:]
    if not old:
        return []
    files = _files(spark, table)
    held = {n for k in rest for names in manifest(spark, table, k)["folders"].values() for n in names}
    gone = {n for k in old for names in manifest(spark, table, k)["folders"].values() for n in names} - held - set(safe)
    for k in old:
        files.delete(_path(spark, table, "manifests", f"{k}.json"), False)
    for n in gone:
        files.delete(_path(spark, table, "data", n), True)
    return old
