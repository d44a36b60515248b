"""A versioned key-value table over a log of puts: (row_key, col, val, version).

The log is only appended to; the state of a cell is its value of the highest version.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlake.operators.skew import heavy_key_hashes, salted_join

PAGE = 10


def cells(log: DataFrame, at_version: int | None = None) -> DataFrame:
    """(row_key, col, val, version) of the current cells, or of those at a version."""
    if at_version is not None:
        log = log.where(F.col("version") <= at_version)
    last = log.groupBy("row_key", "col").agg(F.max(F.struct("version", "val")).alias("c"))
    return last.select("row_key", "col", F.col("c.val").alias("val"), F.col("c.version").alias("version"))


def rows(log: DataFrame, at_version: int | None = None) -> DataFrame:
    """(row_key, cols): each row with a map of its cells."""
    pair = F.struct("col", "val")
    return cells(log, at_version).groupBy("row_key").agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("cols"))


def put(log: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """The log with puts (row_key, col, val) under versions above all others of their row.

    `order` names a whole-number column of `new` that says which put came first; versions follow it,
    so that the last put to a cell stands. It needs no sorting, and versions may have gaps. Without it
    all puts are made at once, and of several to one cell the largest value stands.
    """
    top = log.groupBy("row_key").agg(F.max("version").alias("top"))
    later = F.lit(0)
    if order is not None:
        first = new.agg(F.min(order)).first()[0]
        later = F.col(order).cast("long") - F.lit(0 if first is None else int(first))
    heavy = heavy_key_hashes(new.select("row_key"), ["row_key"], 0.01)
    salted = salted_join(new.withColumn("__later", later), top, ["row_key"], ["col", "val", "__later"], heavy, how="left")
    version = F.coalesce("top", F.lit(0)).cast("long") + 1 + F.col("__later")
    return log.unionByName(salted.withColumn("version", version).select("row_key", "col", "val", "version"))


def put_rows(state: DataFrame, new: DataFrame) -> DataFrame:
    """Cells with whole rows replaced: no cell of an old row with a new row's key stays."""
    kept = state.join(new.select("row_key").distinct(), "row_key", "left_anti")
    return kept.select("row_key", "col", "val").unionByName(new.select("row_key", "col", "val"))


def compare_and_set(state: DataFrame, wishes: DataFrame) -> DataFrame:
    """(row_key, col, val, done) of wishes (row_key, col, expected, val): done where the cell exists and has the expected value."""
    now = state.select("row_key", "col", F.col("val").alias("now"))
    tried = wishes.join(now, ["row_key", "col"], "left")
    return tried.select("row_key", "col", "val", F.coalesce(F.col("now") == F.col("expected"), F.lit(False)).alias("done"))


def get_row(log: DataFrame, key: str) -> DataFrame:
    return rows(log.where(F.col("row_key") == key))


def get_rows(log: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The rows of several keys; those that don't exist are missing."""
    return rows(log.where(F.col("row_key").isin(list(keys))))


def get_cell(log: DataFrame, key: str, col: str, at_version: int | None = None) -> DataFrame:
    return cells(log.where((F.col("row_key") == key) & (F.col("col") == col)), at_version).select("val", "version")


def exists(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(row_key, found) of a frame of keys."""
    there = log.select("row_key").distinct().withColumn("found", F.lit(True))
    return keys.select("row_key").distinct().join(there, "row_key", "left").select("row_key", F.coalesce("found", F.lit(False)).alias("found"))


def scan(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= key < end, in order of keys; the range reaches the files."""
    if start is not None:
        log = log.where(F.col("row_key") >= start)
    if end is not None:
        log = log.where(F.col("row_key") < end)
    return rows(log).orderBy("row_key")


def page(log: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """A page of rows by key; pages are numbered from 0."""
    return rows(log).orderBy("row_key").offset(number * size).limit(size)


def row_hashes(log: DataFrame) -> DataFrame:
    """(row_key, hash) over a row's cells by column, for comparing two copies of a table. A null value differs from an empty one."""
    entries: Column = F.array_sort(F.map_entries("cols"))
    texts = F.transform(entries, lambda e: F.concat(e["key"], F.coalesce(F.concat(F.lit("="), e["value"]), F.lit("!"))))
    return rows(log).select("row_key", F.md5(F.array_join(texts, "\x1f")).alias("hash"))


def differing_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys whose rows differ between two tables, or that one of them lacks."""
    left, right = row_hashes(a).withColumnRenamed("hash", "ha"), row_hashes(b).withColumnRenamed("hash", "hb")
    return left.join(right, "row_key", "full_outer").where("NOT (ha <=> hb)").select("row_key")
