"""Transformations of values and of pairs, as thin functions over typed columns.

A value frame has (key, value), a pair frame (k, v) with any number of rows a key. Functions take
columns and give columns, so that all of it stays in one plan. Null results are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlake.operators.skew import SALT, heavy_key_hashes, salt_column, salted_join


def flat_map(df: DataFrame, f: Callable[[Column], Column], value: str = "value") -> DataFrame:
    """One row an element of the array that f makes of a value."""
    return df.select(F.explode(f(F.col(value))).alias("value")).where("value IS NOT NULL")


def flat_map_to_pair(df: DataFrame, f: Callable[[Column], Column], value: str = "value") -> DataFrame:
    """One pair an element of the array of (k, v) structs that f makes of a value; repeated pairs stay."""
    each = df.select(F.explode(f(F.col(value))).alias("pair")).where("pair IS NOT NULL")
    return each.select("pair.k", "pair.v").where("k IS NOT NULL AND v IS NOT NULL")


def map_to_pair(df: DataFrame, k: Column, v: Column) -> DataFrame:
    return df.select(k.alias("k"), v.alias("v")).where("k IS NOT NULL AND v IS NOT NULL")


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def map_partitions(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Arrow batches of each partition through a function of an iterator."""
    return df.mapInPandas(f, schema)


def hash_sample(df: DataFrame, p: float, value: str = "value") -> DataFrame:
    """Each value with probability p, decided by its own hash: the same values at every run."""
    if p <= 0:
        return df.limit(0)
    if p >= 1:
        return df
    share = F.conv(F.substring(F.sha1(F.col(value).cast("string")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    return df.where(share < p)


def distinct_values(df: DataFrame, value: str = "value") -> DataFrame:
    return df.select(F.col(value).alias("value")).where("value IS NOT NULL").distinct()


def intersection(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """The distinct values of a that are also in b. Null matches nothing."""
    return distinct_values(a, value).join(distinct_values(b, value), "value", "left_semi")


#: Values that one key may have where they all become one row; more are an error, not a task that never ends.
LONGEST_GROUP = 20_000_000


def bounded(pairs: DataFrame, longest: int | None = None) -> DataFrame:
    """The pairs, if no key has more values than may become one row. Counts are combined before their shuffle."""
    longest = LONGEST_GROUP if longest is None else longest
    top = pairs.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(1).collect()
    if top and top[0]["n"] > longest:
        raise ValueError(f"key {top[0]['k']!r} has {top[0]['n']} values, more than {longest} for one row; use aggregate_by_key() or a merge")
    return pairs


def group_values(pairs: DataFrame, separator: str = ",") -> DataFrame:
    """(k, value): each key's values in order, joined; an order makes the result the same at every run.

    A key's result is one row, so that its values must fit one: see bounded().
    """
    pairs = bounded(pairs)
    return pairs.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("v")), separator).alias("value"))


def fold_by_key(pairs: DataFrame, zero: Column, f: Callable[[Column, Column], Column], merge: Callable[[Column, Column], Column] | None = None, salts: int = 64) -> DataFrame:
    """(k, value): a left fold over each key's values in ascending order.

    With `merge`, which joins two results and must not depend on their order, the values of heavy keys are
    folded in salts first; `zero` must then be neutral. Without it a key's values must fit one row: see
    bounded(). For sums, extremes and the like use aggregate_by_key(), which combines before the shuffle.
    """
    if merge is not None:
        heavy = heavy_key_hashes(pairs.select("k"), ["k"], 0.005)
        hashed = pairs.withColumn(SALT, salt_column(["k"], heavy, ["v"], salts))
        parts = hashed.groupBy("k", SALT).agg(F.aggregate(F.array_sort(F.collect_list("v")), zero, f).alias("part"))
        return parts.groupBy("k").agg(F.reduce(F.collect_list("part"), zero, merge).alias("value"))
    pairs = bounded(pairs)
    return pairs.groupBy("k").agg(F.aggregate(F.array_sort(F.collect_list("v")), zero, f).alias("value"))


def aggregate_by_key(pairs: DataFrame, aggregate: Column) -> DataFrame:
    return pairs.groupBy("k").agg(aggregate.alias("value"))


def fold_concat(pairs: DataFrame, separator: str) -> DataFrame:
    pairs = bounded(pairs)
    return pairs.groupBy("k").agg(F.expr(f"listagg(v, '{separator}') WITHIN GROUP (ORDER BY v)").alias("value"))


def join_pairs(a: DataFrame, b: DataFrame, separator: str = ",") -> DataFrame:
    """(k, value): every pair of values of a key that both sides have. Rows of the left side's heavy keys are spread over salts."""
    left, right = a.select("k", F.col("v").alias("va")), b.select("k", F.col("v").alias("vb"))
    return salted_join(left, right, ["k"], ["va"], heavy_key_hashes(left.select("k"), ["k"], 0.01)).select("k", F.concat_ws(separator, "va", "vb").alias("value"))


def cogroup(a: DataFrame, b: DataFrame) -> DataFrame:
    """(k, left, right): the sorted values of each side; a side without the key is empty. A key's values must fit one row: see bounded()."""
    a, b = bounded(a), bounded(b)
    left = a.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("left"))
    right = b.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("right"))
    both = left.join(right, "k", "full_outer")
    return both.select("k", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("left", "right")])


def cogroup_text(a: DataFrame, b: DataFrame) -> DataFrame:
    """cogroup() with each row as the text `[a1,a2],[b1]`."""
    listed = [F.concat(F.lit("["), F.array_join(c, ","), F.lit("]")) for c in ("left", "right")]
    return cogroup(a, b).select("k", F.concat_ws(",", *listed).alias("value"))


def fold(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row of aggregates over all rows, made of partial ones."""
    return df.agg(*aggregates)


def take(df: DataFrame, n: int, key: str = "key") -> DataFrame:
    """The first n rows by key; none for n of 0 or less."""
    return df.orderBy(key).limit(max(n, 0))
