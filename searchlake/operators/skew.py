"""Per-key work when a few keys hold most of the rows.

`salted_aggregate` is a two-stage aggregation: rows of heavy keys get a salt, partial results
are made per key and salt, and the partials are merged by the key alone. `salted_join` does the
same for a join with a table of one row a key.

The salt is a hash of a row's own values with a seed, not `rand()`: it is spread like a random
number, but a task that runs again after a lost executor gives each row the same salt again.
Salting a key or not never changes a result, so a hash collision among keys is harmless.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SALT, KEY = "__salt", "__key_hash"


@dataclass(frozen=True)
class Measure:
    """A result per key: `partial` aggregates rows, `merge` aggregates the partials' column."""

    name: str
    partial: Column
    merge: str  # one of sum, min, max

    def merged(self) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.merge](F.col(self.name)).alias(self.name)


def count_rows(name: str) -> Measure:
    return Measure(name, F.count(F.lit(1)), "sum")


def sum_of(name: str, value: Column) -> Measure:
    return Measure(name, F.sum(value), "sum")


def max_of(name: str, value: Column) -> Measure:
    return Measure(name, F.max(value), "max")


def min_of(name: str, value: Column) -> Measure:
    return Measure(name, F.min(value), "min")


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def heavy_share(spark: SparkSession, share: float) -> float:
    """A share of all rows, but at most what falls to four of the shuffle's partitions.

    A key of less than that is a small burden to its task, however large the table and the cluster are.
    """
    return min(share, 4 / max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def heavy_key_hashes(df: DataFrame, keys: Sequence[str], share: float = 0.005, weight: Column | None = None) -> list[int]:
    """Hashes of the keys that hold at least `share` of all rows (or of all `weight`), less on a large cluster.

    At most 1/share keys can, so that the list's size is bounded whatever the data. One pass reads the
    key columns alone; counts are combined before their shuffle, and the total is observed on the way.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    share = heavy_share(df.sparkSession, share)
    weight = F.lit(1) if weight is None else weight
    seen = Observation()
    counts = df.groupBy(key_hash(keys).alias(KEY)).agg(F.sum(weight).cast("double").alias("n")).observe(seen, F.sum("n").alias("total"))
    first = counts.orderBy(F.desc("n")).limit(int(1 / share) + 1).collect()
    total = (seen.get["total"] or 0.0) if first else 0.0
    return [r[KEY] for r in first if total and r["n"] is not None and r["n"] >= share * total]


def salt_column(keys: Sequence[str], heavy: Sequence[int], salt_by: Sequence[str], salts: int, seed: int = 11) -> Column:
    """0 for rows of light keys, a value below `salts` for rows of heavy ones."""
    if not heavy:
        return F.lit(0)
    spread = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in salt_by]), F.lit(salts)).cast("int")
    return F.when(key_hash(keys).isin(list(heavy)), spread).otherwise(F.lit(0))


def salted_aggregate(
    df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], salt_by: Sequence[str], share: float = 0.005, salts: int = 64
) -> DataFrame:
    """One row a key with all `measures`, in two stages.

    `salt_by` names columns that differ among the rows of a key (an id). A null key is a key of
    its own. An empty table gives no rows. Columns that are neither keys nor read by a measure
    don't matter; a key may not have a measure's name.
    """
    names = [m.name for m in measures]
    if set(names) & set(keys) or len(set(names)) < len(names):
        raise ValueError("names of measures must differ from each other and from the keys")
    heavy = heavy_key_hashes(df, keys, share)
    salted = df.withColumn(SALT, salt_column(keys, heavy, salt_by, salts))
    partial = salted.groupBy(*keys, SALT).agg(*[m.partial.alias(m.name) for m in measures])
    return partial.groupBy(*keys).agg(*[m.merged() for m in measures])


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], salt_by: Sequence[str], heavy: Sequence[int], salts: int = 32, how: str = "inner"
) -> DataFrame:
    """Join rows with a table of one row a key; rows of `heavy` keys go to `salts` tasks.

    The right side's rows of heavy keys, of which there are at most as many as `heavy` has
    entries, are copied once a salt. Null keys match nothing, as in SQL.
    """
    if not heavy:
        return left.join(right, list(keys), how)
    one = F.array(F.lit(0))
    copies = F.when(key_hash(keys).isin(list(heavy)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(one)
    right = right.withColumn(SALT, F.explode(copies))
    left = left.withColumn(SALT, salt_column(keys, heavy, salt_by, salts))
    return left.join(right, [*keys, SALT], how).drop(SALT)


def salted_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column, salt_by: Sequence[str], heavy: Sequence[int], salts: int = 64) -> DataFrame:
    """The first n rows of each key in an order; heavy keys are first cut to n rows a salt. n may differ by key."""
    from pyspark.sql import Window

    def first(frame: DataFrame, by: Sequence[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return frame.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")

    if heavy:
        df = first(df.withColumn(SALT, salt_column(keys, heavy, salt_by, salts)), [*keys, SALT]).drop(SALT)
    return first(df, keys)
