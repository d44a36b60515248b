"""Sources and sinks of keyed tables and of line files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parallelize(spark: SparkSession, values: Iterable[str]) -> DataFrame:
    """(key, value) of a list; keys are places from 0 on."""
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "key string, value string")


def from_table(df: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, value) of a table; rows whose value is null are left out."""
    return df.select(F.col(key).cast("string").alias("key"), value.alias("value")).where(F.col("value").isNotNull())


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The trimmed lines of a text file (seeds, blacklists, stop words), without empty ones and comments."""
    trimmed = spark.read.text(path).select(F.trim("value").alias("value"))
    return trimmed.where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same keys.

    Rows of one key in `new` all come in; null keys are keys like others.
    """
    same = F.lit(True)
    named = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return old.join(named, same, "left_anti").unionByName(new, allowMissingColumns=True)


def save(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Write a table as Parquet; `overwrite`, `append`, `ignore` or `error`."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]) -> str:
    """Upsert into a stored table in place; its path is returned.

    The result is written beside the table, which then makes way for it; a write that is cut off
    leaves the table as it was. If the change of names was cut off, the next call ends it first.
    """
    files, old = _at(spark, path)
    (_, beside), (_, before) = _at(spark, f"{path}.next"), _at(spark, f"{path}.before")
    if not files.exists(old) and files.exists(beside):
        files.rename(beside, old)
    files.delete(before, True)
    upsert(spark.read.parquet(path), new, keys).write.mode("overwrite").parquet(f"{path}.next")
    if not (files.rename(old, before) and files.rename(beside, old)):
        raise OSError(f"{path} couldn't be replaced")
    files.delete(before, True)
    spark.catalog.refreshByPath(path)
    return path


def _at(spark: SparkSession, path: str):
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), java


class TableHandle:
    """A table of the catalog that can be destroyed; after that, its use is an error."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.destroyed = spark, name, False

    def frame(self) -> DataFrame:
        if self.destroyed:
            raise RuntimeError(f"{self.name} was destroyed")
        return self.spark.table(self.name)

    def destroy(self) -> None:
        self.frame()
        drop_tables(self.spark, [self.name])
        self.destroyed = True


def drop_tables(spark: SparkSession, names: Iterable[str]) -> list[str]:
    """Drop the named tables that exist, and say which did."""
    dropped = [n for n in names if spark.catalog.tableExists(n)]
    for n in dropped:
        spark.sql(f"DROP TABLE IF EXISTS `{n}`")
    return dropped


def list_tables(spark: SparkSession) -> list[str]:
    """The names of all tables and views, in order."""
    return sorted(t.name for t in spark.catalog.listTables())


def rename_table(spark: SparkSession, old: str, new: str) -> None:
    """Rename a table; it must exist, and the new name be free."""
    if not spark.catalog.tableExists(old):
        raise KeyError(old)
    if spark.catalog.tableExists(new):
        raise FileExistsError(new)
    spark.sql(f"ALTER TABLE `{old}` RENAME TO `{new}`")


def save_as_table(df: DataFrame, name: str, bucket_by: Sequence[str] = (), buckets: int = 64) -> None:
    """Write a table of the catalog, bucketed and sorted by columns that later joins use, so that those need no shuffle."""
    writer = df.write.mode("overwrite")
    (writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by) if bucket_by else writer).saveAsTable(name)


def set_concurrency(spark: SparkSession, n: int) -> None:
    """The number of partitions of shuffles, at least 1; adaptive execution joins small ones."""
    spark.conf.set("spark.sql.shuffle.partitions", max(1, n))


def show(df: DataFrame, rows: int = 100) -> str:
    """The first rows as lines of text, or "No output"."""
    lines_ = ["\t".join("" if v is None else str(v) for v in r) for r in df.limit(rows).collect()]
    return "\n".join(lines_) or "No output"
