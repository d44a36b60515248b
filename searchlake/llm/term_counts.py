"""Problem 6: occurrences and page counts of every term, kept up by signed deltas.

A store in the shared folder holds a log of cell versions in buckets of (term, url), and merged counts
in buckets of the term and of the url. A batch reads only the buckets of the cells that it names,
turns each added, changed or deleted cell into a signed difference of occurrences and pages, sums
those per term, and merges the sums into the counts of the buckets that they touch; other buckets
stay as they are. The files of a batch come first and its manifest, which names the current files of
each bucket, last and under its name at once: a batch that was cut off leaves the store as it was,
and a store that is opened again, by another session too, goes on from the last manifest. A batch
has an id of its caller's; one whose id is in the manifest is not taken in again.

Nulls: cells without term or url take no part; a cell whose tf is null is deleted. A cell that is
given several times in a batch counts once, with its largest tf. An empty batch changes nothing.
One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.functions.postings import explode_postings
from searchlake.llm.distinctive_terms import CELLS_SQL
from searchlake.session import scratch_path, table


def replace_rule(old: Column, new: Column) -> Column:
    """A cell's new tf is the one given; null deletes it."""
    return new


def largest_rule(old: Column, new: Column) -> Column:
    """A cell keeps the largest tf ever given."""
    return F.greatest(old, new)


def _file_system(spark: SparkSession, path: str):
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), java


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it isn't there."""
    files, at = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


class TermCountStore:
    """Persistent counts per term. `buckets` holds for a new store; one that is there keeps its own."""

    #: A bucket with so many batches of cell versions is written anew as one.
    LONGEST_LOG = 16

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path
        there = [n for n in _names(spark, f"{path}/manifest") if n.endswith(".json")]
        text = "".join(r[0] for r in spark.read.text(f"{path}/manifest/{there[-1]}", wholetext=True).collect()) if there else ""
        # bucket -> batches of its cell log, and -> the batch that wrote its counts
        self.state = json.loads(text) if text else {"buckets": buckets, "next": 0, "done": [], "pages": 0, "cells": {}, "terms": {}, "urls": {}}

    def _bucket(self, *columns: str) -> Column:
        """The number of the partition that Spark's own hash gives a row, so that a shuffle by these columns makes one task a bucket."""
        return F.pmod(F.hash(*columns), F.lit(self.state["buckets"])).cast("int").alias("bucket")

    def _write(self, df: DataFrame, kind: str, k: int) -> list[str]:
        """Write rows by bucket as part k, and say which buckets they have. What a cut-off batch left there is replaced."""
        df.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/part={k}")
        return [n.partition("=")[2] for n in _names(self.spark, f"{self.path}/{kind}/part={k}") if n.startswith("bucket=")]

    def _read(self, kind: str, buckets: list[str] | None = None) -> DataFrame | None:
        held = self.state[kind]
        parts = [(k, b) for b in (held if buckets is None else buckets) if b in held for k in (held[b] if isinstance(held[b], list) else [held[b]])]
        if not parts:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/part={k}/bucket={b}" for k, b in parts])

    def _commit(self, state: dict) -> None:
        files, temporary = _file_system(self.spark, f"{self.path}/manifest/{state['next']:09d}.tmp")
        out = files.create(temporary, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not files.rename(temporary, _file_system(self.spark, f"{self.path}/manifest/{state['next']:09d}.json")[1]):
            raise OSError(f"the manifest of {self.path} couldn't be written: there is another writer")
        self.state = state

    def cells(self, buckets: list[str] | None = None) -> DataFrame | None:
        """The current cells (bucket, term, url, tf), or those of some buckets."""
        log = self._read("cells", buckets)
        if log is None:
            return None
        last = log.select("term", "url", "tf", "part").repartition(self.state["buckets"], "term", "url").groupBy("term", "url").agg(F.max_by(F.struct("tf"), "part").alias("c"))
        return last.select(self._bucket("term", "url"), "term", "url", "c.tf").where("tf IS NOT NULL")

    def apply(self, batch: DataFrame, rule: Callable[[Column, Column], Column] = replace_rule, batch_id: str | None = None) -> bool:
        """Take in a batch of cells (term, url, tf), tf being null for deleted ones; false if its id was taken in before."""
        k, n = self.state["next"], self.state["buckets"]
        batch_id = f"batch {k}" if batch_id is None else batch_id
        if batch_id in self.state["done"]:
            return False
        named = batch.where("term IS NOT NULL AND url IS NOT NULL").select("term", "url", "tf")
        # one shuffle: a task has the rows of one bucket
        new = named.repartition(n, "term", "url").groupBy("term", "url").agg(F.max("tf").alias("new")).withColumn("bucket", self._bucket("term", "url"))
        old = None
        if self.state["cells"]:
            touched = self._write(new, "named", k)
            new = self.spark.read.schema(new.schema).parquet(f"{self.path}/named/part={k}")
            old = self.cells(touched)
        both = new.withColumn("old", F.lit(None).cast("long")) if old is None else new.repartition(n, "term", "url").join(old.select("term", "url", F.col("tf").alias("old")), ["term", "url"], "left")
        changed = both.withColumn("tf", rule(F.col("old"), F.col("new"))).where("NOT (tf <=> old)").select("bucket", "term", "url", "tf", "old")
        state = json.loads(json.dumps(self.state)) | {"next": k + 1, "done": [*self.state["done"], batch_id]}
        for b in self._write(changed, "cells", k):
            state["cells"].setdefault(b, []).append(k)
        # the deltas are made of the written cells, so that counts and cells hold the same batch
        done = self.spark.read.schema(changed.schema).parquet(f"{self.path}/cells/part={k}")
        pages = F.col("tf").isNotNull().cast("long") - F.col("old").isNotNull().cast("long")
        signed = done.select("term", "url", (F.coalesce("tf", F.lit(0)) - F.coalesce("old", F.lit(0))).alias("occurrences"), pages.alias("pages"))
        self._merge(state, "terms", signed.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("pages").alias("pages")), k)
        state["pages"] += self._merge(state, "urls", signed.groupBy("url").agg(F.sum("pages").alias("pages")).where("pages <> 0"), k)
        self._commit(state)
        if any(len(parts) >= self.LONGEST_LOG for parts in state["cells"].values()):
            self.compact()
        return True

    def _merge(self, state: dict, kind: str, deltas: DataFrame, k: int) -> int:
        """Add deltas to the counts of the buckets that they touch; by how many keys the counts have grown."""
        key, *sums = deltas.columns
        n = self.state["buckets"]
        deltas = deltas.repartition(n, key).select(self._bucket(key), key, *sums)
        first = not self.state[kind]
        touched = self._write(deltas, kind if first else f"{kind}-deltas", k)
        if not touched:
            return 0
        old = self._read(kind, touched)
        if old is not None:
            schema = deltas.schema
            deltas = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}-deltas/part={k}")
            both = deltas.unionByName(old.select("bucket", key, *sums)).repartition(n, key).groupBy(key).agg(*[F.sum(c).alias(c) for c in sums])
            self._write(both.where("pages > 0").select(self._bucket(key), key, *sums), kind, k)
        elif not first:
            self._write(self.spark.read.schema(deltas.schema).parquet(f"{self.path}/{kind}-deltas/part={k}").where("pages > 0"), kind, k)
        now = {n.partition("=")[2] for n in _names(self.spark, f"{self.path}/{kind}/part={k}") if n.startswith("bucket=")}
        for b in touched:
            state[kind].pop(b, None)
            if b in now:
                state[kind][b] = k
        if kind == "terms":
            return 0
        new = self.spark.read.parquet(*[f"{self.path}/{kind}/part={k}"]).count() if now else 0
        return new - (0 if old is None else old.count())

    def compact(self) -> None:
        """Write the cell log of buckets with several batches anew as one."""
        k = self.state["next"]
        long = [b for b, parts in self.state["cells"].items() if len(parts) > 1]
        if not long:
            return
        now = self._write(self.cells(long).withColumn("old", F.lit(None).cast("long")), "cells", k)
        cells = {b: parts for b, parts in self.state["cells"].items() if b not in long} | {b: [k] for b in now}
        self._commit(json.loads(json.dumps(self.state)) | {"next": k + 1, "cells": cells})

    def counts(self) -> DataFrame:
        """(term, occurrences, pages) of every term that is on a page."""
        counts = self._read("terms")
        if counts is None:
            return self.spark.createDataFrame([], "term string, occurrences long, pages long")
        return counts.select("term", "occurrences", "pages").where("pages > 0")

    def n_pages(self) -> int:
        """The number of pages with any term."""
        return self.state["pages"]

    def marked(self, rare: int = 2, common: float = 0.5) -> DataFrame:
        """counts() with a mark: `rare` for at most `rare` pages, else `common` for more than that share of pages, else null."""
        limit = F.lit(self.n_pages()) * F.lit(common)
        mark = F.when(F.col("pages") <= rare, "rare").when(F.col("pages") > limit, "common")
        return self.counts().withColumn("mark", mark)


def index_counts(spark: SparkSession, folder: str) -> TermCountStore:
    """The store of pt_index, taken in as two batches: the rows up to the day before the last, then the rest.

    The second batch has new cells and cells that were indexed again with other counts.
    """
    index = table(spark, folder, "pt_index")
    cut = index.agg((F.max("indexed_at") - F.expr("interval 1 day")).cast("string")).first()[0]
    late = F.coalesce(F.col("indexed_at") > F.lit(cut).cast("timestamp"), F.lit(False))
    path, buckets = scratch_path(spark, "term-counts"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for batch_id, rows in (("before", index.where(~late)), ("last day", index.where(late))):
        # opened for each batch, as a job of that day would
        TermCountStore(spark, path, buckets).apply(explode_postings(rows), largest_rule, batch_id)
    return TermCountStore(spark, path)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The terms too rare or too common to help a search."""
    return index_counts(spark, folder).marked().where("mark IS NOT NULL").select("term", "mark")


def p6_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its occurrences, pages and mark."""
    return index_counts(spark, folder).marked()


QUERIES = {"p6_found": p6_found, "p6_term_counts": p6_term_counts}

_COUNTS = f"""WITH {CELLS_SQL}, t AS (SELECT term, sum(tf)::bigint AS occurrences, count(*) AS pages FROM cells GROUP BY term),
    m AS (SELECT *, CASE WHEN pages <= 2 THEN 'rare' WHEN pages > 0.5 * (SELECT count(DISTINCT url) FROM cells) THEN 'common' END AS mark FROM t)"""

SQL = {
    "p6_found": _COUNTS + " SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p6_term_counts": _COUNTS + " SELECT * FROM m",
}
