"""Queries of the key-value table, over events as a log of puts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.operators import kvtable as kv
from searchlake.session import table


def log_of(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, event_type and value as row, column and value; event_id is the order of writing."""
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").cast("string").alias("row_key"), F.col("event_type").alias("col"), F.col("value").cast("string").alias("val"), F.col("event_id").alias("version"))


def _text(df: DataFrame) -> DataFrame:
    entries = F.array_sort(F.map_entries("cols"))
    return df.select("row_key", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("cells"))


def kv_upsert_latest(spark, folder):
    return kv.cells(log_of(spark, folder))


def kv_put(spark, folder):
    log = log_of(spark, folder)
    new = log.where("col = 'click'").select("row_key", "col").distinct().withColumn("val", F.lit("put"))
    return kv.cells(kv.put(log, new)).select("row_key", "col", "val")


def kv_put_repeated(spark, folder):
    """Every event put once more, in reverse: the first event of a cell is the last put."""
    log = log_of(spark, folder)
    new = log.select("row_key", "col", "val", (-F.col("version")).alias("at"))
    return kv.cells(kv.put(log, new, "at")).select("row_key", "col", "val")


def kv_count(spark, folder):
    return log_of(spark, folder).agg(F.countDistinct("row_key").alias("n"))


def kv_cas(spark, folder):
    state = kv.cells(log_of(spark, folder))
    wishes = state.where("col = 'view'").select("row_key", "col", F.when(F.col("row_key").cast("int") % 2 == 0, F.col("val")).otherwise("none").alias("expected"), F.lit("new").alias("val"))
    return kv.compare_and_set(state, wishes)


def kv_put_row(spark, folder):
    state = kv.cells(log_of(spark, folder))
    new = state.where("row_key LIKE '1%'").select("row_key", F.lit("only").alias("col"), F.lit("x").alias("val")).distinct()
    return kv.put_rows(state, new)


def kv_get_row(spark, folder):
    return _text(kv.get_row(log_of(spark, folder), "8"))


def kv_multi_get(spark, folder):
    return _text(kv.get_rows(log_of(spark, folder), ["8", "46", "7", "nobody"]))


def kv_get_version(spark, folder):
    return kv.get_cell(log_of(spark, folder), "8", "view", 500)


def kv_exists(spark, folder):
    keys = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("row_key"))
    return kv.exists(log_of(spark, folder), keys)


def kv_range_scan(spark, folder):
    return _text(kv.scan(log_of(spark, folder), "10", "20"))


def kv_page(spark, folder):
    return _text(kv.page(log_of(spark, folder), 2))


def kv_row_hash(spark, folder):
    return kv.row_hashes(log_of(spark, folder))


def kv_differing(spark, folder):
    log = log_of(spark, folder)
    return kv.differing_keys(log, log.where("NOT (row_key = '8' AND col = 'view')"))


QUERIES = {f.__name__: f for f in (kv_upsert_latest, kv_put, kv_put_repeated, kv_count, kv_cas, kv_put_row, kv_get_row, kv_multi_get, kv_get_version, kv_exists, kv_range_scan, kv_page, kv_row_hash, kv_differing)}

_LOG = "WITH log AS (SELECT user_id::varchar AS row_key, event_type AS col, value::varchar AS val, event_id AS version FROM events)"
_CELLS = _LOG + ", cells AS (SELECT row_key, col, arg_max(val, version) AS val, max(version) AS version FROM log GROUP BY row_key, col)"
_ROWS = _CELLS + ", rows AS (SELECT row_key, string_agg(col || '=' || val, ';' ORDER BY col) AS cells FROM cells GROUP BY row_key)"

SQL = {
    "kv_upsert_latest": _CELLS + " SELECT * FROM cells",
    "kv_put": _CELLS + " SELECT row_key, col, CASE WHEN col = 'click' THEN 'put' ELSE val END AS val FROM cells",
    "kv_put_repeated": _LOG + " SELECT row_key, col, arg_min(val, version) AS val FROM log GROUP BY row_key, col",
    "kv_count": "SELECT count(DISTINCT user_id) AS n FROM events",
    "kv_row_hash": _CELLS + " SELECT row_key, md5(string_agg(col || '=' || val, chr(31) ORDER BY col)) AS hash FROM cells GROUP BY row_key",
    "kv_cas": _CELLS + " SELECT row_key, col, 'new' AS val, row_key::int % 2 = 0 AS done FROM cells WHERE col = 'view'",
    "kv_put_row": _CELLS + " SELECT row_key, col, val FROM cells WHERE row_key NOT LIKE '1%' UNION ALL SELECT DISTINCT row_key, 'only', 'x' FROM cells WHERE row_key LIKE '1%'",
    "kv_get_row": _ROWS + " SELECT * FROM rows WHERE row_key = '8'",
    "kv_multi_get": _ROWS + " SELECT * FROM rows WHERE row_key IN ('8', '46', '7', 'nobody')",
    "kv_get_version": _LOG + " SELECT arg_max(val, version) AS val, max(version) AS version FROM log WHERE row_key = '8' AND col = 'view' AND version <= 500 HAVING count(*) > 0",
    "kv_exists": _LOG + " SELECT DISTINCT c_custkey::varchar AS row_key, c_custkey::varchar IN (SELECT row_key FROM log) AS found FROM customer",
    "kv_range_scan": _ROWS + " SELECT * FROM rows WHERE row_key >= '10' AND row_key < '20'",
    "kv_page": _ROWS + " SELECT * FROM rows ORDER BY row_key LIMIT 10 OFFSET 20",
    "kv_differing": _LOG + " SELECT DISTINCT row_key FROM log WHERE row_key = '8' AND col = 'view'",
}
