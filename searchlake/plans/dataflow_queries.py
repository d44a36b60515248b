"""Queries of the dataflow operators, tables and actions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.operators import dataflow as flow
from searchlake.session import materialize, save_path_of, scratch_path, table
from searchlake.sources import tables


def _values(spark: SparkSession, folder: str, name: str, key: str, value: str) -> DataFrame:
    return tables.from_table(table(spark, folder, name), key, F.col(value))


def _split(v):
    return F.split(v, " ")


def parallelize(spark, folder):
    return tables.parallelize(spark, ["space", "travel", "guide", "space"])


def from_table(spark, folder):
    return _values(spark, folder, "nation", "n_nationkey", "n_name")


def save_overwrite_by_key(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    new = orders.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X"))
    return tables.upsert(orders, new, ["o_orderkey"])


def save_and_read(spark, folder):
    return materialize(table(spark, folder, "part").select("p_partkey", "p_brand"), "saved")


def line_source(spark, folder):
    path = save_path_of(spark, "lines", ["# seeds", "", "  https://a.example/  ", "https://b.example/x", "#https://c.example/"])
    return tables.lines(spark, path)


def flat_map(spark, folder):
    return flow.flat_map(_values(spark, folder, "part", "p_partkey", "p_name"), _split)


def flat_map_to_pair(spark, folder):
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select(F.struct("doc_id", "source").alias("value"))
    parts = lambda v: F.transform(F.array(F.lit("doc"), F.lit("source")), lambda n: F.struct(n.alias("k"), F.when(n == "doc", v["doc_id"].cast("string")).otherwise(v["source"]).alias("v")))
    return flow.flat_map_to_pair(docs, parts)


def map_to_pair(spark, folder):
    return flow.map_to_pair(table(spark, folder, "customer"), F.col("c_mktsegment"), F.col("c_name"))


def filter_(spark, folder):
    return flow.keep(table(spark, folder, "orders"), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).select("o_orderkey", "o_custkey")


def map_partitions(spark, folder):
    def shout(batches):
        for b in batches:
            b["value"] = b["value"].str.upper()
            yield b

    return flow.map_partitions(_values(spark, folder, "part", "p_partkey", "p_name"), shout, "key string, value string")


def hash_sample(spark, folder):
    return flow.hash_sample(table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("value")), 0.1)


def distinct(spark, folder):
    return flow.distinct_values(table(spark, folder, "part"), "p_name")


def intersection(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("value"))
    return flow.intersection(customers, table(spark, folder, "supplier").select(F.col("s_nationkey").alias("value")))


def group_by(spark, folder):
    return flow.group_values(flow.map_to_pair(table(spark, folder, "nation"), F.col("n_regionkey"), F.col("n_name")))


def fold_by_key(spark, folder):
    pairs = flow.map_to_pair(table(spark, folder, "part"), F.col("p_brand"), F.col("p_size").cast("long"))
    return flow.fold_by_key(pairs, F.lit(7).cast("long"), lambda a, x: (a * 31 + x) % 1000003)


def fold_by_key_merged(spark, folder):
    pairs = flow.map_to_pair(table(spark, folder, "lineitem"), F.col("l_returnflag"), F.col("l_orderkey").cast("long"))
    return flow.fold_by_key(pairs, F.lit(0).cast("long"), lambda a, x: (a + x * x) % 1000003, lambda a, b: (a + b) % 1000003)


def table_upsert(spark, folder):
    """A stored table after an upsert in place."""
    path = scratch_path(spark, "orders")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    tables.save(orders, path)
    tables.save_upsert(spark, path, orders.where("o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])
    return spark.read.parquet(path)


def table_life(spark, folder):
    """What is left after tables were made, renamed, dropped and destroyed."""
    tag = uuid.uuid4().hex[:12]
    one, two, three = (f"life_{x}_{tag}" for x in ("one", "two", "three"))
    region = table(spark, folder, "region").select("r_regionkey", "r_name")
    for name in (one, two):
        tables.save_as_table(region, name)
    tables.rename_table(spark, one, three)
    handle = tables.TableHandle(spark, two)
    rows = handle.frame().count()
    handle.destroy()
    try:
        handle.frame()
        refused = False
    except RuntimeError:
        refused = True
    left = [n.rpartition("_")[0] for n in tables.list_tables(spark) if n.endswith(tag)]
    dropped = [n.rpartition("_")[0] for n in tables.drop_tables(spark, [one, two, three])]
    return spark.createDataFrame([("rows", str(rows)), ("refused", str(refused).lower()), ("left", ",".join(left)), ("dropped", ",".join(dropped))], "step string, found string")


def output(spark, folder):
    shown = tables.show(table(spark, folder, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    none = tables.show(table(spark, folder, "region").where("r_regionkey < 0"))
    return spark.createDataFrame([(k, t) for k, t in enumerate([*shown.split("\n"), none])], "line int, text string")


def aggregate_by_key(spark, folder):
    pairs = flow.map_to_pair(table(spark, folder, "orders"), F.col("o_orderpriority"), F.col("o_totalprice"))
    return flow.aggregate_by_key(pairs, F.round(F.max("v"), 2))


def fold_by_key_concat(spark, folder):
    return flow.fold_concat(flow.map_to_pair(table(spark, folder, "nation"), F.col("n_regionkey"), F.col("n_name")), ";")


def pair_flat_map_to_pair(spark, folder):
    pairs = flow.map_to_pair(table(spark, folder, "part"), F.col("p_brand"), F.col("p_name"))
    both = pairs.select(F.struct("k", "v").alias("value"))
    return flow.flat_map_to_pair(both, lambda p: F.transform(_split(p["v"]), lambda w: F.struct(w.alias("k"), p["k"].alias("v"))))


def pair_flat_map(spark, folder):
    pairs = flow.map_to_pair(table(spark, folder, "part"), F.col("p_brand"), F.col("p_name"))
    return flow.flat_map(pairs.select(F.struct("k", "v").alias("value")), lambda p: F.transform(_split(p["v"]), lambda w: F.concat_ws(":", p["k"], w)))


def join(spark, folder):
    nations = flow.map_to_pair(table(spark, folder, "nation"), F.col("n_regionkey"), F.col("n_name"))
    return flow.join_pairs(flow.map_to_pair(table(spark, folder, "region"), F.col("r_regionkey"), F.col("r_name")), nations)


def _cogrouped(spark, folder):
    left = flow.map_to_pair(table(spark, folder, "customer"), F.col("c_nationkey"), F.col("c_name"))
    return left, flow.map_to_pair(table(spark, folder, "supplier"), F.col("s_nationkey"), F.col("s_name"))


def cogroup(spark, folder):
    return flow.cogroup_text(*_cogrouped(spark, folder))


def count(spark, folder):
    return table(spark, folder, "lineitem").agg(F.count(F.lit(1)).alias("n"))


def fold(spark, folder):
    x = F.col("o_totalprice")
    return flow.fold(table(spark, folder, "orders"), F.round(F.max(x), 2).alias("most"), F.count_if(x > 100000).alias("large"), F.count(F.lit(1)).alias("n"))


def take(spark, folder):
    return flow.take(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), 25, "o_orderkey")


QUERIES = {
    "parallelize": parallelize, "from_table": from_table, "save_overwrite_by_key": save_overwrite_by_key, "save_and_read": save_and_read, "line_source": line_source,
    "flat_map": flat_map, "flat_map_to_pair": flat_map_to_pair, "map_to_pair": map_to_pair, "filter": filter_, "map_partitions": map_partitions, "hash_sample": hash_sample,
    "distinct": distinct, "intersection": intersection, "group_by": group_by, "fold_by_key": fold_by_key, "fold_by_key_merged": fold_by_key_merged, "table_upsert": table_upsert, "table_life": table_life, "output": output, "aggregate_by_key": aggregate_by_key, "fold_by_key_concat": fold_by_key_concat,
    "pair_flat_map_to_pair": pair_flat_map_to_pair, "pair_flat_map": pair_flat_map, "join": join, "cogroup": cogroup, "count": count, "fold": fold, "take": take,
}

SQL = {
    "parallelize": "SELECT * FROM (VALUES ('0', 'space'), ('1', 'travel'), ('2', 'guide'), ('3', 'space')) t(key, value)",
    "from_table": "SELECT n_nationkey::varchar AS key, n_name AS value FROM nation",
    "save_overwrite_by_key": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "save_and_read": "SELECT p_partkey, p_brand FROM part",
    "line_source": "SELECT * FROM (VALUES ('https://a.example/'), ('https://b.example/x')) t(value)",
    "flat_map": "SELECT unnest(string_split(p_name, ' ')) AS value FROM part",
    "flat_map_to_pair": "SELECT 'doc' AS k, doc_id::varchar AS v FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'source', source FROM documents WHERE text IS NOT NULL AND source IS NOT NULL",
    "map_to_pair": "SELECT c_mktsegment AS k, c_name AS v FROM customer",
    "filter": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "map_partitions": "SELECT p_partkey::varchar AS key, upper(p_name) AS value FROM part",
    "hash_sample": "SELECT o_orderkey::varchar AS value FROM orders WHERE ('0x' || substr(sha1(o_orderkey::varchar), 1, 13))::bigint / pow(2.0, 52) < 0.1",
    "distinct": "SELECT DISTINCT p_name AS value FROM part",
    "intersection": "SELECT c_nationkey AS value FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "group_by": "SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation GROUP BY 1",
    "fold_by_key": "SELECT p_brand AS k, list_reduce(list_prepend(7::bigint, list(p_size::bigint ORDER BY p_size)), lambda a, x: (a * 31 + x) % 1000003) AS value FROM part GROUP BY 1",
    "fold_by_key_merged": "SELECT l_returnflag AS k, (sum((l_orderkey::hugeint * l_orderkey) % 1000003) % 1000003)::bigint AS value FROM lineitem GROUP BY 1",
    "table_upsert": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "table_life": "SELECT 'rows' AS step, count(*)::varchar AS found FROM region UNION ALL SELECT * FROM (VALUES ('refused', 'true'), ('left', 'life_three'), ('dropped', 'life_three')) t(step, found)",
    "output": "SELECT (row_number() OVER (ORDER BY r_regionkey) - 1)::int AS line, r_regionkey || chr(9) || r_name AS text FROM region UNION ALL SELECT count(*)::int, 'No output' FROM region",
    "aggregate_by_key": "SELECT o_orderpriority AS k, round(max(o_totalprice), 2) AS value FROM orders GROUP BY 1",
    "fold_by_key_concat": "SELECT n_regionkey AS k, string_agg(n_name, ';' ORDER BY n_name) AS value FROM nation GROUP BY 1",
    "pair_flat_map_to_pair": "SELECT unnest(string_split(p_name, ' ')) AS k, p_brand AS v FROM part",
    "pair_flat_map": "SELECT p_brand || ':' || unnest(string_split(p_name, ' ')) AS value FROM part",
    "join": "SELECT r_regionkey AS k, r_name || ',' || n_name AS value FROM region JOIN nation ON r_regionkey = n_regionkey",
    "cogroup": """
        WITH a AS (SELECT c_nationkey AS k, string_agg(c_name, ',' ORDER BY c_name) AS v FROM customer GROUP BY 1),
             b AS (SELECT s_nationkey AS k, string_agg(s_name, ',' ORDER BY s_name) AS v FROM supplier GROUP BY 1)
        SELECT k, '[' || coalesce(a.v, '') || '],[' || coalesce(b.v, '') || ']' AS value FROM a FULL JOIN b USING (k)""",
    "count": "SELECT count(*) AS n FROM lineitem",
    "fold": "SELECT round(max(o_totalprice), 2) AS most, count(*) FILTER (o_totalprice > 100000) AS large, count(*) AS n FROM orders",
    "take": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25",
}
