from pyspark.sql import functions as F

from searchlake.operators import dataflow as flow
from searchlake.operators import kvtable as kv
from searchlake.session import materialize
from searchlake.sources import tables


def pairs(spark, data):
    return spark.createDataFrame(data, "k string, v string")


def test_pair_operators(spark, rows):
    left, right = pairs(spark, [("a", "2"), ("a", "1"), ("b", "3")]), pairs(spark, [("a", "9"), ("c", "7")])
    assert rows(flow.join_pairs(left, right)) == [("a", "1,9"), ("a", "2,9")]
    assert rows(flow.cogroup_text(left, right)) == [("a", "[1,2],[9]"), ("b", "[3],[]"), ("c", "[],[7]")]
    assert rows(flow.group_values(left)) == [("a", "1,2"), ("b", "3")]
    assert rows(flow.fold_by_key(left, F.lit(""), lambda a, x: F.concat(a, x))) == [("a", "12"), ("b", "3")]
    assert rows(flow.fold_concat(left, "-")) == [("a", "1-2"), ("b", "3")]


def test_values(spark, rows):
    df = tables.parallelize(spark, ["x y", "x", "x", "z"])
    assert rows(flow.flat_map(df, lambda v: F.split(v, " "))) == [("x",), ("x",), ("x",), ("y",), ("z",)]
    assert rows(flow.distinct_values(df)) == [("x y",), ("x",), ("z",)]
    assert rows(flow.intersection(df, tables.parallelize(spark, ["x", "q"]))) == [("x",)]
    assert [r["value"] for r in flow.take(df, 2).collect()] == ["x y", "x"] and flow.take(df, -1).count() == 0
    assert flow.hash_sample(df, 0).count() == 0 and flow.hash_sample(df, 1).count() == 4
    assert rows(flow.hash_sample(df, 0.5)) == rows(flow.hash_sample(df, 0.5))
    pair = flow.flat_map_to_pair(df, lambda v: F.array(F.struct(v.alias("k"), v.alias("v")), F.struct(F.lit(None).cast("string").alias("k"), v.alias("v"))))
    assert pair.count() == 4


def test_sources(spark, rows, tmp_path):
    (tmp_path / "seeds.txt").write_text("# c\n\n  a \n#b\nc\n")
    assert rows(tables.lines(spark, str(tmp_path / "seeds.txt"))) == [("a",), ("c",)]
    old, new = pairs(spark, [("a", "1"), (None, "2")]), pairs(spark, [(None, "3"), ("b", "4")])
    assert rows(tables.upsert(old, new, ["k"])) == sorted([("a", "1"), (None, "3"), ("b", "4")], key=repr)
    tables.save(old, str(tmp_path / "t"))
    assert spark.read.parquet(tables.save_upsert(spark, str(tmp_path / "t"), new, ["k"])).count() == 3
    assert rows(materialize(old)) == rows(old)
    assert tables.drop_tables(spark, ["no_such_table"]) == []


def test_kv(spark, rows):
    log = spark.createDataFrame([("r1", "a", "1", 1), ("r1", "a", "2", 3), ("r1", "b", "x", 2), ("r2", "a", None, 1)], "row_key string, col string, val string, version long")
    assert rows(kv.cells(log)) == [("r1", "a", "2", 3), ("r1", "b", "x", 2), ("r2", "a", None, 1)]
    assert rows(kv.get_cell(log, "r1", "a", 2)) == [("1", 1)]
    assert kv.get_row(log, "r1").first()["cols"] == {"a": "2", "b": "x"}
    assert [r["row_key"] for r in kv.scan(log, "r1", "r2").collect()] == ["r1"]
    assert kv.page(log, 1, 1).first()["row_key"] == "r2"
    after = kv.put(log, spark.createDataFrame([("r1", "a", "9"), ("r3", "c", "0")], "row_key string, col string, val string"))
    assert {tuple(r)[:3] for r in kv.cells(after).collect()} >= {("r1", "a", "9"), ("r3", "c", "0")}
    wishes = spark.createDataFrame([("r1", "a", "2", "n"), ("r1", "a", "0", "n"), ("r9", "a", "2", "n")], "row_key string, col string, expected string, val string")
    assert [r["done"] for r in kv.compare_and_set(kv.cells(log), wishes).orderBy("row_key", "expected").collect()] == [False, True, False]
    assert rows(kv.differing_keys(log, log.where("col <> 'b'"))) == [("r1",)]
    assert rows(kv.exists(log, spark.createDataFrame([("r1",), ("no",)], "row_key string"))) == [("no", False), ("r1", True)]


def test_catalog(spark, rows):
    df = pairs(spark, [("a", "1"), ("b", "2")])
    for name in ("t_one", "t_two"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    tables.save_as_table(df, "t_one", ["k"], 2)
    assert "t_one" in tables.list_tables(spark)
    tables.rename_table(spark, "t_one", "t_two")
    assert rows(spark.table("t_two")) == rows(df)
    for old, new, error in (("t_one", "x", KeyError), ("t_two", "t_two", FileExistsError)):
        try:
            tables.rename_table(spark, old, new)
        except error:
            continue
        raise AssertionError(error)
    assert tables.drop_tables(spark, ["t_two", "t_none"]) == ["t_two"]
    assert tables.show(df.orderBy("k")) == "a\t1\nb\t2" and tables.show(df.limit(0)) == "No output"
