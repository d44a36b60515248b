import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from searchlake.operators import skew
from searchlake.plans.skew_queries import p1_found, p1_term_totals

SCHEMA = "entry_id long, term string, n_rows int, _value string, indexed_at timestamp"


def _frame(spark, terms):
    return spark.createDataFrame([(i, t, 1, None, None) for i, t in enumerate(terms)], SCHEMA)


def test_heavy_keys_are_bounded_and_found(spark):
    df = _frame(spark, ["hot"] * 60 + [f"t{i}" for i in range(40)])
    heavy = skew.heavy_key_hashes(df, ["term"], 0.1)
    assert len(heavy) == 1
    assert skew.heavy_key_hashes(df.limit(0), ["term"], 0.1) == []


def test_salted_results_equal_plain_ones(spark, rows):
    random.seed(1)
    data = [(i, random.choice(["hot"] * 8 + ["a", "b", None]), random.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, k string, v int")
    measures = [skew.count_rows("n"), skew.sum_of("s", F.col("v")), skew.max_of("hi", F.col("v")), skew.min_of("lo", F.col("v"))]
    plain = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.max("v").alias("hi"), F.min("v").alias("lo"))
    assert rows(skew.salted_aggregate(df, ["k"], measures, ["id"], share=0.05, salts=7)) == rows(plain)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", None, ""]), max_size=40))
def test_salted_count_of_any_rows(spark, keys):
    df = spark.createDataFrame(list(enumerate(keys)), "id long, k string")
    found = {r["k"]: r["n"] for r in skew.salted_aggregate(df, ["k"], [skew.count_rows("n")], ["id"], share=0.2, salts=3).collect()}
    assert found == {k: keys.count(k) for k in set(keys)}


def test_salted_join_and_top(spark, rows):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)] + [(1000, None)], "id long, k string")
    right = left.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    heavy = skew.heavy_key_hashes(left, ["k"], 0.1)
    assert heavy
    assert rows(skew.salted_join(left, right, ["k"], ["id"], heavy, salts=4)) == rows(left.join(right, "k"))
    top = skew.salted_top(left, ["k"], [F.desc("id")], 2, ["id"], heavy, salts=4)
    assert sorted(r["id"] for r in top.where("k = 'hot'").collect()) == [88, 89]


def test_measures_may_not_clash(spark):
    df = _frame(spark, ["a"])
    try:
        skew.salted_aggregate(df, ["term"], [skew.count_rows("term")], ["entry_id"])
    except ValueError:
        return
    raise AssertionError("a measure with the name of a key was taken")


def _write(spark, path, data):
    spark.createDataFrame(data, SCHEMA).write.mode("overwrite").parquet(f"{path}/pt_index.parquet")


def test_p1_edges(spark, tmp_path):
    data = [(i, "hot", 1, "1.0\t1\thttp://a|tf=2,http://b| tf = 3", None) for i in range(99)] + [(200, None, 1, "x", None), (201, "rare", 1, None, None)]
    data += [(300 + i, "hot", 1, "", None) for i in range(2)]
    _write(spark, tmp_path, data)
    assert [r["term"] for r in p1_found(spark, str(tmp_path)).collect()] == ["hot"]
    totals = {r["term"]: r for r in p1_term_totals(spark, str(tmp_path)).collect()}
    assert totals["hot"]["n_rows"] == 101 and totals["hot"]["tf_total"] == 99 * 5 and totals["hot"]["tf_max"] == 3
    assert totals["rare"]["tf_total"] == 0 and totals["rare"]["tf_max"] is None
    _write(spark, tmp_path, [])
    assert p1_found(spark, str(tmp_path)).count() == 0 and p1_term_totals(spark, str(tmp_path)).count() == 0
