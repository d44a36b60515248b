import random

import pytest
from pyspark.sql import functions as F

from searchlake.operators import crawl, dataflow as flow, index as ix, kvtable as kv, pagerank as pr
from searchlake.operators.skew import heavy_key_hashes, heavy_share
from searchlake.sources import tables
from searchlake.streaming import windows as st


def test_puts_follow_their_order(spark):
    log = spark.createDataFrame([("r", "a", "old", 7)], "row_key string, col string, val string, version long")
    new = spark.createDataFrame([("r", "a", "zzz", 10), ("r", "a", "aaa", 12), ("r", "b", "x", 11), ("s", "a", "1", 3), (None, "a", "n", 4)], "row_key string, col string, val string, at long")
    found = {(r["row_key"], r["col"]): (r["val"], r["version"]) for r in kv.cells(kv.put(log, new, "at")).collect()}
    assert found["r", "a"][0] == "aaa" and found["r", "b"][0] == "x" and found["s", "a"][0] == "1" and found["r", "a"][1] > 7
    hot = spark.range(2000).select(F.lit("h").alias("row_key"), (F.col("id") % 3).cast("string").alias("col"), F.col("id").cast("string").alias("val"), F.col("id").alias("at"))
    assert {r["col"]: r["val"] for r in kv.cells(kv.put(log, hot, "at")).where("row_key = 'h'").collect()} == {"0": "1998", "1": "1999", "2": "1997"}
    assert kv.put(log, new.limit(0), "at").count() == 1
    null, empty = (spark.createDataFrame([("r", "a", v, 1)], "row_key string, col string, val string, version long") for v in (None, ""))
    assert kv.differing_keys(null, empty).count() == 1


def let_go(times, gap):
    out, last = [], None
    for t in sorted(times):
        last = t if last is None else max(t, last + gap)
        out.append(last)
    return out


def visits_frame(spark, visits):
    return spark.createDataFrame(visits, "host string, ms long").select("host", F.timestamp_millis("ms").alias("ts"))


@pytest.mark.parametrize("chunk", [50, 3_600_000])
def test_deferred_visits_keep_the_gap(spark, chunk):
    random.seed(11)
    visits = [(random.choice("aaab"), random.randint(0, 900)) for _ in range(120)] + [("a", 5), ("a", 5), (None, 1), ("c", None)]
    found = crawl.politeness(visits_frame(spark, visits), "host", "ts", 17, chunk).collect()
    for h in "ab":
        assert sorted(r["ready_at_ms"] for r in found if r["host"] == h) == let_go([t for g, t in visits if g == h], 17)
    assert len(found) == 122 and not any(r["gap_ms"] is not None and r["gap_ms"] < 0 for r in found)
    three = crawl.politeness(visits_frame(spark, [("h", 0), ("h", 100), ("h", 200)]), "host", "ts", 500).orderBy("ts").collect()
    assert [r["ready_at_ms"] for r in three] == [0, 500, 1000]


@pytest.mark.parametrize("batch", [2, 10000])
def test_stream_of_visits_keeps_the_gap(spark, tmp_path, batch):
    times = [1_700_000_000_000 + t for t in (50_000, 40_000, 10_000, 20_000, 30_000, 0, 30_100, 30_200)]
    visits_frame(spark, [("h", t) for t in times] + [("g", times[0]), (None, times[0])]).write.parquet(f"{tmp_path}/visits.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = st.drain(st.polite_visits(st.stream_table(spark, str(tmp_path), "visits"), "host", "ts", 1000)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["ready_at_ms"] for r in found if r["host"] == "h") == let_go(times, 1000) and len(found) == 9


def test_limits_are_off_unless_given(spark):
    pages = spark.createDataFrame([(f"http://p/{i}", "<title>" + "long " * 100 + "</title><p>word " + "x" * 30 * i) for i in range(8)] + [("http://p/big", "<p>word " + "ab " * 400_000)], "url string, html string")
    assert ix.documents(pages).count() == 9 and ix.documents(pages, 1_000_000).count() == 8
    assert tuple(ix.left_out(pages, 1_000_000).first()) == (1, 1_200_008)
    small = pages.where("url <> 'http://p/big'")
    cut = ix.build_index(small, cap=3, stop_cap=1, longest_title=10)
    terms = {r["term"]: (r["df"], r["idf"]) for r in cut.terms.collect()}
    assert cut.postings.where("term = 'word'").count() == 3 and terms["word"] == (8, 0.0)
    assert ix.build_index(small).postings.where("term = 'word'").count() == 8
    assert {len(r["title"]) for r in cut.doc_stats.collect()} == {10} and {len(r["title"]) for r in ix.build_index(small).doc_stats.collect()} == {499}
    twice = ix.build_index(small.unionByName(small.limit(1)))
    assert twice.doc_stats.count() == 8


def test_a_stopped_build_goes_on(spark, tmp_path, rows):
    pages = spark.createDataFrame([(f"http://p/{i}", f"<p>word w{'abcdefgh'[i % 8]}x") for i in range(30)], "url string, html string")
    path = f"{tmp_path}/index"
    assert ix.build_in_buckets(spark, pages, path, 3, 4, stop_after=2) == [0, 1]
    assert ix.build_in_buckets(spark, pages, path, 3, 4) == [2] and ix.build_in_buckets(spark, pages, path, 3, 4) == []
    whole = ix.build_index(pages)
    assert rows(ix.read_index(spark, path, buckets=4).terms.select("term", "df")) == rows(whole.terms.select("term", "df"))
    assert rows(ix.read_index(spark, path, ["word"], buckets=4).postings.select("url", "tf")) == rows(whole.postings.where("term = 'word'").select("url", "tf"))


def test_ranks_go_on_from_a_checkpoint(spark, tmp_path):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "A")], "src string, dst string")
    with pytest.raises(RuntimeError):
        pr.pagerank(edges, threshold=0.01, max_iterations=3, checkpoint=f"{tmp_path}/ranks", policy=crawl.CheckpointPolicy(every=1))
    about = pr.last_checkpoint(spark, f"{tmp_path}/ranks")[1]
    assert about["iteration"] == 3 and not about["done"]
    rest = pr.pagerank(edges, threshold=0.01, checkpoint=f"{tmp_path}/ranks")
    whole = pr.pagerank(edges, threshold=0.01)
    assert rest.iterations == whole.iterations - 3 and pr.last_checkpoint(spark, f"{tmp_path}/ranks")[1]["done"]
    assert {r["id"]: round(r["rank"], 9) for r in rest.ranks.collect()} == {r["id"]: round(r["rank"], 9) for r in whole.ranks.collect()}
    assert pr.last_checkpoint(spark, f"{tmp_path}/none") is None


def test_upsert_in_place_and_destroyed_tables(spark, tmp_path, rows):
    path = f"{tmp_path}/t"
    spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string").write.parquet(path)
    assert tables.save_upsert(spark, path, spark.createDataFrame([("b", "9"), ("c", "3")], "k string, v string"), ["k"]) == path
    assert rows(spark.read.parquet(path)) == [("a", "1"), ("b", "9"), ("c", "3")]
    # the change of names was cut off: the next call ends it
    (tmp_path / "t").rename(tmp_path / "t.next")
    tables.save_upsert(spark, path, spark.createDataFrame([("a", "0")], "k string, v string"), ["k"])
    assert rows(spark.read.parquet(path)) == [("a", "0"), ("b", "9"), ("c", "3")]
    tables.save_as_table(spark.read.parquet(path), "t_handle")
    handle = tables.TableHandle(spark, "t_handle")
    assert handle.frame().count() == 3
    handle.destroy()
    with pytest.raises(RuntimeError):
        handle.frame()


def test_groups_that_fit_no_row_are_an_error(spark, rows):
    hot = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").cast("string").alias("v"))
    with pytest.raises(ValueError, match="hot"):
        flow.bounded(hot, 1000)
    assert flow.bounded(hot, 1500).count() == 3000
    numbers = hot.select("k", F.col("v").cast("long").alias("v"))
    total = flow.fold_by_key(numbers, F.lit(0).cast("long"), lambda a, x: a + x, lambda a, b: a + b, salts=5)
    assert {r["k"]: r["value"] for r in total.collect()}["hot"] == sum(range(0, 3000, 2)) and total.count() == 1501
    joined = flow.join_pairs(hot, spark.createDataFrame([("hot", "x"), ("hot", "y"), ("1", "z")], "k string, v string"))
    assert joined.count() == 3001


def test_heavy_keys_in_one_pass(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, "h").when(F.col("id") < 420, "m").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("w"))
    assert len(heavy_key_hashes(df, ["k"], 0.02)) == 2 and len(heavy_key_hashes(df, ["k"], 0.3)) == 1
    assert heavy_key_hashes(df.limit(0), ["k"]) == [] and len(heavy_key_hashes(df, ["k"], 0.1, F.col("w"))) == 1
    spark.conf.set("spark.sql.shuffle.partitions", 4000)
    try:
        assert heavy_share(spark, 0.01) == 0.001
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
