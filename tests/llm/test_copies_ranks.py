import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from searchlake.llm import distinctive_terms as dt
from searchlake.llm import rank_fusion as rf
from searchlake.llm import term_counts as tc
from searchlake.llm import url_copies as uc

RESULTS = "result_id long, query_id long, url string, total_score double, tfidf_score double, page_rank_score double, title string, id long, scope string"


def fields(url):
    keep = lambda s: "".join(c.lower() for c in s if c.isascii() and c.isalnum())
    first, _, rest = url.partition("?")
    return keep(first), tuple(sorted(x for x in map(keep, rest.replace(";", "&").split("&")) if x))


def brute_copies(rows):
    classes = defaultdict(list)
    for i, q, u in rows:
        if q is not None and u is not None:
            classes[q, fields(u)].append(i)
    return sorted((min(c), i) for c in classes.values() for i in c if i > min(c))


def urls_frame(spark, rows):
    return spark.createDataFrame([(i, q, u, None, None, None, None, 7, "z") for i, q, u in rows], RESULTS)


def found_copies(spark, rows, share=0.02):
    found = uc.copy_classes(urls_frame(spark, rows), "result_id", "query_id", "url", share=share)
    return sorted((r["first_id"], r["id"]) for r in found.where("id > first_id").collect())


def test_copies_cases(spark):
    rows = [
        (1, 1, "https://a.example/x-y?b=1&a=2"), (2, 1, "HTTPS://A.example//x–y/?a=2;b=1&&"), (3, 1, "https://a.example/x-y?a=1&b=2"), (4, 2, "https://a.example/x-y?b=1&a=2"),
        (5, 1, None), (6, None, "https://a.example/x-y?b=1&a=2"), (7, 3, ""), (8, 3, ""), (9, 3, "?"), (10, 3, "\u212a"), (11, 4, "x" * 5000), (12, 4, "x" * 5000), (13, 4, "x" * 4999 + "y"), (2, 1, "HTTPS://A.example//x–y/?a=2;b=1&&"),
        (14, 5, "abc?d?e"), (15, 5, "a-bc?de"), (16, 5, "abcd?e"),
    ]
    assert found_copies(spark, rows) == sorted(set(brute_copies(rows)) - {(2, 2)}) == [(1, 2), (7, 8), (7, 9), (7, 10), (11, 12), (14, 15)]
    assert found_copies(spark, []) == []


def test_copies_against_brute_force_with_a_hot_scope(spark):
    random.seed(2)
    pieces = ["a", "B", "-", "1", "?", "&", ";", "/", " "]
    rows = [(i, 1 if random.random() < 0.6 else random.randint(2, 5), "".join(random.choices(pieces, k=random.randint(0, 6)))) for i in range(1500)]
    assert found_copies(spark, rows, share=0.1) == brute_copies(rows)


def brute_places(rows, k):
    out = {}
    for q, i, scores in rows:
        mine = scores[k]
        others = [s[k] for g, _, s in rows if g == q]
        known = [s for s in others if s is not None and not math.isnan(s)]
        bad = mine is None or math.isnan(mine)
        out[q, i] = 1 + (len(known) if bad else sum(s > mine for s in known))
    return out


@pytest.mark.parametrize("hot_rows", [2_000_000, 20])
def test_places_and_first(spark, hot_rows):
    random.seed(3)
    value = lambda: random.choice([None, float("nan"), 0.0, -1.5, random.random() * 10, random.random() ** 9, 3.0])
    rows = [(1 if n < 150 else random.randint(2, 6), n, (value(), value(), value())) for n in range(300)]
    df = spark.createDataFrame([(i, q, None, *s, None, 1, "s") for q, i, s in rows], RESULTS)
    placed = rf.places(df, "query_id", "result_id", hot_rows=hot_rows).collect()
    for k, name in enumerate(rf.SCORES):
        assert {(r["grp"], r["item"]): r[f"place_{name}"] for r in placed} == brute_places(rows, k)


def test_first_results(spark, tmp_path):
    random.seed(4)
    rows = [(random.randint(1, 20), n, tuple(random.choice([None, 1.0, 2.0, random.random() * 100]) for _ in range(3))) for n in range(400)]
    spark.createDataFrame([(i, q, None, *s, None, 1, "s") for q, i, s in rows] + [(999, None, None, 1.0, 1.0, 1.0, None, 1, "s")], RESULTS).write.parquet(f"{tmp_path}/search_results.parquet")
    p = [brute_places(rows, k) for k in range(3)]
    best = {}
    for q, i, _ in rows:
        best[q] = min(best.get(q, (10**9, 0)), (sum(x[q, i] for x in p), i))
    assert {r["query_id"]: r["result_id"] for r in rf.p3_found(spark, str(tmp_path)).collect()} == {q: i for q, (_, i) in best.items()}
    ranked = rf.p3_ranking(spark, str(tmp_path))
    assert ranked.count() == 400 and ranked.where("projection IS NULL").count() == 0
    spark.createDataFrame([], RESULTS).write.parquet(f"{tmp_path}/none/search_results.parquet")
    assert rf.p3_found(spark, f"{tmp_path}/none").count() == 0


INDEX = "entry_id long, term string, bucket_no int, _value string, indexed_at timestamp, url string, df long"


def index_frame(spark, cells):
    return spark.createDataFrame([(i, t, 0, v, None, "clash", 1) for i, (t, v) in enumerate(cells)], INDEX)


CELLS = [
    ("a", "1.0\t2\thttp://x|tf=3|weightedTf=9,http://y|weightedTf=8.0|tf=1"), ("a", "\t\thttp://x | tf = 5 | docLen = 2,"), ("b", "NaN\t1\thttp://x|tf=1,http://y|tf=4"), ("c", "1\t1\thttp://z?tf=9|tf=2"),
    (None, "1\t1\thttp://n|tf=1"), ("d", None), ("e", ""), ("f", "1\t1\thttp://w|docLen=3"), ("c", "1\t1\thttp://z?tf=9|tf=2"),
]


def test_residuals(spark):
    found = {(r["url"], r["term"]): r for r in dt.term_residuals(index_frame(spark, CELLS)).collect()}
    tf = {("http://x", "a"): 5, ("http://y", "a"): 1, ("http://x", "b"): 1, ("http://y", "b"): 4, ("http://z?tf=9", "c"): 2}
    assert {k: r["tf"] for k, r in found.items()} == tf
    total = sum(tf.values())
    for (u, t), n in tf.items():
        page, term = sum(v for (a, _), v in tf.items() if a == u), sum(v for (_, b), v in tf.items() if b == t)
        e = page * term / total
        r = found[u, t]
        assert r["expected"] == pytest.approx(e) and r["residual"] == pytest.approx((n - e) / math.sqrt(e))
        assert r["adjusted"] == pytest.approx((n - e) / math.sqrt(e * (1 - page / total) * (1 - term / total)))
        assert r["df"] == sum(b == t for _, b in tf) and r["n_pages"] == 3
    assert dt.term_residuals(index_frame(spark, [])).count() == 0
    lone = dt.term_residuals(index_frame(spark, [("a", "\t\thttp://x|tf=3")])).first()
    assert lone["residual"] == 0 and lone["adjusted"] == 0


def test_p4_ties_and_rare_terms(spark, tmp_path):
    cells = [("b", "\t\thttp://x|tf=2,http://y|tf=1"), ("a", "\t\thttp://x|tf=2,http://y|tf=1"), ("rare", "\t\thttp://x|tf=99"), ("z", "\t\thttp://q|tf=1")]
    index_frame(spark, cells).write.parquet(f"{tmp_path}/pt_index.parquet")
    assert {tuple(r) for r in dt.p4_found(spark, str(tmp_path)).select("url", "term").collect()} == {("http://x", "a"), ("http://y", "a")}


def test_term_count_deltas(spark, tmp_path, rows):
    store = tc.TermCountStore(spark, f"{tmp_path}/counts", buckets=3)
    frame = lambda cells: spark.createDataFrame(cells, "term string, url string, tf long")
    assert store.counts().count() == 0 and store.n_pages() == 0
    random.seed(5)
    state = {}
    for _ in range(4):
        batch = {}
        for _ in range(60):
            batch[random.choice("abcd"), f"u{random.randint(1, 12)}"] = random.choice([None, 1, 2, 3])
        state.update(batch)
        store.apply(frame([(*k, v) for k, v in batch.items()] + [(None, "u", 1), ("a", None, 1)]))
        state = {k: v for k, v in state.items() if v is not None}
        want = sorted((t, sum(v for (a, _), v in state.items() if a == t), sum(a == t for a, _ in state)) for t in {a for a, _ in state})
        assert rows(store.counts()) == want
        assert store.n_pages() == len({u for _, u in state})
    before = rows(store.counts())
    store.apply(frame([]))
    assert rows(store.counts()) == before
    marks = {r["term"]: r["mark"] for r in store.marked(rare=0, common=0.0).collect()}
    assert set(marks.values()) == {"common"}


def test_store_survives_reopening(spark, tmp_path, rows):
    path = f"{tmp_path}/counts"
    frame = lambda cells, s=spark: s.createDataFrame(cells, "term string, url string, tf long")
    store = tc.TermCountStore(spark, path, buckets=4)
    assert store.apply(frame([("a", "u", 2), ("b", "u", 1), ("b", "v", 5)]), batch_id="monday")
    again = tc.TermCountStore(spark.newSession(), path, buckets=99)
    assert again.state["buckets"] == 4 and rows(again.counts()) == [("a", 2, 1), ("b", 6, 2)] and again.n_pages() == 2
    assert not again.apply(frame([("a", "u", 2), ("b", "u", 1)]), batch_id="monday")
    # a batch that is cut off before its manifest changes nothing, and can be done again
    commit, again._commit = again._commit, lambda state: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        again.apply(frame([("a", "u", 7), ("c", "w", 1), ("b", "v", None)]), batch_id="tuesday")
    assert rows(tc.TermCountStore(spark, path).counts()) == [("a", 2, 1), ("b", 6, 2)]
    assert tc.TermCountStore(spark, path).apply(frame([("a", "u", 7), ("c", "w", 1), ("b", "v", None)]), batch_id="tuesday")
    last = tc.TermCountStore(spark, path)
    assert rows(last.counts()) == [("a", 7, 1), ("b", 1, 1), ("c", 1, 1)] and last.n_pages() == 2
    last.apply(frame([("a", "u", None), ("b", "u", None)]), batch_id="wednesday")
    last.compact()
    end = tc.TermCountStore(spark, path)
    assert rows(end.counts()) == [("c", 1, 1)] and end.n_pages() == 1
    assert rows(end.cells().select("term", "url", "tf")) == [("c", "w", 1)] and all(len(p) == 1 for p in end.state["cells"].values())
    end.apply(frame([("c", "w", 3), ("a", "u", 1)]))
    assert rows(tc.TermCountStore(spark, path).counts()) == [("a", 1, 1), ("c", 3, 1)]


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    store = tc.TermCountStore(spark, f"{tmp_path}/counts", buckets=8)
    store.apply(spark.createDataFrame([(f"t{i}", f"u{i}", 1) for i in range(200)], "term string, url string, tf long"))
    read = []
    cells = store.cells
    store.cells = lambda buckets=None: read.append(buckets) or cells(buckets)
    store.apply(spark.createDataFrame([("t1", "u1", 2)], "term string, url string, tf long"))
    assert len(read[0]) == 1 and sorted(map(len, store.state["cells"].values())) == [1] * 7 + [2]


def test_largest_rule_and_found(spark, tmp_path):
    data = [(i, t, 0, v, f"2024-01-{d:02d} 00:00:00", "u", 1) for i, (t, v, d) in enumerate([("a", "\t\th://1|tf=2,h://2|tf=1,h://3|tf=1", 1), ("a", "\t\th://1|tf=1", 9), ("b", "\t\th://4|tf=1", 9), (None, "\t\th://9|tf=1", 9), ("c", None, 9)])]
    df = spark.createDataFrame(data, INDEX.replace("indexed_at timestamp", "indexed_at string")).withColumn("indexed_at", F.col("indexed_at").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/pt_index.parquet")
    assert {tuple(r) for r in tc.p6_found(spark, str(tmp_path)).select("term", "mark").collect()} == {("a", "common"), ("b", "rare")}
    assert {r["term"]: r["occurrences"] for r in tc.p6_term_counts(spark, str(tmp_path)).collect()} == {"a": 4, "b": 1}
