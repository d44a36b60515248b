import math

import pytest
from pyspark.sql import functions as F

from searchlake.operators import crawl, index as ix, pagerank as pr, search as se


def phrase_index(spark):
    schema = "term string, url string, tf int, weighted_tf double, normalized_tf double, doc_len int, positions array<int>, weights array<double>, is_stop boolean"
    data = [(t, f"http://doc{d}.com", 2, 1.0, 0.5, 10, p, [1.0, 1.0], False) for t, d, p in (("space", 1, [1, 3]), ("space", 2, [1, 10]), ("travel", 1, [2, 7]), ("travel", 2, [5, 15]))]
    terms = spark.createDataFrame([("space", 2, 1.0), ("travel", 2, 1.0)], "term string, df long, idf double")
    stats = spark.createDataFrame([(f"http://doc{d}.com", 10, 2, "") for d in (1, 2)], "url string, length int, max_tf int, title string")
    return ix.Index(spark.createDataFrame(data, schema), terms, stats)


def test_phrase_search(spark):
    ranks = spark.createDataFrame([("http://doc1.com", 0.2), ("http://doc2.com", 0.2)], "id string, rank double")
    idx = phrase_index(spark)
    full = {r["url"]: r for r in se.search(idx, "space travel", ranks).collect()}
    assert full["http://doc1.com"]["total_score"] == pytest.approx(7.2) and full["http://doc2.com"]["total_score"] == pytest.approx(4.8)
    assert full["http://doc1.com"]["tfidf_score"] == pytest.approx(1.5)
    plain = {r["url"]: r["total_score"] for r in se.search(idx, "space travel", ranks, coverage=False).collect()}
    assert plain == {"http://doc1.com": pytest.approx(1.8), "http://doc2.com": pytest.approx(1.2)}
    assert se.search(idx, "   ").count() == 0 and se.search(idx, "the").count() == 0 and se.search(idx, "space nothing").count() == 0
    first = se.result_page(se.search(idx, "space travel", ranks), 1, 1).collect()
    assert [r["url"] for r in first] == ["http://doc1.com"]


def test_title_boost(spark):
    cases = [("space", "Space Travel Guide", 3.5), ("guide", "Space Travel Guide", 2.5), ("end", "A long way to the end", 2.0), ("space travel", "Space Travel Guide", 4.0), ("travel space", "Space Travel Guide", 2.5), ("space ship", "Space Travel Guide", 1.2), ("x", None, 1.0)]
    for query, title, want in cases:
        got = spark.range(1).select(se.title_boost(F.lit(title).cast("string"), query.split())).first()[0]
        assert got == pytest.approx(want), (query, title)


def test_suggest_and_spelling(spark):
    vocabulary = spark.createDataFrame([(w,) for w in "animal animals goggle google googled".split()], "term string")
    assert [r[0] for r in se.suggest(vocabulary, "goo").collect()] == ["google", "googled"]
    assert [r[0] for r in se.suggest(vocabulary, "big goo").collect()] == ["big google", "big googled"]
    assert se.suggest(vocabulary, "go").count() == 0
    found = {r["word"]: r["correction"] for r in se.spellcheck(vocabulary, "animel google zzzzzzz").collect()}
    assert found == {"animel": "animal", "google": None, "zzzzzzz": None}
    assert se.spellcheck_query(vocabulary, "google").count() == 0
    assert se.spellcheck_query(vocabulary, "animel google").first()[0] == "animal google"


PAGES = [(1, "http://a.com/1", "<title>One</title><p>harbour crawlers the harbour</p>"), (2, "http://a.com/2", "<p>harbours</p>"), (3, "http://a.com/3", ""), (4, "http://a.com/4", None), (5, None, "<p>x</p>")]


def test_index(spark, rows):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    idx = ix.build_index(pages)
    found = {(r["term"], r["url"]): r for r in idx.postings.collect()}
    hit = found["harbour", "http://a.com/1"]
    assert hit["tf"] == 2 and hit["positions"] == [2, 5] and hit["doc_len"] == 5 and hit["normalized_tf"] == pytest.approx(0.4 + 0.6 * 2 / 2)
    assert found["the", "http://a.com/1"]["is_stop"]
    assert {r["term"]: r["idf"] for r in idx.terms.collect()}["harbour"] == pytest.approx(math.log(3))
    assert {r["url"]: (r["length"], r["max_tf"]) for r in idx.doc_stats.collect()}["http://a.com/3"] == (0, 1)
    stemmed = ix.build_index(pages, stems=True)
    assert {r["url"] for r in se.tfidf(stemmed, "harbour", stems=True).collect()} == {"http://a.com/1", "http://a.com/2"}
    merged = ix.merge_indexes(ix.build_index(pages.where("page_id = 1")), ix.build_index(pages))
    assert rows(merged.terms.select("term", "df")) == rows(idx.terms.select("term", "df"))
    capped = ix.top_postings(idx.postings, 1, 1)
    assert capped.groupBy("term").count().agg(F.max("count")).first()[0] == 1
    assert ix.build_index(pages.limit(0)).terms.count() == 0
    cell = {r["term"]: r["_value"] for r in ix.export_cells(idx).collect()}["harbour"]
    assert cell == "1.09861229\t1\thttp://a.com/1|tf=2|weightedTf=2.0000|normalizedTf=1.000000|docLen=5|pos=2 5|weights=1.000 1.000"


def test_stored_index(spark, rows, tmp_path):
    idx = ix.build_index(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    ix.write_index(idx, str(tmp_path / "index"), buckets=5)
    whole = ix.read_index(spark, str(tmp_path / "index"), buckets=5)
    assert rows(whole.terms.select("term", "df")) == rows(idx.terms.select("term", "df"))
    part = ix.read_index(spark, str(tmp_path / "index"), ["harbour"], buckets=5)
    assert {r["term"] for r in part.postings.collect()} == {"harbour"}
    assert rows(se.tfidf(part, "harbour").select("url")) == rows(se.tfidf(idx, "harbour").select("url"))


def ranks_of(spark, edges, n, nodes=None):
    links, state = pr.graph(spark.createDataFrame(edges, "src string, dst string"), nodes)
    return {r["id"]: round(r["rank"], 6) for r in pr.iterate(links, state, n).collect()}


def test_pagerank(spark):
    edges = [("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("A", "B"), (None, "A"), ("B", None)]
    assert ranks_of(spark, edges, 1) == {"A": 1.0, "B": 0.575, "C": 1.425}
    assert ranks_of(spark, edges, 2) == {"A": 1.36125, "B": 0.575, "C": 1.06375}
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    assert ranks_of(spark, [*edges, ("A", "X")], 1, nodes)["B"] == round(0.15 + 0.85 / 3, 6)
    done = pr.pagerank(spark.createDataFrame(edges, "src string, dst string"), threshold=0.01)
    assert done.max_diff < 0.01 and done.ranks.count() == 3
    again = pr.pagerank(spark.createDataFrame(edges, "src string, dst string"), threshold=0.01, resume=done.ranks)
    assert again.iterations == 1


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_a_job_runs_several_iterations(spark, monkeypatch, most):
    """The same ranks and number of iterations as one at a time, with far fewer jobs than iterations; in one task and over all."""
    edges = [(f"p{i}", f"p{i * i % 40}") for i in range(60)] + [(f"p{i}", f"p{(i + 1) % 60}") for i in range(60)] + [("p3", "p4"), ("p3", "out"), ("gone", "p1"), (None, "p1"), ("p1", None)]
    frame, nodes = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(f"p{i}",) for i in range(60)] + [("alone",), (None,), ("p1",)], "id string")
    links = [(s, d) for s, d in set(edges) if s and d]
    known, ranks, n, settled_at = {f"p{i}" for i in range(60)} | {"alone"}, {}, 0, {}
    ranks = dict.fromkeys(known, 1.0)
    while 0.001 not in settled_at:
        sums = dict.fromkeys(known, 0.0)
        for s, d in links:
            if s in known and d in known:
                sums[d] += 0.85 / sum(x == s for x, _ in links) * ranks[s]
        after = {i: c + 0.15 for i, c in sums.items()}
        diffs = [abs(after[i] - ranks[i]) for i in known]
        n, ranks = n + 1, after
        if max(diffs) < 0.001:
            settled_at[0.001] = n
        if sum(d <= 0.001 for d in diffs) >= 0.5 * len(known):
            settled_at.setdefault("half", n)
    writes, real = [], pr.materialize
    monkeypatch.setattr(pr, "ONE_TASK", most)
    monkeypatch.setattr(pr, "materialize", lambda df, label="stage": writes.append(label) or real(df, label))
    done = pr.pagerank(frame, nodes)
    assert {r["id"]: round(r["rank"], 9) for r in done.ranks.collect()} == {i: round(r, 9) for i, r in ranks.items()}
    assert done.iterations == n > 20 and done.percent == 100.0 and 0 < done.max_diff < 0.001
    assert writes.count("ranks") <= 1 + n // 10
    if most:  # the jobs over all tasks take long on a small machine
        assert pr.pagerank(frame, nodes, percent=50.0).iterations == settled_at["half"] < n
        with pytest.raises(RuntimeError):
            pr.pagerank(frame, nodes, max_iterations=n - 1)
        assert pr.pagerank(frame, nodes, max_iterations=n).iterations == n
        assert pr.pagerank(frame.limit(0)).ranks.count() == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_checkpoints_between_several_iterations(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(pr, "ONE_TASK", most)
    frame = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "A")], "src string, dst string")
    whole, path = pr.pagerank(frame, threshold=0.01), f"{tmp_path}/ranks"
    with pytest.raises(RuntimeError):
        pr.pagerank(frame, threshold=0.01, max_iterations=7, checkpoint=path, policy=crawl.CheckpointPolicy(every=3))
    assert sorted(x.name for x in (tmp_path / "ranks").iterdir()) == [f"iteration={k}" for k in (1, 3, 6)]
    rest = pr.pagerank(frame, threshold=0.01, checkpoint=path)
    assert rest.iterations == whole.iterations - 6 and pr.last_checkpoint(spark, path)[1]["done"]
    assert {r["id"]: round(r["rank"], 9) for r in rest.ranks.collect()} == {r["id"]: round(r["rank"], 9) for r in whole.ranks.collect()}


def test_link_edges(spark, rows):
    pages = spark.createDataFrame([("http://a.com/x/", '<a href="/y">y</a><a href=/y#f>y</a><a href="z/../w">w</a><a href="b.png">p</a>')], "url string, html string")
    assert rows(pr.link_edges(pages)) == [("http://a.com:80/x/", "http://a.com:80/x/w"), ("http://a.com:80/x/", "http://a.com:80/y")]


def test_robots():
    text = "User-agent: other\nDisallow: /\nUser-agent: *\nCrawl-delay: 2.5\nDisallow: /a # c\nAllow: /a/b\nAllow:\n"
    assert crawl.parse_robots(text) == ([(False, "/a"), (True, "/a/b")], 2500)
    assert crawl.parse_robots(text, "Other") == ([(False, "/")], None)
    assert crawl.parse_robots(None) == ([], None) and crawl.parse_robots("rubbish\n\x00") == ([], None)


def test_robots_allow(spark):
    def allowed(path, rules):
        column = F.array(*[F.struct(F.lit(a).alias("allow"), F.lit(p).alias("prefix")) for a, p in rules]) if rules else F.array().cast(crawl.ROBOTS)
        return spark.range(1).select(crawl.robots_allow(F.lit(path), column)).first()[0]

    rules = [(False, "/a"), (True, "/a/b")]
    assert not allowed("/a/b", rules) and allowed("/c", rules) and allowed("/x", [(False, "")]) and allowed("/x", [])


def test_crawl(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "b"), ("c", "d"), (None, "e")], "src string, dst string")
    levels = crawl.crawl_levels(edges, spark.createDataFrame([("a",)], "url string"), 2)
    assert rows(levels) == [("a", 0), ("b", 1), ("c", 2)]
    dup = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, "")], "id long, body string")
    assert rows(crawl.content_dedup(dup, "id", "body")) == [(1, 1), (2, 1), (3, 3), (5, 5)]
    policy = crawl.CheckpointPolicy()
    assert policy.due(1, 0) and not policy.due(2, 1) and policy.due(5, 1) and policy.due(6, 901)
    policy.wrote(901, 40)
    assert policy.factor == 2


def test_politeness(spark):
    visits = spark.createDataFrame([("h", "2024-01-01 23:59:59.9"), ("h", "2024-01-02 00:00:00.1"), ("h", "2024-01-02 00:00:10"), (None, "2024-01-01 00:00:00"), ("g", "2024-01-01 00:00:00")], "host string, ts string")
    found = crawl.politeness(visits.withColumn("ts", F.col("ts").cast("timestamp")), "host", "ts").where("host = 'h'").orderBy("ts").collect()
    assert [r["gap_ms"] for r in found] == [None, 200, 9900] and [r["too_soon"] for r in found] == [False, True, False]
    assert found[1]["ready_at_ms"] - found[0]["ready_at_ms"] == 500
