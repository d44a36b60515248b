"""Queries of the link graph, ranks, search, suggestions and spelling, over pages and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.functions import text, url as urls
from searchlake.operators import index as ix, pagerank as pr, search as se
from searchlake.plans.index_queries import DOCS, VISIBLE_SQL, WHOLE, index_of, kept, pages_of
from searchlake.operators.crawl import CheckpointPolicy
from searchlake.session import scratch_path, table

ONE, TWO, THREE = "harbour", "salt cheese", "barley bread crawler"
ITERATIONS = 3


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return pr.graph(table(spark, folder, "edges"), pages_of(spark, folder).select(F.col("url").alias("id")))


def _ranks(spark: SparkSession, folder: str) -> DataFrame:
    links, nodes = _graph(spark, folder)
    return pr.iterate(links, nodes, ITERATIONS)


def stored_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks that were made and stored apart, as searches read them."""
    build = lambda path: _ranks(spark, folder).select("id", "rank").write.parquet(path)
    return spark.read.parquet(kept(spark, folder, ("edges", "pages"), "ranks", "", build))


def _index(spark: SparkSession, folder: str, query: str | None = None) -> ix.Index:
    """The stored index, or what of it the terms of a query need."""
    return index_of(spark, folder, None if query is None else text.query_terms(query))


def link_edges(spark, folder):
    return pr.link_edges(pages_of(spark, folder))


def link_edges_absolute(spark, folder):
    docs = ix.documents(pages_of(spark, folder))
    links = docs.select("url", F.explode(urls.extract_hrefs(F.col("html"))).alias("href")).where(F.col("href").rlike("^https?://"))
    return links.select("url", urls.canonical_url(F.col("href")).alias("dst")).distinct()


def canonical_urls(spark, folder):
    u = F.col("url")
    return pages_of(spark, folder).select("page_id", urls.canonical_url(u).alias("canonical"), urls.url_host(u).alias("host"), urls.url_path(u).alias("path"))


def anchor_texts(spark, folder):
    docs = ix.documents(pages_of(spark, folder))
    return docs.select("url", F.explode(urls.extract_anchors(F.col("html"))).alias("a")).select("url", "a.href", "a.text")


def pagerank_k_iters(spark, folder):
    return _ranks(spark, folder).select("id", F.round("rank", 6).alias("rank"))


def pagerank_convergence(spark, folder):
    found = pr.convergence(_ranks(spark, folder), 0.01)
    return found.select(F.round("max_diff", 6).alias("max_diff"), "converged", "total")


def pagerank(spark, folder):
    edges, pages = table(spark, folder, "edges"), pages_of(spark, folder)
    done = pr.pagerank(edges, pages.select(F.col("url").alias("id")), threshold=0.001)
    return done.ranks.select("id", F.round("rank", 2).alias("rank"))


def search_tfidf(spark, folder):
    return se.tfidf(_index(spark, folder, ONE), ONE).select("url", F.round("tfidf", 6).alias("tfidf"))


def search_stopword(spark, folder):
    return se.tfidf(_index(spark, folder, "The"), "The").select("url", "tfidf")


def search_unknown(spark, folder):
    """A term that no page has, with all terms asked for: nothing is found, and no page is read for it."""
    return se.tfidf(_index(spark, folder, "salt zzzzzzzzz"), "salt zzzzzzzzz").select("url", "tfidf")


def pagerank_resumed(spark, folder):
    """Three iterations that are checkpointed, then the rest from the checkpoint."""
    edges, nodes, path = table(spark, folder, "edges"), pages_of(spark, folder).select(F.col("url").alias("id")), scratch_path(spark, "ranks")
    try:
        pr.pagerank(edges, nodes, max_iterations=3, checkpoint=path, policy=CheckpointPolicy(every=1))
    except RuntimeError:
        pass
    assert pr.last_checkpoint(spark, path)[1]["iteration"] == 3
    done = pr.pagerank(edges, nodes, checkpoint=path)
    return done.ranks.select("id", F.round("rank", 2).alias("rank"))


def search_stemmed(spark, folder):
    found = se.tfidf(index_of(spark, folder, stems=True), "crawlers maps", stems=True)
    return found.select("url", F.round("tfidf", 6).alias("tfidf"))


def search_and(spark, folder):
    found = se.tfidf(_index(spark, folder, THREE), THREE, phrase=False)
    return found.select("url", F.round("tfidf", 6).alias("tfidf"))


def search_phrase(spark, folder):
    return se.tfidf(_index(spark, folder, TWO), TWO).select("url", F.round("tfidf", 6).alias("tfidf"), "is_phrase")


def search_coverage(spark, folder):
    found = se.search(_index(spark, folder, THREE), THREE, titles=False, require_all=False)
    return found.select("url", F.round("total_score", 6).alias("total_score"))


def search_title_boost(spark, folder):
    rows = table(spark, folder, "search_results").where("title IS NOT NULL").select("title").distinct()
    one, two = se.title_boost(F.col("title"), ["guide"]), se.title_boost(F.col("title"), ["salt", "cheese"])
    return rows.select("title", one.alias("one"), two.alias("two"))


def search_ranked(spark, folder):
    found = se.search(_index(spark, folder, TWO), TWO, stored_ranks(spark, folder))
    return found.select("url", *[F.round(c, 6).alias(c) for c in ("total_score", "tfidf_score", "page_rank_score")], "title")


def search_page(spark, folder):
    found = se.search(_index(spark, folder, ONE), ONE)
    rounded = found.select("url", F.round("total_score", 6).alias("total_score"), "title")
    return se.result_page(rounded, 2, 10)


def search_preview(spark, folder):
    found = se.search(_index(spark, folder, TWO), TWO, pages=pages_of(spark, folder))
    return found.select("url", "preview")


def search_cached_queries(spark, folder):
    run = se.CachedSearch(_index(spark, folder, TWO))
    first, again = run(TWO), run("  Salt  CHEESE ")
    assert first == again and run.cache_info().hits == 1
    return spark.createDataFrame([(r["url"], round(r["total_score"], 6)) for r in again], "url string, total_score double")


def suggest(spark, folder):
    return se.suggest(ix.vocabulary(_index(spark, folder).terms), "salt che")


def spellcheck(spark, folder):
    return se.spellcheck(ix.vocabulary(_index(spark, folder).terms), "harbor chese crawler zzzzzzzzz")


def spellcheck_query(spark, folder):
    return se.spellcheck_query(ix.vocabulary(_index(spark, folder).terms), "harbor chese")


def cached_page(spark, folder):
    pages = pages_of(spark, folder)
    first = pages.agg(F.min("url")).first()[0]
    return se.cached_page(pages, first)


QUERIES = {f.__name__: f for f in (
    link_edges, link_edges_absolute, canonical_urls, anchor_texts, pagerank_k_iters, pagerank_convergence, pagerank, pagerank_resumed, search_unknown, search_tfidf, search_stopword, search_stemmed, search_and,
    search_phrase, search_coverage, search_title_boost, search_ranked, search_page, search_preview, search_cached_queries, suggest, spellcheck, spellcheck_query, cached_page,
)}

_HREFS = f"list_transform(regexp_extract_all(html, '{urls.HREF.replace(chr(39), chr(39) * 2)}', 1), lambda h: regexp_replace(h, '^[\"'']|[\"'']$', '', 'g'))"

_ATTRIBUTE = urls.HREF_ATTRIBUTE.replace(chr(39), chr(39) * 2)


def canonical_sql(u: str) -> str:
    def part(g: int) -> str:
        return f"regexp_extract(trim(split_part({u}, '#', 1)), '{urls.PARTS}', {g})"

    return f"""CASE WHEN {part(2)} <> '' THEN lower({part(1)}) || '://' || lower({part(2)}) || CASE WHEN {part(3)} <> '' THEN {part(3)} WHEN lower({part(1)}) = 'https' THEN ':443' ELSE ':80' END
        || CASE WHEN {part(4)} = '' THEN '/' ELSE {part(4)} END || {part(5)} END"""


def _rank_sql(iterations: int) -> str:
    parts = ["""e AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL), d AS (SELECT src, 0.85::double / count(*) AS share FROM e GROUP BY src),
        n AS (SELECT DISTINCT url AS id FROM pages WHERE url IS NOT NULL), l AS (SELECT e.src, e.dst, share FROM e JOIN d USING (src) WHERE dst IN (SELECT id FROM n)),
        r0 AS (SELECT id, 1.0::double AS rank, 1.0::double AS prev FROM n)"""]
    for k in range(iterations):
        parts.append(f"""s{k} AS MATERIALIZED (SELECT dst AS id, sum(share * rank) AS c FROM l JOIN r{k} ON src = id GROUP BY dst),
            r{k + 1} AS MATERIALIZED (SELECT r{k}.id, coalesce(c, 0) + (1 - 0.85)::double AS rank, r{k}.rank AS prev FROM r{k} LEFT JOIN s{k} ON r{k}.id = s{k}.id)""")  # fmt: skip
    return ", ".join(parts)


def _settled_sql(threshold: float, most: int) -> str:
    """Ranks of the first iteration, of at most so many, in which no rank changes by the threshold."""
    changes = " UNION ALL ".join(f"SELECT {k} AS k, max(abs(rank - prev)) AS d FROM r{k}" for k in range(1, most + 1))
    ranks = " UNION ALL ".join(f"SELECT {k} AS k, id, rank FROM r{k}" for k in range(1, most + 1))
    return f"""WITH {_rank_sql(most)}, changes AS MATERIALIZED ({changes}), last AS MATERIALIZED (SELECT min(k) AS k FROM changes WHERE d < {threshold} OR d IS NULL)
        SELECT id, round(rank, 2) AS rank FROM ({ranks}) JOIN last USING (k)"""


def _found_sql(terms: list[str], require_all: bool, phrase: bool) -> str:
    """CTE f(url, tfidf, matched, is_phrase) over pn and te."""
    listed = ", ".join(f"'{t}'" for t in terms)
    beside = " AND ".join(
        f"list_has_any(list_transform(max(positions) FILTER (pn.term = '{a}'), lambda p: p + 1), max(positions) FILTER (pn.term = '{b}'))" for a, b in zip(terms, terms[1:])
    ) or "false"
    return f"""f0 AS (SELECT url, sum(CASE WHEN is_stop OR normalized_tf <= 0 THEN 0 ELSE normalized_tf * idf END) AS s, count(DISTINCT pn.term) AS matched, coalesce({beside}, false) AS is_phrase
          FROM pn JOIN te USING (term) WHERE pn.term IN ({listed}) GROUP BY url {f'HAVING count(DISTINCT pn.term) = {len(terms)}' if require_all else ''}),
        f AS (SELECT url, s * CASE WHEN is_phrase AND {str(phrase).lower()} THEN 1.5 ELSE 1 END AS tfidf, matched, is_phrase FROM f0)"""


def title_boost_sql(terms: list[str], title: str = "title") -> str:
    words = f"list_filter(string_split_regex(lower(regexp_replace(coalesce({title}, ''), '{text.SIGNS}', ' ', 'g')), '{text.SPACE}'), lambda t: t <> '')"
    p = [f"coalesce(list_position({words}, '{t}'), 0)" for t in terms]
    if len(p) == 1:
        return f"CASE WHEN {p[0]} = 1 THEN 3.5 WHEN {p[0]} BETWEEN 2 AND 3 THEN 2.5 WHEN {p[0]} > 3 THEN 2.0 ELSE 1.0 END::double"
    held = " + ".join(f"({x} > 0)::int" for x in p)
    ordered, early = " AND ".join(f"{a} < {b}" for a, b in zip(p, p[1:])), " AND ".join(f"{x} <= 4" for x in p)
    return f"""CASE WHEN {held} = {len(p)} THEN CASE WHEN {ordered} AND {early} THEN 4.0 WHEN {ordered} THEN 3.0 WHEN {early} THEN 2.5 ELSE 2.0 END
        WHEN {held} > 0 THEN 1.0 + 0.2 * ({held}) ELSE 1.0 END::double"""


_TEXT = f"trim(regexp_replace({VISIBLE_SQL}, '{text.SPACE}', ' ', 'g'))"
_T = TWO.split()
_AT = "coalesce(" + ", ".join(f"nullif(strpos(lower(x), '{t}'), 0)" for t in _T) + ", 0)"
_NEAR = """WITH w AS (SELECT unnest(range(len(l))) AS i, unnest(l) AS word FROM (SELECT {words} AS l)),
    v AS (SELECT word, i, term, levenshtein(term, word) AS d FROM w, (SELECT term FROM te WHERE regexp_matches(term, '^[a-z]{{1,20}}$'))),
    b AS (SELECT i, arg_min(term, (d, term)) AS term, min(d) AS d FROM v WHERE d <= 2 GROUP BY i)"""


def _near_sql(query: str, last: str) -> str:
    return WHOLE + ", " + _NEAR.format(words=str(query.split())).removeprefix("WITH ") + last


SQL = {
    "link_edges_absolute": f"WITH {DOCS} SELECT DISTINCT url, {canonical_sql('h')} AS dst FROM (SELECT url, unnest({_HREFS}) AS h FROM docs) WHERE regexp_matches(h, '^https?://')",
    "canonical_urls": f"""SELECT page_id, {canonical_sql('url')} AS canonical, lower(nullif(regexp_extract(url, '{urls.PARTS}', 2), '')) AS host,
        CASE WHEN regexp_extract(split_part(url, '#', 1), '{urls.PARTS}', 4) = '' THEN '/' ELSE regexp_extract(split_part(url, '#', 1), '{urls.PARTS}', 4) END AS path FROM pages""",
    "link_edges": f"""WITH {DOCS}, h AS (SELECT DISTINCT {canonical_sql('url')} AS src, trim(split_part(h, '#', 1)) AS h FROM (SELECT url, unnest({_HREFS}) AS h FROM docs)),
        f AS (SELECT src, CASE WHEN regexp_matches(h, '(?i)^https?://') THEN h WHEN starts_with(h, '//') THEN split_part(src, '//', 1) || h
            WHEN starts_with(h, '/') THEN regexp_extract(src, '^[a-z]+://[^/]+') || h END AS u FROM h WHERE src IS NOT NULL)
        SELECT DISTINCT src, {canonical_sql('u')} AS dst FROM f WHERE u IS NOT NULL AND NOT regexp_matches(lower(split_part(u, '?', 1)), '\\.(jpg|jpeg|gif|png|txt)$')""",
    "anchor_texts": f"""WITH {DOCS}, a AS (SELECT url, unnest(list_zip(regexp_extract_all(html, '{urls.ANCHOR}', 1), regexp_extract_all(html, '{urls.ANCHOR}', 2))) AS z FROM docs),
        t AS (SELECT url, regexp_replace(regexp_extract(z[1], '{_ATTRIBUTE}', 1), '^["'']|["'']$', '', 'g') AS href,
            trim(regexp_replace(regexp_replace(z[2], '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM a)
        SELECT * FROM t WHERE href <> ''""",
    "pagerank_k_iters": f"WITH {_rank_sql(ITERATIONS)} SELECT id, round(rank, 6) AS rank FROM r{ITERATIONS}",
    "pagerank_convergence": f"WITH {_rank_sql(ITERATIONS)} SELECT round(max(abs(rank - prev)), 6) AS max_diff, count(*) FILTER (abs(rank - prev) <= 0.01) AS converged, count(*) AS total FROM r{ITERATIONS}",
    "pagerank": _settled_sql(0.001, 80),
    "pagerank_resumed": _settled_sql(0.001, 80),
    "search_unknown": f"{WHOLE}, {_found_sql(['salt', 'zzzzzzzzz'], True, True)} SELECT url, tfidf FROM f",
    "search_tfidf": f"{WHOLE}, {_found_sql([ONE], False, True)} SELECT url, round(tfidf, 6) AS tfidf FROM f",
    "search_stopword": "SELECT url, 0.0 AS tfidf FROM pages WHERE false",
    "search_and": f"{WHOLE}, {_found_sql(THREE.split(), True, False)} SELECT url, round(tfidf, 6) AS tfidf FROM f",
    "search_phrase": f"{WHOLE}, {_found_sql(_T, True, True)} SELECT url, round(tfidf, 6) AS tfidf, is_phrase FROM f",
    "search_coverage": f"{WHOLE}, {_found_sql(THREE.split(), False, True)} SELECT url, round(tfidf * CASE WHEN matched >= 3 THEN 4.0 ELSE 0.3 + 0.7 * matched / 3 END, 6) AS total_score FROM f",
    "search_title_boost": f"SELECT DISTINCT title, {title_boost_sql(['guide'])} AS one, {title_boost_sql(['salt', 'cheese'])} AS two FROM search_results WHERE title IS NOT NULL",
    "search_ranked": f"""{WHOLE}, {_rank_sql(ITERATIONS)}, {_found_sql(_T, True, True)}
        SELECT url, round(tfidf * (1 + coalesce(rank, 0)) * 4.0 * {title_boost_sql(_T)}, 6) AS total_score, round(tfidf, 6) AS tfidf_score, round(coalesce(rank, 0), 6) AS page_rank_score, coalesce(title, '') AS title
        FROM f LEFT JOIN st USING (url) LEFT JOIN r{ITERATIONS} ON id = url""",
    "search_page": f"""{WHOLE}, {_found_sql([ONE], False, True)} SELECT url, round(tfidf * {title_boost_sql([ONE])}, 6) AS total_score, coalesce(title, '') AS title
        FROM f LEFT JOIN st USING (url) ORDER BY total_score DESC, url LIMIT 10 OFFSET 10""",
    "search_preview": f"""{WHOLE}, {_found_sql(_T, True, True)}, x AS (SELECT url, {_TEXT} AS x FROM docs WHERE url IN (SELECT url FROM f)),
        y AS (SELECT url, x, greatest({_AT} - 81, 0) AS b, least(greatest({_AT} - 1, 0) + 350, length(x)) AS e FROM x)
        SELECT url, CASE WHEN length(x) < 50 THEN '' ELSE CASE WHEN b > 0 THEN '...' ELSE '' END || substr(x, b + 1, e - b) || CASE WHEN e < length(x) THEN '...' ELSE '' END END AS preview FROM y""",
    "search_cached_queries": f"""{WHOLE}, {_found_sql(_T, True, True)} SELECT url, round(tfidf * 4.0 * {title_boost_sql(_T)}, 6) AS total_score
        FROM f LEFT JOIN st USING (url) ORDER BY tfidf * 4.0 * {title_boost_sql(_T)} DESC, url LIMIT 15""",
    "suggest": WHOLE + " SELECT 'salt ' || term AS suggestion FROM te WHERE regexp_matches(term, '^[a-z]{1,20}$') AND starts_with(term, 'che') ORDER BY term LIMIT 10",
    "spellcheck": _near_sql("harbor chese crawler zzzzzzzzz", " SELECT w.i, w.word, CASE WHEN d > 0 THEN term END AS correction FROM w LEFT JOIN b USING (i)"),
    "spellcheck_query": _near_sql("harbor chese", " SELECT string_agg(CASE WHEN d > 0 THEN term ELSE word END, ' ' ORDER BY i) AS correction FROM w LEFT JOIN b USING (i) HAVING count(CASE WHEN d > 0 THEN 1 END) > 0"),
    "cached_page": "SELECT url, html FROM pages WHERE url = (SELECT min(url) FROM pages)",
}
