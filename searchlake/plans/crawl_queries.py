"""Queries of the crawler's decisions, over pages, edges, hosts, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.functions import url as urls
from searchlake.operators import crawl
from searchlake.plans.search_queries import canonical_sql
from searchlake.session import table

DEPTH = 3


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").where("page_id <= 20").select("url")


def crawl_bfs_k(spark, folder):
    return crawl.crawl_levels(table(spark, folder, "edges"), _seeds(spark, folder), DEPTH)


def crawl_seen_anti(spark, folder):
    return crawl.unseen(table(spark, folder, "edges").select(F.col("dst").alias("url")), table(spark, folder, "pages"))


def crawl_blacklist(spark, folder):
    pages = table(spark, folder, "pages").select("url")
    bad = table(spark, folder, "pages").where("page_id % 7 = 0").select(urls.canonical_url(F.col("url")).alias("url"))
    return crawl.not_blacklisted(pages, bad)


def url_trap_filter(spark, folder):
    return table(spark, folder, "pages").where(~urls.is_trap(F.col("url"))).select("url")


def robots_allowed(spark, folder):
    rules = crawl.robots_rules(table(spark, folder, "hosts")).select("host", "rules")
    one = rules.groupBy("host").agg(F.min("rules").alias("rules"))  # of several texts of a host, the same one at every run
    pages = table(spark, folder, "pages").select("url", urls.url_host(F.col("url")).alias("host"), urls.url_path(F.col("url")).alias("path"))
    found = pages.join(one, "host", "left")
    return found.select("url", crawl.robots_allow(F.col("path"), F.coalesce("rules", F.array().cast(crawl.ROBOTS))).alias("allowed"))


def robots_match(spark, folder):
    cases = spark.createDataFrame([("/a/b",), ("/c",), ("/a",)], "path string")
    rules = F.array(F.struct(F.lit(False).alias("allow"), F.lit("/a").alias("prefix")), F.struct(F.lit(True).alias("allow"), F.lit("/a/b").alias("prefix")))
    return cases.select("path", crawl.robots_allow(F.col("path"), rules).alias("allowed"))


def crawl_delay(spark, folder):
    return table(spark, folder, "hosts").where("host IS NOT NULL").select("host", crawl.crawl_gap(F.col("crawl_delay_ms")).cast("long").alias("gap_ms"))


def content_type_filter(spark, folder):
    kinds = ["text/html; charset=utf-8", "TEXT/PLAIN", "application/xhtml+xml", "application/xml", "text/xml", "image/png", "application/json", None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "id int, content_type string")
    return rows.where(crawl.is_page_type(F.col("content_type")))


def size_filter(spark, folder):
    return table(spark, folder, "pages").where(crawl.is_page_size(F.octet_length("html"))).select("url")


def lang_filter(spark, folder):
    return table(spark, folder, "documents").where(crawl.is_english(F.col("lang"))).select("doc_id")


def politeness_gap(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return crawl.politeness(events, "user_id", "ts", 3_600_000).groupBy("user_id").agg(F.count_if("too_soon").alias("too_soon"), F.min("gap_ms").alias("least_gap_ms"), F.sum("gap_ms").alias("span_ms"))


def politeness_ready(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return crawl.politeness(events, "user_id", "ts", 36_000_000).select("user_id", "ready_at_ms")


ROBOTS_CASES = [
    (1, "User-agent: *\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 2.5", "/a/b", False, 2500),
    (2, "User-agent: *\nAllow: /a/b\nDisallow: /a # all else", "/a/b", True, None),
    (3, "User-agent: other\nDisallow: /", "/x", True, None),
    (4, "User-agent: other\nUser-agent: *\nDisallow: /", "/x", False, None),
    (5, "User-agent: *\nDisallow:", "/x", True, None),
    (6, "User-agent: *\nDisallow: /x\nUser-agent: other\nAllow: /", "/x/y", False, None),
    (7, "rubbish\nDisallow: /x", "/x", True, None),
    (8, "", "/", True, None),
    (9, None, "/", True, None),
    (10, "USER-AGENT: *\nDISALLOW: /Q\ncrawl-delay: soon", "/q", True, None),
]


def robots_cases(spark, folder):
    """The parser and the matcher on texts whose answers are known."""
    cases = spark.createDataFrame([c[:3] for c in ROBOTS_CASES], "id int, robots_text string, path string").withColumn("host", F.col("id").cast("string"))
    found = cases.select("id", "host", "path").join(crawl.robots_rules(cases), "host")
    return found.select("id", crawl.robots_allow(F.col("path"), F.col("rules")).alias("allowed"), "delay_ms")


def content_dedup(spark, folder):
    return crawl.content_dedup(table(spark, folder, "documents"), "doc_id", "text")


def fetch_outcome(spark, folder):
    rows = [
        (1, 200, "text/html", 5000, "en", None), (2, 301, None, 0, None, "https://a.example/"), (3, 404, "text/html", 900, None, None), (4, 200, "image/png", 900, None, None),
        (5, 200, "text/html", 100, None, None), (6, 200, "text/html", 10_000_001, None, None), (7, 503, None, 0, None, None), (8, 200, "text/html", 5000, "fr", None),
        (9, None, None, None, None, None), (10, 403, "text/html", 500, "en-GB", None), (11, 302, None, 0, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, status int, content_type string, length long, language string, location string")
    return df.select("id", crawl.fetch_outcome(*[F.col(c) for c in ("status", "content_type", "length", "language", "location")]).alias("outcome"))


QUERIES = {f.__name__: f for f in (
    crawl_bfs_k, crawl_seen_anti, crawl_blacklist, url_trap_filter, robots_allowed, robots_match, crawl_delay, content_type_filter, size_filter, lang_filter, politeness_gap, politeness_ready, robots_cases, content_dedup, fetch_outcome,
)}

_PATH = f"CASE WHEN regexp_extract(split_part(url, '#', 1), '{urls.PARTS}', 4) = '' THEN '/' ELSE regexp_extract(split_part(url, '#', 1), '{urls.PARTS}', 4) END"

SQL = {
    "crawl_bfs_k": f"""
        WITH RECURSIVE w AS (SELECT url, 0 AS level FROM pages WHERE page_id <= 20 AND url IS NOT NULL
          UNION SELECT dst, level + 1 FROM w JOIN edges ON src = url WHERE dst IS NOT NULL AND level < {DEPTH})
        SELECT url, min(level) AS level FROM w GROUP BY url""",
    "crawl_seen_anti": "SELECT DISTINCT dst AS url FROM edges WHERE dst IS NOT NULL AND dst NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)",
    "crawl_blacklist": f"SELECT url FROM pages WHERE lower({canonical_sql('url')}) NOT IN (SELECT lower({canonical_sql('url')}) FROM pages WHERE page_id % 7 = 0)",
    "url_trap_filter": rf"SELECT url FROM pages WHERE NOT regexp_matches({_PATH}, '{urls.TRAP}')",
    "robots_match": "SELECT * FROM (VALUES ('/a/b', false), ('/c', true), ('/a', false)) t(path, allowed)",
    "crawl_delay": "SELECT host, CASE WHEN crawl_delay_ms >= 0 THEN crawl_delay_ms ELSE 500 END AS gap_ms FROM hosts WHERE host IS NOT NULL",
    "content_type_filter": "SELECT * FROM (VALUES (0, 'text/html; charset=utf-8'), (1, 'TEXT/PLAIN'), (2, 'application/xhtml+xml'), (3, 'application/xml'), (4, 'text/xml'), (7, NULL)) t(id, content_type)",
    "size_filter": "SELECT url FROM pages WHERE strlen(html) BETWEEN 200 AND 10000000",
    "lang_filter": "SELECT doc_id FROM documents WHERE lang IS NULL OR starts_with(lower(lang), 'en')",
    "politeness_gap": """
        SELECT user_id, count(*) FILTER (gap < 3600000) AS too_soon, min(gap) AS least_gap_ms, sum(gap)::bigint AS span_ms
        FROM (SELECT user_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) GROUP BY user_id""",
    "politeness_ready": """
        WITH v AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
        SELECT user_id, (36000000 * k + max(ms - 36000000 * k) OVER (PARTITION BY user_id ORDER BY k))::bigint AS ready_at_ms FROM v""",
    "robots_cases": "SELECT * FROM (VALUES (1, false, 2500), (2, true, NULL), (3, true, NULL), (4, false, NULL), (5, true, NULL), (6, false, NULL), (7, true, NULL), (8, true, NULL), (9, true, NULL), (10, true, NULL)) t(id, allowed, delay_ms)",
    "content_dedup": "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE text IS NOT NULL",
    "fetch_outcome": """SELECT * FROM (VALUES (1, 'store'), (2, 'redirect'), (3, 'blacklist'), (4, 'blacklist_type'), (5, 'skip_small'), (6, 'blacklist_size'), (7, 'retry'), (8, 'skip_language'),
        (9, 'retry'), (10, 'skip_status'), (11, 'skip_status')) t(id, outcome)""",
}
