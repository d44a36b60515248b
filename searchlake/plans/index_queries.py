"""Queries of the text functions and of the index over pages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.functions import porter, text
from searchlake.functions import url as urls
from searchlake.operators import index as ix
from searchlake.session import drop_at_exit, materialize, path_exists, scratch_path, shared_folder, table, table_version


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


#: Indexes that were built for a table as it is, by session and table: searches read them from the shared folder.
_stores: dict[tuple[str, str, str], str] = {}
BUCKETS = 32


def kept(spark: SparkSession, folder: str, tables: tuple[str, ...], what: str, last: str, build: Callable[[str], None]) -> str:
    """The path of something made of tables as they are; it is built at the first call of a session, `last` being written last."""
    key = (spark.sparkContext.applicationId, " ".join(table_version(spark, folder, t) for t in tables), what)
    path = _stores.get(key)
    if path is None or not path_exists(spark, f"{path}{last}/_SUCCESS"):
        path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
        build(path)
        _stores[key] = path
        drop_at_exit(path)
    return path


def stored(spark: SparkSession, folder: str, stems: bool = False) -> str:
    """The path of the stored index of the pages of a folder."""
    build = lambda path: ix.build_in_buckets(spark, pages_of(spark, folder), path, url_buckets=1, buckets=BUCKETS, stems=stems)
    return kept(spark, folder, ("pages",), "stems" if stems else "index", "/terms", build)


def index_of(spark: SparkSession, folder: str, terms: list[str] | None = None, stems: bool = False) -> ix.Index:
    """The stored index, or the part of it that holds some terms."""
    return ix.read_index(spark, stored(spark, folder, stems), terms, BUCKETS)


def docs(spark, folder):
    return ix.documents(pages_of(spark, folder), ix.MAX_PAGE).select("url", F.length("html").alias("n_chars"))


def docs_left_out(spark, folder):
    return ix.left_out(pages_of(spark, folder), 800)


def tokenize(spark, folder):
    return ix.documents(pages_of(spark, folder)).select("url", F.array_join(text.tokens(F.col("html")), " ").alias("tokens"))


def doc_stats(spark, folder):
    return ix.doc_stats(ix.documents(pages_of(spark, folder)), ix.MAX_TITLE)


def doc_stats_one_per_url(spark, folder):
    known = table(spark, folder, "doc_stats").where("url IS NOT NULL")
    return ix.one_per_url(known)


def index_buckets(spark, folder):
    """A build in four buckets that is stopped after one and goes on; documents and terms by what is stored."""
    path = scratch_path(spark, "buckets")
    first = ix.build_in_buckets(spark, pages_of(spark, folder), path, 4, 8, stop_after=1)
    rest = ix.build_in_buckets(spark, pages_of(spark, folder), path, 4, 8)
    assert (first, rest) == ([0], [1, 2, 3]) and ix.build_in_buckets(spark, pages_of(spark, folder), path, 4, 8) == []
    found = ix.read_index(spark, path, buckets=8)
    return found.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def url_buckets(spark, folder):
    return pages_of(spark, folder).select("url", urls.bucket_of(F.col("url"), 100).alias("bucket"))


def value_hashes(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.sha1(F.col("p_name")).alias("hash"))


def corpus_size(spark, folder):
    stats = ix.doc_stats(ix.documents(pages_of(spark, folder)))
    return stats.agg(F.countDistinct("url").alias("n"))


def index_resume_anti(spark, folder):
    all_docs = ix.documents(pages_of(spark, folder))
    done = table(spark, folder, "doc_stats").where("length > 300")
    return ix.not_yet_indexed(all_docs, done).select("url")


def token_positions(spark, folder):
    return ix.token_positions(ix.documents(pages_of(spark, folder))).select("url", "token", F.col("position").cast("long").alias("position"), "weight")


def _listed(found: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("positions", lambda p: p.cast("string")), " ")
    return found.select("term", "url", F.col("tf").cast("long").alias("tf"), F.round("weighted_tf", 6).alias("weighted_tf"), joined.alias("positions"), "is_stop")


def postings(spark, folder):
    return _listed(ix.postings(ix.documents(pages_of(spark, folder))))


def tf(spark, folder):
    found = ix.postings(ix.documents(pages_of(spark, folder)))
    return found.select("term", "url", F.round("normalized_tf", 6).alias("normalized_tf"), "doc_len")


def postings_topn(spark, folder):
    found = materialize(ix.postings(ix.documents(pages_of(spark, folder))), "postings")
    return ix.top_postings(found, 20, 5).select("term", "url", F.round("weighted_tf", 6).alias("weighted_tf"))


def idf(spark, folder):
    return index_of(spark, folder).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def idf_text(spark, folder):
    return index_of(spark, folder).terms.select("term", text.fixed(F.col("idf"), 8).alias("idf"))


def _merged(spark, folder) -> ix.Index:
    """Two indexes whose pages overlap: those crawled in the first and those in the last part of the time; together all."""
    p = pages_of(spark, folder)
    low, high = p.agg(F.min(F.unix_micros("crawled_at")), F.max(F.unix_micros("crawled_at"))).first()
    low, high = low or 0, high or 0
    at = F.coalesce(F.unix_micros("crawled_at"), F.lit(low))
    old, new = p.where(at <= low + (high - low) * 6 // 10), p.where(at >= low + (high - low) * 4 // 10)
    return ix.merge_indexes(ix.build_index(old), ix.build_index(new))


def index_merge(spark, folder):
    return _merged(spark, folder).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def index_merge_postings(spark, folder):
    return _listed(_merged(spark, folder).postings)


def vocabulary(spark, folder):
    return ix.vocabulary(index_of(spark, folder).terms)


def index_cells(spark, folder):
    return ix.export_cells(index_of(spark, folder)).select("term", F.regexp_replace("_value", r"^[0-9.]+\t", "").alias("cell"))


def stem_postings(spark, folder):
    return _listed(ix.postings(ix.documents(pages_of(spark, folder)), stems=True))


def stem_vocabulary(spark, folder):
    return porter.stem_vocabulary(index_of(spark, folder).terms)


def stop_words(spark, folder):
    terms = index_of(spark, folder).terms
    return terms.where(text.is_stop_word(F.col("term"))).select("term", "df")


def escape_and_highlight(spark, folder):
    rows = table(spark, folder, "search_results").where("preview IS NOT NULL")
    return rows.select("result_id", text.escape_html(F.col("preview"), quotes=True).alias("escaped"), text.highlight(F.col("preview"), ["shard", "the"]).alias("marked"))


def fixed_decimals(spark, folder):
    return table(spark, folder, "search_results").select("result_id", text.fixed(F.coalesce("total_score", F.lit(float("nan"))), 3).alias("score"))


QUERIES = {f.__name__: f for f in (
    docs, docs_left_out, doc_stats_one_per_url, index_buckets, url_buckets, value_hashes, idf_text, index_merge_postings, tokenize, doc_stats, corpus_size, index_resume_anti, token_positions, postings, tf, postings_topn, idf, index_merge, vocabulary, index_cells, stem_postings, stem_vocabulary,
    stop_words, escape_and_highlight, fixed_decimals,
)}


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex(lower(regexp_replace({x}, '{text.SIGNS}', ' ', 'g')), '{text.SPACE}'), lambda t: t <> '')"


def without_sql(x: str, *patterns: str) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return x


TITLE_SQL = f"trim(regexp_replace(replace({without_sql(f"regexp_extract(html, '{text.TITLE}', 1)", text.TAG)}, ',', ' '), '{text.SPACE}', ' ', 'g'))"
VISIBLE_SQL = without_sql("html", text.SCRIPT, text.STYLE, text.COMMENT, text.META, text.TAG)
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"
DOCS = "docs AS (SELECT page_id, url, html FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)"


def _code_sql(pattern: str) -> str:
    return f"list_filter({words_sql(f"array_to_string(regexp_extract_all(html, '{pattern}', 1), ' ')")}, lambda t: length(t) >= 2)"


def index_sql(source: str = "docs", tag: str = "") -> str:
    """CTEs of tokens, doc stats, postings and terms over a table of documents."""
    worthy = f"lambda t: regexp_matches(t, '{text.WORTHY}')"
    return f"""
    tk{tag} AS (SELECT url, unnest(list_filter({words_sql(without_sql('html', text.TAG))}, {worthy})) AS token FROM {source}),
    tc{tag} AS (SELECT url, token, count(*) AS n FROM tk{tag} GROUP BY url, token),
    ts{tag} AS (SELECT url, sum(n)::int AS length, max(n)::int AS max_tf FROM tc{tag} GROUP BY url),
    st{tag} AS (SELECT url, coalesce(length, 0) AS length, coalesce(max_tf, 1) AS max_tf, {TITLE_SQL} AS title FROM {source} LEFT JOIN ts{tag} USING (url)),
    wt{tag} AS (SELECT url, {words_sql(VISIBLE_SQL)} AS seen, list_concat({_code_sql(text.SCRIPT)}, {_code_sql(text.STYLE)}) AS code FROM {source}),
    wl{tag} AS (SELECT url, len(seen) AS n_seen, list_concat(seen, code) AS l FROM wt{tag}),
    wp{tag} AS (SELECT url, n_seen, unnest(l) AS token, unnest(range(1, len(l) + 1)) AS position FROM wl{tag}),
    tp{tag} AS (SELECT url, token, position, CASE WHEN position <= n_seen THEN 1.0 ELSE {text.CODE_WEIGHT} END::double AS weight FROM wp{tag} WHERE regexp_matches(token, '{text.WORTHY}')),
    po{tag} AS (SELECT token AS term, url, count(*) AS tf, round(sum(weight), 9) AS weighted_tf, list(position ORDER BY position) AS positions, list(weight ORDER BY position) AS weights,
                     token IN {STOP_SQL} AS is_stop FROM tp{tag} GROUP BY token, url),
    pn{tag} AS (SELECT po{tag}.*, length AS doc_len, title, CASE WHEN weighted_tf > 0 AND max_tf > 0 THEN 0.4 + 0.6 * weighted_tf / max_tf ELSE 0 END AS normalized_tf
                FROM po{tag} JOIN st{tag} USING (url))"""


INDEX = f"WITH {DOCS}, {index_sql()}"
WHOLE = INDEX + """, te AS (SELECT term, count(*) AS df, ln((SELECT count(DISTINCT url) FROM st)::double / count(*)) AS idf FROM pn GROUP BY term)"""

SQL = {
    "docs": f"WITH {DOCS} SELECT url, length(html)::int AS n_chars FROM docs WHERE length(html) <= 1000000",
    "docs_left_out": "SELECT count(*) AS n_pages, coalesce(sum(length(html)), 0)::bigint AS n_chars FROM pages WHERE url IS NOT NULL AND length(html) > 800",
    "doc_stats_one_per_url": """SELECT url, length, max_tf, title FROM doc_stats WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY length DESC NULLS LAST, max_tf DESC NULLS LAST, title DESC NULLS LAST) = 1""",
    "url_buckets": "SELECT url, (('0x' || substr(sha1(url), 1, 13))::bigint % 100)::int AS bucket FROM pages",
    "value_hashes": "SELECT p_partkey, sha1(p_name) AS hash FROM part",
    "tokenize": f"WITH {DOCS} SELECT url, array_to_string(list_filter({words_sql(without_sql('html', text.TAG))}, lambda t: regexp_matches(t, '{text.WORTHY}')), ' ') AS tokens FROM docs",
    "doc_stats": INDEX + " SELECT url, length, max_tf, substr(title, 1, 200) AS title FROM st",
    "corpus_size": INDEX + " SELECT count(DISTINCT url) AS n FROM st",
    "index_resume_anti": f"WITH {DOCS} SELECT url FROM docs WHERE url NOT IN (SELECT url FROM doc_stats WHERE length > 300 AND url IS NOT NULL)",
    "token_positions": INDEX + " SELECT * FROM tp",
    "postings": INDEX + " SELECT term, url, tf, round(weighted_tf, 6) AS weighted_tf, array_to_string(positions, ' ') AS positions, is_stop FROM po",
    "tf": INDEX + " SELECT term, url, round(normalized_tf, 6) AS normalized_tf, doc_len FROM pn",
    "postings_topn": INDEX + " SELECT term, url, round(weighted_tf, 6) AS weighted_tf FROM pn QUALIFY row_number() OVER (PARTITION BY term ORDER BY weighted_tf DESC, url) <= CASE WHEN is_stop THEN 5 ELSE 20 END",
    "idf": WHOLE + " SELECT term, df, round(idf, 6) AS idf FROM te",
    "idf_text": WHOLE + " SELECT term, printf('%.8f', round(idf, 8)) AS idf FROM te",
    "index_merge": WHOLE + " SELECT term, df, round(idf, 6) AS idf FROM te",
    "index_buckets": WHOLE + " SELECT term, df, round(idf, 6) AS idf FROM te",
    "index_merge_postings": INDEX + " SELECT term, url, tf, round(weighted_tf, 6) AS weighted_tf, array_to_string(positions, ' ') AS positions, is_stop FROM po",
    "vocabulary": WHOLE + " SELECT term FROM te WHERE regexp_matches(term, '^[a-z]{1,20}$')",
    "index_cells": WHOLE + """ SELECT term, count(*) || chr(9) || string_agg(url || '|tf=' || tf || '|weightedTf=' || printf('%.4f', round(weighted_tf, 4)) || '|normalizedTf=' || printf('%.6f', round(normalized_tf, 6))
        || '|docLen=' || doc_len || '|pos=' || array_to_string(positions, ' ') || '|weights=' || array_to_string(list_transform(weights, lambda w: printf('%.3f', w)), ' ')
        || CASE WHEN is_stop THEN '|stop=true' ELSE '' END, ',' ORDER BY normalized_tf DESC, url) AS cell FROM pn GROUP BY term""",
    "stop_words": WHOLE + f" SELECT term, df FROM te WHERE term IN {STOP_SQL}",
    "escape_and_highlight": r"""
        WITH e AS (SELECT result_id, replace(replace(replace(preview, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM search_results WHERE preview IS NOT NULL)
        SELECT result_id, replace(replace(x, '"', '&quot;'), '''', '&#39;') AS escaped, regexp_replace(x, '(?i)\b(shard|the)\b', '<mark>\1</mark>', 'g') AS marked FROM e""",
    "fixed_decimals": "SELECT result_id, printf('%.3f', coalesce(round(total_score, 3), 0)) AS score FROM search_results",
}
