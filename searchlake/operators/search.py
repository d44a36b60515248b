"""Ranked search over an index, suggestions, spelling and cached pages.

A query becomes a handful of (original, expanded, priority) rows; everything else is one plan over
the postings of those terms.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlake.functions import text
from searchlake.functions.porter import stem, stem_vocabulary
from searchlake.functions.stopwords import STOP_WORDS
from searchlake.operators.index import Index

#: Boosts (fixed values).
PHRASE, ALL_TERMS, NO_TERM = 1.5, 4.0, 0.1
PAGE_SIZE, MAX_PAGE_SIZE = 15, 200


def expand(index: Index, terms: Sequence[str], stems: bool) -> DataFrame:
    """(i, original, term, priority): a term itself, then its stem, then the words with that stem. Stop words stay alone."""
    spark = index.postings.sparkSession
    own = [(i, t, t, 0) for i, t in enumerate(terms)]
    wanted = [(i, t, stem(t)) for i, t in enumerate(terms) if stems and t not in STOP_WORDS]
    own += [(i, t, s, 1) for i, t, s in wanted if s != t]
    rows = spark.createDataFrame(own, "i int, original string, term string, priority int")
    if wanted:
        base = spark.createDataFrame(wanted, "i int, original string, stem string")
        words = stem_vocabulary(index.terms).where("stem <> term").join(F.broadcast(base), "stem").where("term <> original")  # as many rows as the query has terms
        rows = rows.unionByName(words.select("i", "original", "term", F.lit(2).alias("priority")))
    return rows


def matches(index: Index, terms: Sequence[str], stems: bool = False) -> DataFrame:
    """(i, original, url, score, positions): what each term of a query finds, by its first expansion that finds it.

    Postings of stop words have positions, but no score.
    """
    expanded = expand(index, terms, stems)
    found = index.postings if stems else index.postings.where(F.col("term").isin(list(terms)))
    # without stems a query has as many rows as terms; words that share a stem come from the data, and Spark judges their size
    hits = found.join(expanded if stems else F.broadcast(expanded), "term").join(index.terms.select("term", "idf"), "term")
    counts = (~F.col("is_stop")) & (F.col("normalized_tf") > 0)
    value = F.when(counts, F.struct("priority", "term", (F.col("normalized_tf") * F.col("idf")).alias("s")))
    grouped = hits.groupBy("i", "original", "url").agg(F.min(value).alias("first"), F.flatten(F.collect_list("positions")).alias("positions"))
    return grouped.select("i", "original", "url", F.coalesce("first.s", F.lit(0.0)).alias("score"), "positions")


def tfidf(index: Index, query: str, stems: bool = False, require_all: bool = True, phrase: bool = True) -> DataFrame:
    """(url, tfidf, matched, is_phrase) of the pages that a query finds.

    With several terms, all must be on a page unless `require_all` is off. A page where each two
    neighbouring terms stand side by side somewhere gets the phrase boost.
    """
    terms = text.query_terms(query)
    n = len(set(terms))
    found = matches(index, terms, stems)
    places = F.map_from_entries(F.collect_list(F.struct("i", "positions")))
    pages = found.groupBy("url").agg(F.sum("score").alias("tfidf"), F.countDistinct("original").alias("matched"), places.alias("at"))
    if not terms or (len(terms) == 1 and terms[0] in STOP_WORDS):
        pages = pages.limit(0)
    if n > 1 and require_all:
        pages = pages.where(F.col("matched") == n)
    beside = F.lit(len(terms) > 1)
    for i in range(len(terms) - 1):
        a, b = F.element_at("at", F.lit(i)), F.element_at("at", F.lit(i + 1))
        beside = beside & F.coalesce(F.arrays_overlap(F.transform(a, lambda p: p + 1), b), F.lit(False))
    pages = pages.withColumn("is_phrase", beside)
    boost = F.when(F.col("is_phrase") & F.lit(phrase), PHRASE).otherwise(1.0)
    return pages.select("url", (F.col("tfidf") * boost).alias("tfidf"), "matched", "is_phrase")


def coverage_boost(matched: Column, n_terms: int) -> Column:
    """4 for all terms of several, less for fewer, 1 for a query of one term."""
    if n_terms < 2:
        return F.lit(1.0)
    return F.when(matched >= n_terms, ALL_TERMS).when(matched > 0, 0.3 + 0.7 * matched / n_terms).otherwise(NO_TERM)


def title_boost(title: Column, terms: Sequence[str]) -> Column:
    """1 to 4, by how many terms a title holds, how early, and in which order."""
    words = text.words(F.coalesce(title, F.lit("")))
    places = [F.array_position(words, t) for t in terms]
    if not places:
        return F.lit(1.0)
    if len(places) == 1:
        p = places[0]
        return F.when(p == 1, 3.5).when(p.between(2, 3), 2.5).when(p > 3, 2.0).otherwise(1.0)
    held = sum((F.when(p > 0, 1).otherwise(0) for p in places), F.lit(0))
    ordered, early = F.lit(True), F.lit(True)
    for p, q in zip(places, places[1:]):
        ordered = ordered & (p < q)
    for p in places:
        early = early & (p <= 4)
    everything = F.when(ordered & early, 4.0).when(ordered, 3.0).when(early, 2.5).otherwise(2.0)
    return F.when(held == len(places), everything).when(held > 0, 1.0 + 0.2 * held).otherwise(1.0)


def search(index: Index, query: str, ranks: DataFrame | None = None, pages: DataFrame | None = None, stems: bool = False, coverage: bool = True, titles: bool = True, require_all: bool = True) -> DataFrame:
    """(url, total_score, tfidf_score, page_rank_score, title, preview) of all results, unordered.

    Ranks (id, rank) and pages (url, html) may be missing: a page without a rank has 0, and
    previews are made only for results.
    """
    terms = text.query_terms(query)
    found = tfidf(index, query, stems, require_all).join(index.doc_stats.select("url", "title"), "url", "left")
    if ranks is not None:
        found = found.join(ranks.select(F.col("id").alias("url"), "rank"), "url", "left")
    else:
        found = found.withColumn("rank", F.lit(0.0))
    rank = F.coalesce("rank", F.lit(0.0))
    total = F.col("tfidf") * (1 + rank)
    if coverage:
        total = total * coverage_boost(F.col("matched"), len(set(terms)))
    if titles:
        total = total * title_boost(F.col("title"), terms)
    if pages is not None:
        found = found.join(pages.select("url", text.snippet(F.col("html"), terms).alias("preview")), "url", "left")
    else:
        found = found.withColumn("preview", F.lit(""))
    return found.select("url", total.alias("total_score"), F.col("tfidf").alias("tfidf_score"), rank.alias("page_rank_score"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("preview", F.lit("")).alias("preview"))


def result_page(results: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """A page of results by falling score, then url; pages are numbered from 1, odd sizes are 15."""
    size = size if 1 <= size <= MAX_PAGE_SIZE else PAGE_SIZE
    return results.orderBy(F.desc("total_score"), "url").offset((max(page, 1) - 1) * size).limit(size)


class CachedSearch:
    """Pages of results of the queries used last, kept on the driver."""

    def __init__(self, index: Index, ranks: DataFrame | None = None, pages: DataFrame | None = None, keep: int = 1000):
        self._run = lru_cache(keep)(lambda query, page, size: tuple(result_page(search(index, query, ranks, pages), page, size).collect()))

    def __call__(self, query: str, page: int = 1, size: int = PAGE_SIZE) -> list:
        return list(self._run(" ".join(query.lower().split()), page, size))

    def cache_info(self):
        return self._run.cache_info()


def suggest(vocabulary: DataFrame, prefix: str, limit: int = 10, least: int = 3) -> DataFrame:
    """Completions of the last word of a prefix in byte order, with the words before it. Short prefixes have none."""
    words = prefix.lower().split()
    if len(prefix.strip()) < least or not words:
        return vocabulary.select(F.col("term").alias("suggestion")).limit(0)
    before = "".join(w + " " for w in words[:-1])
    found = vocabulary.where(F.startswith("term", F.lit(words[-1]))).orderBy("term").limit(limit)
    return found.select(F.concat(F.lit(before), "term").alias("suggestion"))


def spellcheck(vocabulary: DataFrame, query: str, most: int = 2) -> DataFrame:
    """(i, word, correction): the nearest known word within `most` edits, the first in byte order; null if the word is known or none is near."""
    spark = vocabulary.sparkSession
    words = query.lower().split()
    asked = spark.createDataFrame(list(enumerate(words)), "i int, word string")
    # the words of one query against all terms: a column each, no join of rows
    def near(w: str) -> Column:
        """The distance, -1 beyond `most`, worked out only for terms of about the same length."""
        return F.when(F.length("term").between(len(w) - most, len(w) + most), F.levenshtein(F.col("term"), F.lit(w), most)).otherwise(-1)

    best = [F.min(F.when(F.col(f"d{i}") >= 0, F.struct(F.col(f"d{i}").alias("d"), "term"))).alias(f"b{i}") for i in range(len(words))]
    if not best:
        return asked.withColumn("correction", F.lit(None).cast("string"))
    lengths = [F.length("term").between(len(w) - most, len(w) + most) for w in words]
    close = vocabulary.where(reduce(or_, lengths))
    found = close.select("term", *[near(w).alias(f"d{i}") for i, w in enumerate(words)]).agg(*best).select(F.posexplode(F.array(*[F.col(f"b{i}") for i in range(len(words))])).alias("i", "b"))
    corrected = found.select("i", F.when(F.col("b.d") > 0, F.col("b.term")).alias("correction"))
    return asked.join(F.broadcast(corrected), "i", "left").select("i", "word", "correction")


def spellcheck_query(vocabulary: DataFrame, query: str) -> DataFrame:
    """(correction): a query with its words corrected; no row if nothing changes."""
    checked = spellcheck(vocabulary, query)
    words = F.array_sort(F.collect_list(F.struct("i", F.coalesce("correction", "word").alias("w"))))
    joined = checked.agg(F.array_join(F.transform(words, lambda x: x["w"]), " ").alias("correction"), F.count("correction").alias("n"))
    return joined.where("n > 0").select("correction")


def cached_page(pages: DataFrame, url: str) -> DataFrame:
    """(url, html) of one page; no row if it isn't stored."""
    return pages.where(F.col("url") == url).select("url", "html")
