"""Positional inverted index with weighted TF-IDF.

postings(term, url, tf, weighted_tf, normalized_tf, doc_len, positions, weights, is_stop),
terms(term, df, idf), doc_stats(url, length, max_tf, title).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.functions import text
from searchlake.functions import url as urls
from searchlake.functions.porter import stem_vocabulary
from searchlake.operators.skew import heavy_key_hashes, salted_join, salted_top
from searchlake.session import materialize, path_exists, spread

#: Limits that an index can be made with (fixed values); without them, nothing is left out.
MAX_PAGE, MAX_PAGE_FOR_LINKS, MAX_TITLE = 1_000_000, 750_000, 200
TOP_DOCS, TOP_DOCS_OF_STOP_WORD = 20_000, 5_000


@dataclass
class Index:
    postings: DataFrame
    terms: DataFrame
    doc_stats: DataFrame


def documents(pages: DataFrame, longest: int | None = None) -> DataFrame:
    """(url, html) of pages that have both, and aren't longer than a limit where one is given."""
    fits = F.lit(True) if longest is None else F.length("html") <= longest
    return pages.where(F.col("url").isNotNull() & F.col("html").isNotNull() & fits).select("url", "html")


def left_out(pages: DataFrame, longest: int) -> DataFrame:
    """(n_pages, n_chars): what a limit on the length of pages leaves out."""
    over = pages.where(F.col("url").isNotNull() & (F.length("html") > longest))
    return over.agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum(F.length("html")), F.lit(0)).cast("long").alias("n_chars"))


def not_yet_indexed(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """The documents without a row in the stats of an index: what is left after a stop."""
    return docs.join(stats.select("url").distinct(), "url", "left_anti")


def longest_run(values: Column) -> Column:
    """How often the most frequent element of an array comes, by one pass over it sorted."""
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x == acc["last"], acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.array_sort(values), zero, step, lambda acc: acc["best"])


def with_stats(docs: DataFrame, longest_title: int | None = None) -> DataFrame:
    """Documents with length, max_tf and title; each row by itself, without a shuffle."""
    found = docs.withColumn("__tokens", text.tokens(F.col("html")))
    return found.select("url", "html", F.size("__tokens").alias("length"), F.greatest(longest_run(F.col("__tokens")), F.lit(1)).alias("max_tf"), text.page_title(F.col("html"), longest_title).alias("title"))


def doc_stats(docs: DataFrame, longest_title: int | None = None) -> DataFrame:
    return with_stats(docs, longest_title).drop("html")


def one_per_url(stats: DataFrame) -> DataFrame:
    """Doc stats with one row a url: of several the one of the greatest length, then max_tf, then title."""
    best = stats.groupBy("url").agg(F.max(F.struct("length", "max_tf", "title")).alias("s"))
    return best.select("url", "s.length", "s.max_tf", "s.title")


def corpus_size(stats: DataFrame) -> int:
    return stats.select(F.col("url")).distinct().count()


def token_positions(docs: DataFrame) -> DataFrame:
    """(url, token, position, weight) of tokens worth indexing, with the other columns of the documents."""
    others = [c for c in docs.columns if c != "html"]
    each = docs.select(*others, F.posexplode(text.weighted_tokens(F.col("html"))).alias("at", "t"))
    found = each.select(*others, F.col("t.token").alias("token"), (F.col("at") + 1).alias("position"), F.col("t.weight").alias("weight"))
    return found.where(text.is_worth_indexing(F.col("token")))


def _postings_of(places: DataFrame) -> DataFrame:
    """Postings of (term, url, length, max_tf, position, weight)."""
    grouped = places.groupBy("term", "url", F.col("length").alias("doc_len"), "max_tf").agg(F.array_sort(F.collect_set(F.struct("position", "weight"))).alias("p"))
    weighted = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["weight"])
    rows = grouped.withColumn("weighted_tf", F.round(weighted, 9))
    normalized = F.when((F.col("weighted_tf") > 0) & (F.col("max_tf") > 0), 0.4 + 0.6 * F.col("weighted_tf") / F.col("max_tf")).otherwise(0.0)
    return rows.select(
        "term", "url", F.size("p").alias("tf"), "weighted_tf", normalized.alias("normalized_tf"), "doc_len",
        F.col("p.position").alias("positions"), F.col("p.weight").alias("weights"), text.is_stop_word(F.col("term")).alias("is_stop"),
    )


def postings(docs: DataFrame, stems: bool = False) -> DataFrame:
    """Postings of documents. With stems, words that aren't stop words also stand under their stem."""
    places = token_positions(with_stats(spread(docs))).withColumnRenamed("token", "term")
    if stems:
        known = stem_vocabulary(places).where("stem <> term")
        heavy = heavy_key_hashes(places.select("term"), ["term"], 0.01)
        stemmed = salted_join(places.where(~text.is_stop_word(F.col("term"))), known, ["term"], ["url", "position"], heavy)
        places = places.unionByName(stemmed.drop("term").withColumnRenamed("stem", "term"))
    return _postings_of(places)


def top_postings(found: DataFrame, cap: int | None = TOP_DOCS, stop_cap: int | None = TOP_DOCS_OF_STOP_WORD) -> DataFrame:
    """The documents of the highest weight of each term, fewer for stop words; equal ones by url. Without limits, all of them."""
    if cap is None and stop_cap is None:
        return found
    cap, stop_cap = (F.lit(2**62 if c is None else c) for c in (cap, stop_cap))
    order = [F.desc("weighted_tf"), F.col("url")]
    heavy = heavy_key_hashes(found.select("term"), ["term"], 0.005)
    return salted_top(found, ["term"], order, F.when(F.col("is_stop"), stop_cap).otherwise(cap), ["url"], heavy)


def idf_terms(found: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf): the natural logarithm of n_docs over df."""
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.withColumn("idf", F.log(F.lit(float(n_docs)) / F.col("df")))


def build_index(pages: DataFrame, stems: bool = False, cap: int | None = None, stop_cap: int | None = None, longest: int | None = None, longest_title: int | None = None) -> Index:
    """The index of pages. df and idf are those of all postings, also where a limit keeps only the first ones of a term."""
    docs = documents(pages, longest)
    stats = materialize(one_per_url(doc_stats(docs, longest_title)), "stats")
    found = materialize(postings(docs, stems), "postings")
    return Index(top_postings(found, cap, stop_cap), idf_terms(found, stats.count()), stats)


def merge_indexes(old: Index, new: Index, cap: int | None = None, stop_cap: int | None = None) -> Index:
    """Both indexes as one; where both have a posting or a page, the old one stands. Lists that were cut before are cut lists here too."""
    # the postings are read several times from here on, so they are written once
    both = old.postings.unionByName(new.postings.join(old.postings.select("term", "url"), ["term", "url"], "left_anti"))
    stats = materialize(old.doc_stats.unionByName(not_yet_indexed(new.doc_stats, old.doc_stats)), "stats")
    found = materialize(both, "postings")
    return Index(top_postings(found, cap, stop_cap), idf_terms(found, stats.count()), stats)


def export_cells(index: Index) -> DataFrame:
    """(term, _value): the text form of the index, postings by falling normalized tf, then url. A limit on lists is top_postings()."""
    parts = [
        F.col("url"), F.concat(F.lit("tf="), F.col("tf")), F.concat(F.lit("weightedTf="), text.fixed(F.col("weighted_tf"), 4)), F.concat(F.lit("normalizedTf="), text.fixed(F.col("normalized_tf"), 6)),
        F.concat(F.lit("docLen="), F.col("doc_len")), F.concat(F.lit("pos="), F.array_join("positions", " ")),
        F.concat(F.lit("weights="), F.array_join(F.transform("weights", lambda w: text.fixed(w, 3)), " ")), F.when(F.col("is_stop"), F.lit("stop=true")),
    ]
    lines = index.postings.select("term", F.struct((-F.col("normalized_tf")).alias("o"), "url", F.concat_ws("|", *parts).alias("t")).alias("p"))
    lists = lines.groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), ",").alias("list"))
    return lists.join(index.terms, "term").select("term", F.concat_ws("\t", text.fixed(F.col("idf"), 8), F.col("df").cast("string"), "list").alias("_value"))


def vocabulary(terms: DataFrame) -> DataFrame:
    """The terms of up to 20 letters."""
    return terms.select("term").where(F.col("term").rlike("^[a-z]{1,20}$")).distinct()


def write_index(index: Index, path: str, buckets: int = 100) -> None:
    """Store an index; postings and terms lie in folders by a hash of the term, so that a query reads few of them.

    Buckets that are there already are replaced only as a whole: a write that was stopped can be done again.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    for name, df in (("postings", index.postings), ("terms", index.terms)):
        df.withColumn("bucket", bucket).repartition("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    index.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")


def build_in_buckets(spark: SparkSession, pages: DataFrame, path: str, url_buckets: int = 8, buckets: int = 100, stop_after: int | None = None, stems: bool = False) -> list[int]:
    """Index pages bucket by bucket of their urls into a stored index; gives the buckets done by this call.

    A bucket's postings and doc stats are whole when its mark is there; buckets with a mark are passed
    over, so that a build that was stopped goes on where it was. Terms are made last, of all buckets.
    """
    done = []
    term_bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    for b in range(url_buckets):
        if path_exists(spark, f"{path}/doc_stats/part={b}/_SUCCESS"):
            continue
        if stop_after is not None and len(done) >= stop_after:
            return done
        docs = documents(pages.where(urls.bucket_of(F.col("url"), url_buckets) == b))
        postings(docs, stems).withColumn("bucket", term_bucket).repartition("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/part={b}")
        one_per_url(doc_stats(docs)).write.mode("overwrite").parquet(f"{path}/doc_stats/part={b}")  # its mark comes last
        done.append(b)
    n_docs = spark.read.parquet(f"{path}/doc_stats").count()
    found = spark.read.parquet(f"{path}/postings").select("term", "bucket")
    terms = idf_terms(found, n_docs).withColumn("bucket", term_bucket)
    terms.repartition(min(buckets, 32), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    return done


def read_index(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = 100) -> Index:
    """A stored index, or the part of it that holds some terms; only their folders are read."""

    def read(name: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        if terms is not None:
            df = df.where(F.col("bucket").isin(numbers) & F.col("term").isin(terms))
        return df.drop("bucket", "part")

    if terms is not None:
        asked = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct()
        numbers = [r[0] for r in asked.collect()]
    return Index(read("postings"), read("terms"), spark.read.parquet(f"{path}/doc_stats").drop("part"))
