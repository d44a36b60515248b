"""Problem 2: copies hidden by formatting differences, by progressive partition refinement.

Rows are first put into classes by cheap invariants that every rewriting keeps (number of
letters and digits, then their histogram). Each dearer key is made only for rows whose class
still has several members, so that most rows never pay for it. Scopes that hold a large share of all
rows go another way than the rest, in which no task gets them whole.

Nulls: a row with a null scope or text takes no part. Empty texts are equal to each other.
Repeated ids come out once. Extra columns are ignored, so that their names can't clash.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchlake.operators.skew import heavy_key_hashes, key_hash, salt_column
from searchlake.session import table

SALTS = 32


def kept_letters(text: Column) -> Column:
    """A text's letters a-z, in lower case, and digits. Stripped first: lower() makes a-z of other letters."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def canonical_url(url: Column) -> Column:
    """The first field, then the other fields in sorted order; equal for all spellings of a url."""
    marks = F.lower(F.regexp_replace(url, "[^A-Za-z0-9?&;]", ""))
    first = F.regexp_replace(F.substring_index(marks, "?", 1), "[&;]", "")
    rest = F.when(F.contains(marks, F.lit("?")), F.regexp_replace(marks, r"^[^?]*\?", "")).otherwise("")
    fields = F.transform(F.split(rest, "[&;]"), lambda p: F.replace(p, F.lit("?"), F.lit("")))
    return F.concat(first, F.lit("?"), F.array_join(F.array_sort(F.filter(fields, lambda p: p != "")), "&"))


def _several(df: DataFrame, keys: Sequence[str], scope: Sequence[str], heavy: Sequence[int]) -> DataFrame:
    """The rows of heavy scopes whose class by `keys` has more than one member, probed in salts."""
    classes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    classes = classes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("__salt", salt_column(scope, heavy, ["id"], SALTS)).join(classes, [*keys, "__salt"], "left_semi").drop("__salt")


def _letters(text: Column) -> Column:
    """The sorted letters are the histogram, written out; its hash keeps the key short."""
    return F.md5(F.array_join(F.array_sort(F.split(kept_letters(text), "")), ""))


def _by_scope(rows: DataFrame, canonical: Callable[[Column], Column]) -> DataFrame:
    """Refinement where no scope is heavy: rows are laid out by scope once, and each level counts its classes in place."""

    def several(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("scope", *keys))).where("__n > 1").drop("__n")

    rows = several(rows.withColumn("length", F.length(F.regexp_replace("text", "[^A-Za-z0-9]", ""))), "length")
    rows = several(rows.withColumn("letters", _letters(F.col("text"))), "length", "letters")
    rows = rows.select("id", "scope", F.sha2(canonical(F.col("text")), 256).alias("key"))
    once = rows.withColumn("__k", F.row_number().over(W.partitionBy("scope", "key", "id").orderBy("id"))).where("__k = 1")
    each = W.partitionBy("scope", "key")
    return once.select("scope", "id", F.min("id").over(each).alias("first_id"), F.count(F.lit(1)).over(each).alias("n_copies")).where("n_copies > 1")


def _by_class(rows: DataFrame, canonical: Callable[[Column], Column], heavy: Sequence[int]) -> DataFrame:
    """Refinement of heavy scopes: classes are counted before they are shuffled, and their rows found again in salts."""
    rows = _several(rows.withColumn("length", F.length(F.regexp_replace("text", "[^A-Za-z0-9]", ""))), ["scope", "length"], ["scope"], heavy)
    rows = _several(rows.withColumn("letters", _letters(F.col("text"))), ["scope", "length", "letters"], ["scope"], heavy)
    rows = rows.select("id", "scope", F.sha2(canonical(F.col("text")), 256).alias("key"))
    classes = rows.groupBy("scope", "key").agg(F.min("id").alias("first_id"), F.countDistinct("id").alias("n_copies")).where("n_copies > 1")
    copies = F.sequence(F.lit(0), F.lit(SALTS - 1))
    rows = rows.withColumn("__salt", salt_column(["scope"], heavy, ["id"], SALTS))
    return rows.join(classes.withColumn("__salt", F.explode(copies)), ["scope", "key", "__salt"]).select("scope", "id", "first_id", "n_copies").distinct()


def copy_classes(df: DataFrame, id_col: str, scope: str, text: str, canonical: Callable[[Column], Column] = canonical_url, share: float = 0.02) -> DataFrame:
    """(scope, id, first_id, n_copies) of each row that has a copy; first_id is the smallest id of its class."""
    rows = df.where(F.col(scope).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(scope).alias("scope"), F.col(text).alias("text"))
    heavy = heavy_key_hashes(rows.select("scope"), ["scope"], share)
    if not heavy:
        return _by_scope(rows, canonical)
    is_heavy = key_hash(["scope"]).isin(heavy)
    return _by_scope(rows.where(~is_heavy), canonical).unionByName(_by_class(rows.where(is_heavy), canonical, heavy))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each copy beside the first row of its class."""
    found = copy_classes(table(spark, folder, "search_results"), "result_id", "query_id", "url")
    return found.where("id > first_id").select(F.col("first_id").alias("result_id_a"), F.col("id").alias("result_id_b"))


def p2_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each page of each result list once, with the number of its rows."""
    rows = table(spark, folder, "search_results").where("query_id IS NOT NULL AND url IS NOT NULL AND result_id IS NOT NULL")
    found = copy_classes(rows, "result_id", "query_id", "url").select(F.col("id").alias("result_id"), "first_id", "n_copies")
    both = rows.select("query_id", "result_id", "url").join(found, "result_id", "left").where("first_id IS NULL OR first_id = result_id")
    return both.select("query_id", "result_id", "url", F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))


QUERIES = {"p2_found": p2_found, "p2_pages": p2_pages}

_KEYS = r"""
    WITH m AS (SELECT query_id, result_id, url, lower(regexp_replace(url, '[^A-Za-z0-9?&;]', '', 'g')) AS marks
               FROM search_results WHERE query_id IS NOT NULL AND url IS NOT NULL),
    k AS (SELECT query_id, result_id, url, regexp_replace(split_part(marks, '?', 1), '[&;]', '', 'g') AS first,
                 list_sort(list_filter(list_transform(string_split_regex(
                   CASE WHEN contains(marks, '?') THEN regexp_replace(marks, '^[^?]*\?', '') ELSE '' END, '[&;]'),
                   lambda p: replace(p, '?', '')), lambda p: p <> '')) AS fields FROM m),
    c AS (SELECT *, min(result_id) OVER w AS first_id, count(*) OVER w AS n_copies FROM k WINDOW w AS (PARTITION BY query_id, first, fields))"""

SQL = {
    "p2_found": _KEYS + " SELECT first_id AS result_id_a, result_id AS result_id_b FROM c WHERE result_id > first_id",
    "p2_pages": _KEYS + " SELECT query_id, result_id, url, n_copies FROM c WHERE result_id = first_id",
}
