"""The text form of index cells: `idf TAB docFreq TAB posting[,posting...]`.

A posting is `url|name=value|...`; its url comes first, the other parts in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The count of a posting. The bar before it keeps weightedTf and normalizedTf out.
TF_PATTERN = r"\|\s*tf\s*=\s*(\d+)"


def posting_texts(value: Column) -> Column:
    """The postings of a cell as an array of texts; null for a null or malformed cell."""
    return F.split(F.get(F.split(value, "\t", 3), F.lit(2)), ",")


def posting_count(value: Column) -> Column:
    """About how many postings a cell has: its commas and one, 0 for null."""
    return F.coalesce(F.length(value) - F.length(F.replace(value, F.lit(","), F.lit(""))) + 1, F.lit(0))


def explode_postings(df: DataFrame, term: str = "term", value: str = "_value") -> DataFrame:
    """(term, url, tf) of each posting; rows without term or cell, and postings without url or tf, are left out."""
    each = df.where(F.col(term).isNotNull() & F.col(value).isNotNull()).select(F.col(term).alias("term"), F.explode(posting_texts(F.col(value))).alias("posting"))
    return each.select(
        "term",
        F.trim(F.substring_index("posting", "|", 1)).alias("url"),
        F.expr(f"try_cast(regexp_extract(posting, r'{TF_PATTERN}', 1) AS bigint)").alias("tf"),
    ).where((F.col("url") != "") & F.col("tf").isNotNull())


def index_cells(df: DataFrame, term: str = "term", value: str = "_value") -> DataFrame:
    """One row a (term, url) with the largest tf that any row of the index has for it."""
    return explode_postings(df, term, value).groupBy("term", "url").agg(F.max("tf").alias("tf"))
