"""Queries of problem 1 over pt_index: results per term where few terms hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.functions.postings import TF_PATTERN, posting_count
from searchlake.operators.skew import count_rows, max_of, min_of, salted_aggregate, sum_of
from searchlake.session import materialize, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The terms with at least one percent of the rows; rows of a null term count in the total."""
    # one row a term, which is written because the total is made of it too
    counts = materialize(salted_aggregate(table(spark, folder, "pt_index"), ["term"], [count_rows("n")], ["entry_id"]), "terms")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("term").isNotNull() & (F.col("n") * 100 >= F.lit(total))).select("term")


def p1_term_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Per term its rows, postings, occurrences over all rows, largest tf and first and last time of writing."""
    index = table(spark, folder, "pt_index").where(F.col("term").isNotNull())
    figures = F.expr(f"transform(regexp_extract_all(_value, r'{TF_PATTERN}', 1), x -> cast(x AS bigint))")
    measures = [
        count_rows("n_rows"),
        sum_of("n_commas", posting_count(F.col("_value")).cast("long")),
        sum_of("tf_total", F.coalesce(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))),
        max_of("tf_max", F.array_max("tfs")),
        min_of("first_us", F.unix_micros("indexed_at")),
        max_of("last_us", F.unix_micros("indexed_at")),
    ]
    return salted_aggregate(index.withColumn("tfs", figures), ["term"], measures, ["entry_id"])


QUERIES = {"p1_found": p1_found, "p1_term_totals": p1_term_totals}

SQL = {
    "p1_found": "SELECT term FROM pt_index WHERE term IS NOT NULL GROUP BY term HAVING count(*) * 100 >= (SELECT count(*) FROM pt_index)",
    "p1_term_totals": rf"""
        SELECT term, count(*) AS n_rows,
               sum(coalesce(length(_value) - length(replace(_value, ',', '')) + 1, 0))::bigint AS n_commas,
               sum(coalesce(list_sum(tfs), 0))::bigint AS tf_total, max(list_max(tfs)) AS tf_max,
               min(epoch_us(indexed_at)) AS first_us, max(epoch_us(indexed_at)) AS last_us
        FROM (SELECT *, list_transform(regexp_extract_all(_value, '{TF_PATTERN}', 1), lambda x: x::bigint) AS tfs
              FROM pt_index WHERE term IS NOT NULL)
        GROUP BY term""",
}
