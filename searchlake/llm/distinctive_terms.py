"""Problem 4: how much a term marks a page, by residuals of correspondence analysis.

The index is a contingency table of pages and terms. A cell's expected count is the product of
its margins over the total; the residual is the observed less the expected count over the root
of the expected one, and the adjusted residual also divides by the root of its variance,
(1 - page share) * (1 - term share). All of it is arithmetic on columns.

The term with the highest tf * ln(N / df) of a page, which p4_found asks for, isn't always the one
with the highest residual, and no bound between the two holds; p4_found picks among the operator's
cells with their term margins by that formula in an exact step.

Nulls: rows without term or cell take no part. Cells that come several times count once, with
the largest tf. A table of one page or one term has residuals of 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.functions.postings import index_cells, posting_count
from searchlake.operators.skew import heavy_key_hashes, salted_join
from searchlake.session import materialize, table


def contingency(index: DataFrame, term: str = "term", value: str = "_value", share: float = 0.01) -> tuple[DataFrame, list[int]]:
    """The cells (url, term, tf) of the table of pages and terms, written once, and the heavy terms' hashes."""
    used = index.where(F.col(term).isNotNull() & F.col(value).isNotNull()).select(F.col(term).alias("term"), F.col(value).alias("_value"))
    heavy_terms = heavy_key_hashes(used, ["term"], share, posting_count(F.col("_value")))
    return materialize(index_cells(used), "cells"), heavy_terms


def with_term_margins(cells: DataFrame, heavy_terms: list[int]) -> DataFrame:
    """Cells with df and the total of their term; rows of heavy terms are spread over salts in the join."""
    terms = cells.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("double").alias("term_total"))
    return salted_join(cells, terms, ["term"], ["url"], heavy_terms)


def term_residuals(index: DataFrame, term: str = "term", value: str = "_value", share: float = 0.01) -> DataFrame:
    """(url, term, tf, df, n_pages, expected, residual, adjusted), one row a cell of the contingency table.

    Margins are small aggregates; rows of terms or pages that hold more than `share` of the postings
    are spread over salts in the joins with them.
    """
    cells, heavy_terms = contingency(index, term, value, share)
    pages = cells.groupBy("url").agg(F.sum("tf").cast("double").alias("page_total"))
    n_pages, total = pages.agg(F.count(F.lit(1)), F.sum("page_total")).first()
    heavy_pages = heavy_key_hashes(cells, ["url"], share)
    rows = salted_join(with_term_margins(cells, heavy_terms), pages, ["url"], ["term"], heavy_pages)
    expected = F.col("page_total") * F.col("term_total") / F.lit(total)
    spare = (1 - F.col("page_total") / F.lit(total)) * (1 - F.col("term_total") / F.lit(total))
    residual = (F.col("tf") - F.col("expected")) / F.sqrt("expected")
    rows = rows.withColumns({"n_pages": F.lit(n_pages), "expected": expected, "spare": spare}).withColumn("residual", residual)
    adjusted = F.when(F.col("spare") > 0, F.col("residual") / F.sqrt("spare")).otherwise(F.lit(0.0))
    return rows.select("url", "term", "tf", "df", "n_pages", "expected", "residual", adjusted.alias("adjusted"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's term with the highest tf * ln(N / df), rounded to 6 decimals, then the first in byte order.

    It takes the operator's cells and term margins; the totals of pages don't enter the formula.
    """
    cells, heavy_terms = contingency(table(spark, folder, "pt_index"))
    n_pages = cells.agg(F.countDistinct("url")).first()[0]
    rows = with_term_margins(cells, heavy_terms).where("df >= 2")
    score = F.round(F.col("tf") * F.log(F.lit(n_pages) / F.col("df")), 6)
    best = rows.groupBy("url").agg(F.min(F.struct((-score).alias("s"), "term")).alias("b"))
    return best.select("url", F.col("b.term").alias("term"))


def p4_residuals(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell with its residuals."""
    rows = term_residuals(table(spark, folder, "pt_index"))
    return rows.select("url", "term", "tf", "df", *[F.round(c, 6).alias(c) for c in ("expected", "residual", "adjusted")])


QUERIES = {"p4_found": p4_found, "p4_residuals": p4_residuals}

CELLS_SQL = r"""
    cells AS (SELECT term, url, max(tf) AS tf FROM (
        SELECT term, trim(split_part(p, '|', 1)) AS url, try_cast(nullif(regexp_extract(p, '\|\s*tf\s*=\s*(\d+)', 1), '') AS bigint) AS tf
        FROM (SELECT term, unnest(string_split(split_part(_value, chr(9), 3), ',')) AS p FROM pt_index WHERE term IS NOT NULL AND _value IS NOT NULL))
      WHERE url <> '' AND tf IS NOT NULL GROUP BY term, url)"""

_MARGINS = f"""WITH {CELLS_SQL},
    t AS (SELECT term, count(*) AS df, sum(tf) AS term_total FROM cells GROUP BY term),
    u AS (SELECT url, sum(tf) AS page_total FROM cells GROUP BY url),
    n AS (SELECT count(*) AS n_pages, sum(page_total) AS total FROM u),
    r AS (SELECT *, page_total::double * term_total::double / total AS expected,
                 (1 - page_total / total::double) * (1 - term_total / total::double) AS spare
          FROM cells JOIN t USING (term) JOIN u USING (url), n)"""

SQL = {
    "p4_found": _MARGINS + """
        SELECT url, arg_min(term, (-round(tf * ln(n_pages / df), 6), term)) AS term FROM r WHERE df >= 2 GROUP BY url""",
    "p4_residuals": _MARGINS + """
        SELECT url, term, tf, df, round(expected, 6) AS expected, round((tf - expected) / sqrt(expected), 6) AS residual,
               round(CASE WHEN spare > 0 THEN (tf - expected) / sqrt(expected) / sqrt(spare) ELSE 0 END, 6) AS adjusted FROM r""",
}
