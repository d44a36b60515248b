"""Problem 3: one ranking from several scores on unlike scales.

Each score is replaced by its place within its group, so that scale and distribution no longer
matter. The correlation matrix of the places comes from one distributed aggregate; its first
principal component, with signs turned so that better places count for an item, gives the
projection by which items are sorted.

Places are found without sorting a group in one task: equal scores are first counted into one
row, and groups with more distinct scores than `hot_rows` are cut into ranges, in which places
are counted apart and shifted by the sizes of the ranges before.

Nulls: a null or NaN score stands behind all others, and nulls share that place. Rows with a
null group or id take no part. Ties share a place. Repeated rows count as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchlake.operators.skew import heavy_key_hashes, heavy_share, salted_join
from searchlake.session import materialize, table

SCORES = ("total_score", "tfidf_score", "page_rank_score")
RANGES = 256


def _with_ranges(values: DataFrame, hot_rows: int) -> DataFrame:
    """Values with `cut`, the number of range bounds above them; 0 outside hot groups.

    Groups are hot from max(hot_rows, a thousandth of all rows, less on a large cluster) on, so that
    their number is bounded by the cluster. Their bounds, RANGES each, come to the driver, which makes
    them the same for all tasks.
    """
    sizes = values.groupBy("grp", "dim").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total <= hot_rows:
        return values.withColumn("cut", F.lit(0))
    hot = sizes.where(F.col("n") > max(hot_rows, int(total * heavy_share(values.sparkSession, 0.001)))).select("grp", "dim")
    steps = [i / RANGES for i in range(1, RANGES)]
    bounds = values.join(F.broadcast(hot), ["grp", "dim"]).groupBy("grp", "dim").agg(F.percentile_approx("score", steps, 20000).alias("bounds"))
    fixed = values.sparkSession.createDataFrame(bounds.collect(), bounds.schema)
    above = F.size(F.filter("bounds", lambda b: b > F.col("score")))
    return values.join(F.broadcast(fixed), ["grp", "dim"], "left").withColumn("cut", F.when(F.col("bounds").isNull(), 0).otherwise(above)).drop("bounds")


def places(df: DataFrame, group: str, item: str, scores: Sequence[str] = SCORES, hot_rows: int = 2_000_000) -> DataFrame:
    """(grp, item, place_<score>...): one more than the number of rows of the group with a higher score."""
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    rows = rows.select(F.col(group).alias("grp"), F.col(item).alias("item"), *[(F.nanvl(F.col(s).cast("double"), F.lit(None)) + 0.0).alias(s) for s in scores])
    pairs = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(s).alias("score")) for i, s in enumerate(scores)])
    long = rows.select("grp", "item", F.explode(pairs).alias("p")).select("grp", "item", "p.dim", "p.score")
    values = long.groupBy("grp", "dim", "score").agg(F.count(F.lit(1)).alias("n"))
    known = values.where("score IS NOT NULL")
    known = _with_ranges(known, hot_rows)
    before = W.partitionBy("grp", "dim").orderBy("cut").rowsBetween(W.unboundedPreceding, -1)
    sizes = known.groupBy("grp", "dim", "cut").agg(F.sum("n").alias("m")).withColumn("shift", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    above = W.partitionBy("grp", "dim", "cut").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    placed = known.withColumn("within", F.coalesce(F.sum("n").over(above), F.lit(0))).join(sizes, ["grp", "dim", "cut"])
    placed = placed.select("grp", "dim", "score", (F.lit(1) + F.col("within") + F.col("shift")).alias("place"))
    # nulls stand behind all known scores
    last = values.groupBy("grp", "dim").agg((F.sum(F.when(F.col("score").isNotNull(), F.col("n")).otherwise(0)) + 1).alias("place"))
    placed = placed.unionByName(last.select("grp", "dim", F.lit(None).cast("double").alias("score"), "place"))
    # a score that many rows share is a heavy key of the join; the null one needs a name
    name = F.coalesce(F.col("score").cast("string"), F.lit("null")).alias("key")
    long, placed = long.select("grp", "item", "dim", name), placed.select("grp", "dim", "place", name)
    keys = ["grp", "dim", "key"]
    found = salted_join(long, placed, keys, ["item"], heavy_key_hashes(long, keys, 0.01))
    return found.groupBy("grp", "item").agg(*[F.max(F.when(F.col("dim") == i, F.col("place"))).alias(f"place_{s}") for i, s in enumerate(scores)])


def first_component(placed: DataFrame, columns: Sequence[str]) -> list[float]:
    """Weights of the places: loadings of the first principal component over each column's deviation.

    Signs are turned towards the declared direction, a lower place being better for every score.
    A column without spread, or an empty table, gets equal weights.
    """
    k = range(len(columns))
    x = [F.col(c).cast("double") for c in columns]
    row = placed.agg(F.count(F.lit(1)), *[F.avg(c) for c in x], *[F.covar_pop(x[i], x[j]) for i in k for j in k if i <= j]).first()
    n, values = row[0], list(row[1 + len(columns) :])
    if not n:
        return [1.0 for _ in k]
    cov = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip([(i, j) for i in k for j in k if i <= j], values):
        cov[i, j] = cov[j, i] = v or 0.0
    sd = np.sqrt(np.diag(cov))
    if not (sd > 0).all():
        return [1.0 for _ in k]
    _, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    loading = vectors[:, -1]
    loading = loading if loading.sum() >= 0 else -loading
    return [float(v) for v in loading / sd]


def rank_by_component(df: DataFrame, group: str, item: str, scores: Sequence[str] = SCORES, hot_rows: int = 2_000_000) -> DataFrame:
    """(grp, item, place columns, projection, w_min, w_max): sort by projection, the lowest is the best."""
    placed = materialize(places(df, group, item, scores, hot_rows), "places")
    columns = [f"place_{s}" for s in scores]
    weights = first_component(placed, columns)
    projection = sum((F.lit(w) * F.col(c) for w, c in zip(weights, columns)), F.lit(0.0))
    return placed.withColumns({"projection": projection, "w_min": F.lit(min(weights)), "w_max": F.lit(max(weights))})


def p3_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Every result with its projection; the weights are the same for all rows."""
    ranked = rank_by_component(table(spark, folder, "search_results"), "query_id", "result_id")
    return ranked.select(F.col("grp").alias("query_id"), F.col("item").alias("result_id"), F.round("projection", 6).alias("projection"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each query's first result by the sum of places.

    The projection bounds the sum from both sides: with weights between w_min and w_max it is
    between w_min and w_max times the sum. The row with the smallest sum therefore has a
    projection of at most w_max / w_min times the smallest one, and only those rows are compared
    exactly. If a weight isn't positive, all rows are.
    """
    ranked = rank_by_component(table(spark, folder, "search_results"), "query_id", "result_id")
    total = sum((F.col(f"place_{s}") for s in SCORES), F.lit(0))
    best = ranked.groupBy("grp").agg(F.min("projection").alias("best"))
    near = salted_join(ranked, best, ["grp"], ["item"], heavy_key_hashes(ranked, ["grp"], 0.01)).where((F.col("w_min") <= 0) | (F.col("projection") * F.col("w_min") <= F.col("best") * F.col("w_max") * (1 + 1e-9)))
    first = near.groupBy("grp").agg(F.min(F.struct(total.alias("total"), "item")).alias("f"))
    return first.select(F.col("grp").alias("query_id"), F.col("f.item").alias("result_id"))


QUERIES = {"p3_found": p3_found, "p3_ranking": p3_ranking}

_PLACES = "SELECT query_id, result_id, " + ", ".join(
    f"rank() OVER (PARTITION BY query_id ORDER BY CASE WHEN isnan({s}) THEN NULL ELSE {s} END DESC NULLS LAST) AS p{i}" for i, s in enumerate(SCORES)
) + " FROM search_results WHERE query_id IS NOT NULL AND result_id IS NOT NULL"

SQL = {
    "p3_found": f"SELECT query_id, arg_min(result_id, (p0 + p1 + p2, result_id)) AS result_id FROM ({_PLACES}) GROUP BY query_id",
}
