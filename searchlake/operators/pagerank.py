"""Link graph and iterative rank.

The rule is 0.15 plus 0.85 times the sum of rank over number of links of the pages that link to a
page. Ranks aren't normalised; what flows to pages that aren't nodes, or from pages without links, is lost.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchlake.functions import url as urls
from searchlake.operators.index import documents
from searchlake.operators.crawl import CheckpointPolicy
from searchlake.operators.skew import heavy_key_hashes, salted_join
from searchlake.session import discard, materialize, path_exists, spread, write_lines

DAMPING = 0.85

#: Links of a graph that one task takes at most (about 300 MB of arrays), and its iterations until
#: the driver looks again. Of larger graphs: iterations of a job, and rows that they may shuffle together.
ONE_TASK, ONE_JOB, MOST_AHEAD, ROWS_AHEAD = 5_000_000, 1000, 10, 50_000_000


def link_edges(pages: DataFrame, longest: int | None = None) -> DataFrame:
    """Distinct (src, dst) of the links of pages, resolved. Only links that no expression takes go through Python."""
    docs = spread(documents(pages, longest))
    links = docs.select(urls.canonical_url(F.col("url")).alias("src"), F.explode(urls.extract_hrefs(F.col("html"))).alias("href")).where("src IS NOT NULL").distinct()
    # written once, because the links with and without a simple form are read apart
    links = materialize(links.withColumn("dst", urls.simple_link(F.col("src"), F.col("href"))), "links")
    rest = links.where("dst IS NULL").withColumn("dst", urls.resolve_column("src", "href"))
    return links.where("dst IS NOT NULL").unionByName(rest.where("dst IS NOT NULL")).select("src", "dst").distinct()


def graph(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) ready to iterate: distinct edges with the share of each link, and nodes of rank 1.

    All links count in a page's number of links, but only those to nodes carry rank. Nodes are
    all ends of edges where none are given.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    if nodes is None:
        nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    nodes = nodes.select("id").where("id IS NOT NULL").distinct()
    degree = edges.groupBy("src").agg((F.lit(DAMPING) / F.count(F.lit(1))).alias("share"))
    # a page that very many link to is spread over salts
    heavy = heavy_key_hashes(edges.select("dst"), ["dst"], 0.005)
    known = salted_join(edges, nodes.select(F.col("id").alias("dst")), ["dst"], ["src"], heavy, how="left_semi").join(degree, "src")
    return known.select("src", "dst", "share"), nodes.withColumns({"rank": F.lit(1.0), "prev": F.lit(1.0)})


def step(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One iteration; sums are combined before the shuffle, so that a much-linked page is no burden."""
    sent = edges.join(nodes.select(F.col("id").alias("src"), "rank"), "src").select("dst", (F.col("share") * F.col("rank")).alias("c"))
    sums = sent.groupBy(F.col("dst").alias("id")).agg(F.sum("c").alias("c"))
    return nodes.join(sums, "id", "left").select("id", (F.coalesce("c", F.lit(0.0)) + F.lit(1 - DAMPING)).alias("rank"), F.col("rank").alias("prev"))


def iterate(edges: DataFrame, nodes: DataFrame, iterations: int, checkpoint_every: int = 5) -> DataFrame:
    """Nodes after a number of iterations; the lineage is cut in the shared folder every few."""
    for k in range(1, iterations + 1):
        nodes = step(edges, nodes)
        if k % checkpoint_every == 0 and k < iterations:
            nodes = materialize(nodes, "ranks")
    return nodes


def convergence(nodes: DataFrame, threshold: float = 0.001) -> DataFrame:
    """(max_diff, converged, total) of the last iteration in one pass."""
    diff: Column = F.abs(F.col("rank") - F.col("prev"))
    return nodes.agg(F.max(diff).alias("max_diff"), F.count_if(diff <= threshold).alias("converged"), F.count(F.lit(1)).alias("total"))


@dataclass
class Ranking:
    ranks: DataFrame
    iterations: int
    max_diff: float
    percent: float


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, threshold: float = 0.001, percent: float = 100.0, max_iterations: int | None = None, resume: DataFrame | None = None, checkpoint: str | None = None, policy: CheckpointPolicy | None = None) -> Ranking:
    """Iterate until no rank changes by the threshold, or until enough percent of nodes have settled.

    A job runs several iterations: of a graph of up to ONE_TASK links as many as it takes, in one task, of
    a larger one a few over all tasks. Each iteration is judged by itself, and the ranks are those of the
    first that settles. What a job made is written to the shared folder, so that a lost executor costs
    its iterations at most, and what the job before wrote is removed. `checkpoint` names a folder in
    which ranks and a description are kept as the policy says; a run that finds one there goes on from
    it. `resume` gives (id, rank) of an earlier run instead. Ranks that haven't settled after
    `max_iterations` are an error.
    """
    spark = edges.sparkSession
    started, at, done, max_diff, settled = 0, None, False, None, 0
    if checkpoint is not None and resume is None and (saved := last_checkpoint(spark, checkpoint)) is not None:
        resume, started = saved[0], saved[1]["iteration"]
    policy = policy or CheckpointPolicy()
    links, names = numbered(edges, nodes)
    size = links.count()
    small, ahead = size <= ONE_TASK, max(1, min(MOST_AHEAD, ROWS_AHEAD // max(1, size)))
    if not small:
        links = by_source(with_own(links, names))
    state = names.select("n", F.lit(1.0).alias("rank"))
    if resume is not None:
        old = names.join(resume.select("id", F.col("rank").alias("old")), "id", "left")
        state = old.select("n", F.coalesce("old", F.lit(1.0)).alias("rank"))
    try:
        k, before = started, None
        while not done:
            left = ONE_JOB if small else ahead
            if max_iterations is not None:
                left = min(left, max_iterations - (k - started))
            if left <= 0:
                raise RuntimeError(f"ranks haven't settled after {max_iterations} iterations: the largest change is {max_diff}")
            if checkpoint is not None:  # a job ends with the iteration that is to be kept
                left = next((j for j in range(1, left) if policy.due(k + j, time.monotonic())), left)
            made = materialize(in_one_task(links, state, left, threshold, percent) if small else several(links, state, left), "ranks")
            if before is not None:
                discard(before)
            before = made
            state, j, max_diff, settled, total = judged_in_task(made) if small else judged(made, left, threshold, percent)
            k, done = k + j, has_settled(max_diff, settled, total, threshold, percent)
            if checkpoint is not None and (done or policy.due(k, time.monotonic())):
                at = time.monotonic()
                save_checkpoint(state.join(names, "n"), checkpoint, {"iteration": k, "max_diff": max_diff or 0.0, "settled": settled, "total": total, "done": done})
                policy.wrote(time.monotonic(), time.monotonic() - at)
    finally:
        if not small:
            links.unpersist()
    share = 100.0 * settled / total if total else 100.0
    return Ranking(state.join(names, "n").select("id", "rank"), k - started, max_diff or 0.0, share)


def has_settled(max_diff: float | None, settled: int, total: int, threshold: float, percent: float) -> bool:
    return not total or max_diff < threshold or 100.0 * settled / total >= percent


def numbered(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, names): the graph by the rules of graph(), as (a, b, share) and (id, n) with numbers n for ids."""
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    # a page that very many link to is spread over salts; rows that repeat count here too, which does no harm
    heavy = heavy_key_hashes(edges, ["dst"], 0.005)
    edges = edges.distinct()
    if nodes is None:
        nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    names = materialize(nodes.select("id").where("id IS NOT NULL").distinct().select("id", F.monotonically_increasing_id().alias("n")), "names")
    shared = edges.withColumn("share", F.lit(DAMPING) / F.count(F.lit(1)).over(Window.partitionBy("src")))
    sent = shared.join(names.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").select("a", "dst", "share")
    both = salted_join(sent, names.select(F.col("id").alias("dst"), F.col("n").alias("b")), ["dst"], ["a"], heavy)
    return materialize(both.select("a", "b", "share"), "links"), names


def in_one_task(links: DataFrame, state: DataFrame, iterations: int, threshold: float, percent: float) -> DataFrame:
    """(n, rank, j, max_diff, settled) after iteration j, the first that settles or else the last of some."""

    def run(batches):
        import numpy as np

        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if not held:
            return
        a, b, value = (np.concatenate(c) for c in zip(*held))
        held.clear()
        own = b < 0
        order = np.argsort(a[own])
        n, rank = a[own][order], value[own][order]
        a, b, share = np.searchsorted(n, a[~own]), np.searchsorted(n, b[~own]), value[~own]
        for j in range(1, iterations + 1):
            prev, rank = rank, np.bincount(b, share * rank[a], len(n)) + (1 - DAMPING)
            diff = np.abs(rank - prev)
            max_diff, settled = float(diff.max()), int((diff <= threshold).sum())
            if has_settled(max_diff, settled, len(n), threshold, percent):
                break
        for i in range(0, len(n), 100_000):
            m = len(n[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n[i : i + m], rank[i : i + m], np.full(m, j), np.full(m, max_diff), np.full(m, settled))], ["n", "rank", "j", "max_diff", "settled"])

    rows = links.select("a", "b", "share").unionByName(state.select(F.col("n").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("rank").alias("share")))
    return rows.coalesce(1).mapInArrow(run, "n long, rank double, j long, max_diff double, settled long")


def judged_in_task(made: DataFrame) -> tuple[DataFrame, int, float | None, int, int]:
    """(state, iterations, largest change, settled, total) of in_one_task(), written."""
    found = made.agg(F.max("j").alias("j"), F.max("max_diff").alias("max_diff"), F.max("settled").alias("settled"), F.count(F.lit(1)).alias("total")).first()
    return made.select("n", "rank"), found["j"] or 1, found["max_diff"], found["settled"] or 0, found["total"]


def judged(made: DataFrame, iterations: int, threshold: float, percent: float) -> tuple[DataFrame, int, float | None, int, int]:
    """The same of several(), written: of the first iteration that settles or else the last."""
    found = made.agg(*[c for i in range(iterations) for c in changes(i, threshold)], F.count(F.lit(1)).alias("total")).first()
    each = [(found[f"max_diff{i}"], found[f"settled{i}"]) for i in reversed(range(iterations))]
    j = next((j for j, x in enumerate(each, 1) if has_settled(*x, found["total"], threshold, percent)), iterations)
    return made.select("n", F.col(f"r{iterations - j}").alias("rank")), j, *each[j - 1], found["total"]


def with_own(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links, and of each node one of no share to itself, on which its earlier ranks are sent."""
    own = names.select(F.col("n").alias("a"), F.col("n").alias("b"), F.lit(0.0).alias("share"), F.lit(True).alias("own"))
    return links.withColumn("own", F.lit(False)).unionByName(own)


def several(links: DataFrame, state: DataFrame, iterations: int) -> DataFrame:
    """(n, r0, r1, ...): the ranks after each of some iterations, the last one first, down to those that a state has.

    A node's earlier ranks come to it in the one shuffle of an iteration, so that a plan has each iteration
    once, however many they are. All iterations have the same columns, so that they share their compiled code.
    """
    ranks = [f"r{i}" for i in range(iterations + 1)]
    state = state.select("n", F.col("rank").alias("r0"), *[F.lit(None).cast("double").alias(r) for r in ranks[1:]])
    for _ in range(iterations):
        # hint: a broadcast would need a job of its own
        pairs = links.join(state.hint("merge"), links["a"] == state["n"])
        sent = pairs.select(F.col("b").alias("n"), (F.col("share") * F.col("r0")).alias("c"), *[F.when(F.col("own"), F.col(r)).alias(r) for r in ranks[:-1]])
        state = sent.groupBy("n").agg((F.sum("c") + F.lit(1 - DAMPING)).alias("r0"), *[F.max(r).alias(later) for r, later in zip(ranks, ranks[1:])])
    return state


def changes(i: int, threshold: float) -> tuple[Column, Column]:
    """Of the iteration of several() that gave the ranks r{i}: the largest change, and how many ranks have settled."""
    diff = F.abs(F.col(f"r{i}") - F.col(f"r{i + 1}"))
    return F.max(diff).alias(f"max_diff{i}"), F.count_if(diff <= threshold).alias(f"settled{i}")


def by_source(links: DataFrame) -> DataFrame:
    """Links laid out and sorted by source once, on the executors' disks, so that no iteration shuffles or sorts them. What an executor lost is read again from the files that they came from."""
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return links.repartition(n, "a").sortWithinPartitions("a").persist(StorageLevel.DISK_ONLY)


def save_checkpoint(state: DataFrame, path: str, about: dict) -> None:
    """Ranks of an iteration, and last the row that describes them."""
    state.select("id", "rank").write.mode("overwrite").parquet(f"{path}/iteration={about['iteration']}/ranks")
    write_lines(state.sparkSession, f"{path}/iteration={about['iteration']}/about", [json.dumps(about)])


def last_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, dict] | None:
    """(ranks, description) of the last whole checkpoint in a folder, or null."""
    files, at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.exists(at):
        return None
    numbers = sorted((int(x.getPath().getName().partition("=")[2]) for x in files.listStatus(at) if x.getPath().getName().startswith("iteration=")), reverse=True)
    for k in numbers:
        if path_exists(spark, f"{path}/iteration={k}/about/_SUCCESS"):
            return spark.read.parquet(f"{path}/iteration={k}/ranks"), json.loads(spark.read.text(f"{path}/iteration={k}/about").first()[0])
    return None
