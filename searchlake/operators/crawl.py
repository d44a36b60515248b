"""What a crawler decides, over tables of pages, links, hosts and responses. Nothing is fetched here."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchlake.functions import url as urls
from searchlake.operators.skew import heavy_key_hashes, salted_join
from searchlake.session import materialize

#: Limits of the crawler (fixed values).
MIN_BYTES, MAX_BYTES, DEFAULT_GAP_MS = 200, 10_000_000, 500
CONTENT_TYPES = r"(?i)^\s*(text/html|text/plain|application/xhtml\+xml|application/xml|text/xml)"
ROBOTS = "array<struct<allow:boolean,prefix:string>>"


def crawl_levels(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(url, level): pages by their distance from the seeds, as a frontier is followed level by level.

    A level holds each url once and none that was seen before; each is written before the next starts.
    """
    level = seeds.select("url").where("url IS NOT NULL").distinct()
    seen = materialize(level.withColumn("level", F.lit(0)), "crawl")
    links = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    frontier = seen.select("url")
    for k in range(1, depth + 1):
        found = links.join(frontier.withColumnRenamed("url", "src"), "src").select(F.col("dst").alias("url")).distinct()
        new = materialize(unseen(found, seen).withColumn("level", F.lit(k)), "crawl")
        seen, frontier = seen.unionByName(new), new.select("url")
        if new.isEmpty():
            break
    return seen


def unseen(urls_: DataFrame, seen: DataFrame) -> DataFrame:
    """The distinct urls that weren't seen yet."""
    return urls_.select("url").where("url IS NOT NULL").distinct().join(seen.select("url"), "url", "left_anti")


def not_blacklisted(urls_: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Rows whose canonical url isn't on a list of canonical urls."""
    bad = blacklist.select(F.lower("url").alias("__bad")).distinct()
    return urls_.join(bad, F.lower(urls.canonical_url(F.col("url"))) == F.col("__bad"), "left_anti")


def parse_robots(text: str | None, agent: str = "*") -> tuple[list[tuple[bool, str]], int | None]:
    """The ordered rules for an agent, else for `*`, and its crawl delay in milliseconds.

    A group is a run of agent lines and the rules after it; a later agent line starts a new group.
    """
    groups: dict[str, tuple[list[tuple[bool, str]], list[int]]] = {}
    agents: list[str] = []
    in_rules = False
    for line in (text or "").splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if in_rules:
                agents, in_rules = [], False
            agents.append(value.lower())
            groups.setdefault(value.lower(), ([], []))
        elif name in ("allow", "disallow", "crawl-delay"):
            in_rules = True
            for a in agents:
                rules, delays = groups[a]
                if name == "crawl-delay":
                    try:
                        delays.append(int(float(value) * 1000))
                    except (ValueError, OverflowError):
                        pass
                elif name == "disallow" or value:
                    rules.append((name == "allow", value))
    rules, delays = groups.get(agent.lower()) or groups.get("*") or ([], [])
    return rules, delays[0] if delays else None


def robots_rules(hosts: DataFrame, agent: str = "*") -> DataFrame:
    """(host, rules, delay_ms): the parsed robots text of each host, repeated rows once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [parse_robots(t, agent) for t in batch["robots_text"]]
            yield pd.DataFrame({
                "host": batch["host"],
                "rules": [[{"allow": a, "prefix": p} for a, p in rules] for rules, _ in parsed],
                "delay_ms": pd.array([d for _, d in parsed], dtype="Int64"),
            })

    rows = hosts.where("host IS NOT NULL").select("host", "robots_text").distinct()
    return rows.mapInPandas(run, f"host string, rules {ROBOTS}, delay_ms long")


def robots_allow(path: Column, rules: Column) -> Column:
    """The first rule in order whose prefix a path has decides; an empty Disallow allows all; without a rule all is allowed."""
    first = F.filter(rules, lambda r: F.startswith(path, r["prefix"]) | (r["prefix"] == ""))
    rule = F.get(first, F.lit(0))
    return F.coalesce(F.when(rule["prefix"] == "", True).otherwise(rule["allow"]), F.lit(True))


def crawl_gap(delay_ms: Column) -> Column:
    """Milliseconds between two visits of a host: its delay, or the usual gap where it has none or an odd one."""
    return F.when(delay_ms >= 0, delay_ms).otherwise(F.lit(DEFAULT_GAP_MS))


def is_page_type(content_type: Column) -> Column:
    return content_type.isNull() | content_type.rlike(CONTENT_TYPES)


def is_page_size(n_bytes: Column) -> Column:
    return n_bytes.between(MIN_BYTES, MAX_BYTES)


def is_english(language: Column) -> Column:
    return language.isNull() | F.startswith(F.lower(language), F.lit("en"))


def politeness(visits: DataFrame, host: str, ts: str, gap_ms: int = DEFAULT_GAP_MS, chunk_ms: int = 3_600_000) -> DataFrame:
    """Visits with gap_ms since the same host's visit before, `too_soon`, and `ready_at_ms`, when it may go.

    Deferred visits keep the gap to the one let go before: the k-th visit of a host is ready at
    gap * k + max(ms_j - gap * j) over the first k visits j. Both are running figures, which are made
    chunk by chunk of time and then shifted by what the chunks before carry over: a busy host is
    no single task. Rows with a null host or time take no part; visits of one time go in an order of
    their own values.
    """
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    rows = visits.where(F.col(host).isNotNull() & F.col(ts).isNotNull()).withColumns({"__ms": ms, "__chunk": F.floor(ms / chunk_ms), "__tie": F.xxhash64(*visits.columns)})
    inside = W.partitionBy(host, "__chunk").orderBy("__ms", "__tie")
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"__k": F.row_number().over(inside), "__before": F.lag("__ms").over(inside)})
    rows = rows.withColumn("__most", F.max(F.col("__ms") - F.lit(gap_ms) * F.col("__k")).over(so_far))
    chunks = rows.groupBy(host, "__chunk").agg(F.max("__ms").alias("__last"), F.max("__k").alias("__n"), F.max("__most").alias("__top"))
    earlier = W.partitionBy(host).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumns({"__earlier": F.max("__last").over(earlier), "__skipped": F.coalesce(F.sum("__n").over(earlier), F.lit(0))})
    # a chunk's visits are numbered from 1 in it; all before it move its figures by gap * number
    carried = F.max(F.col("__top") - F.lit(gap_ms) * F.col("__skipped")).over(earlier)
    chunks = chunks.withColumn("__carried", carried).select(host, "__chunk", "__earlier", "__skipped", "__carried")
    rows = rows.join(chunks, [host, "__chunk"])
    gap = F.col("__ms") - F.coalesce("__before", "__earlier")
    ready = F.lit(gap_ms) * (F.col("__k") + F.col("__skipped")) + F.greatest(F.col("__most") - F.lit(gap_ms) * F.col("__skipped"), F.col("__carried"))
    rows = rows.withColumns({"gap_ms": gap, "too_soon": F.coalesce(gap < gap_ms, F.lit(False)), "ready_at_ms": ready})
    return rows.drop("__ms", "__chunk", "__tie", "__k", "__before", "__most", "__earlier", "__skipped", "__carried")


def content_dedup(pages: DataFrame, id_col: str, body: str) -> DataFrame:
    """(id, first_id): each page with the first page of the same body. Bodies are compared by SHA-256; null bodies take no part.

    The first of each body is one aggregate, and pages join it by key, those of the most frequent
    bodies in salts.
    """
    rows = pages.where(F.col(body).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(F.col(body), 256).alias("hash"))
    firsts = rows.groupBy("hash").agg(F.min("id").alias("first_id"))
    return salted_join(rows, firsts, ["hash"], ["id"], heavy_key_hashes(rows, ["hash"], 0.01)).select("id", "first_id")


def fetch_outcome(status: Column, content_type: Column, length: Column, language: Column, location: Column) -> Column:
    """What becomes of a url after its response, as one of a few names."""
    return (
        F.when(status.isNull(), "retry")
        .when(~is_english(language), "skip_language")
        .when(status.between(300, 399) & location.isNotNull(), "redirect")
        .when(status == 404, "blacklist")
        .when(status >= 500, "retry")
        .when(status != 200, "skip_status")
        .when(~is_page_type(content_type), "blacklist_type")
        .when(length > MAX_BYTES, "blacklist_size")
        .when(length < MIN_BYTES, "skip_small")
        .otherwise("store")
    )


class CheckpointPolicy:
    """When a loop writes its state: at once, then every 5 rounds times a factor, or after 15 minutes.

    The factor doubles, up to 6, when a write took over 30 s, and halves when it took under 5 s;
    three failures treble it, up to 10.
    """

    def __init__(self, every: int = 5, minutes: float = 15.0):
        self.every, self.seconds = every, minutes * 60
        self.factor, self.failures, self.last = 1, 0, 0.0

    def due(self, iteration: int, now: float) -> bool:
        return iteration == 1 or iteration % (self.every * self.factor) == 0 or now - self.last >= self.seconds

    def wrote(self, now: float, took: float) -> None:
        self.last, self.failures = now, 0
        if took > 30:
            self.factor = min(6, self.factor * 2)
        elif took < 5:
            self.factor = max(1, self.factor // 2)

    def failed(self) -> None:
        self.failures += 1
        if self.failures >= 3:
            self.factor, self.failures = min(10, self.factor * 3), 0
