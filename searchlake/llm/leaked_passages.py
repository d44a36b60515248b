"""Problem 9: test material inside training documents.

Seeds: every run of `run` words of a passage holds several n-grams; the rarest one in the corpus is
its seed. A document with that run has its seed, so no case is lost however common a passage is,
and a run with an n-gram that no document has needs no seed at all. Pairs of document and item that
share a seed are aligned by Smith-Waterman; the longest run of equal words in the aligned part
decides exact leaks. Edits break n-grams, the rarest ones as well as others, so where edited copies
are wanted every n-gram of a passage is a seed: a copy takes part as long as n words in a row are
left anywhere in it, and passages from n words on do.

A word is a run of letters or digits of any script; case and all between words are ignored.
Nulls: rows with a null id or text take no part. Texts and passages shorter than a run have no
exact leak. Repeated rows and copies under new ids each come out. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from searchlake.session import materialize, spread, table

WORD = r"[\p{L}\p{Nd}]+"
#: Rows up to which a side is broadcast: a row has at most about 100 bytes.
SMALL_ROWS = 500_000
#: Alignments that are worked out together, and cells of a row of them.
GROUP, GROUP_CELLS = 128, 1 << 17


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def gram_hashes(words: Column, n: int) -> Column:
    """The hash of each run of n words, in order; empty for fewer words.

    The words are bound by an outer lambda: else each run would make them anew.
    """

    def runs(w: Column) -> Column:
        last = F.size(w) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(F.array(words), runs))


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint for a frame that was counted to be small; beyond that the join is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def smith_waterman_many(texts: list[np.ndarray], passages: list[np.ndarray], match: int = 2, mismatch: int = -1, gap: int = 1) -> list[tuple[int, int, int]]:
    """smith_waterman() of each text with the passage beside it, word by word through all texts at once.

    Shorter ones are filled up with words that equal none; those only lower scores.
    """
    words = np.full((max(map(len, texts)), len(texts), 1), -1, dtype=np.int32)
    passage = np.full((len(texts), max(map(len, passages))), -2, dtype=np.int32)
    for k, (w, p) in enumerate(zip(texts, passages)):
        words[: len(w), k, 0], passage[k, : len(p)] = w, p
    steps = gap * np.arange(passage.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(texts), passage.shape[1] + 1), dtype=np.int32)
    runs = np.zeros_like(row)
    best, end, longest = np.zeros((3, len(texts)), dtype=np.int32)
    for i, w in enumerate(words):
        equal = passage == w
        here = np.zeros_like(row)
        here[:, 1:] = np.maximum(row[:, :-1] + np.where(equal, np.int32(match), np.int32(mismatch)), row[:, 1:] - gap)
        np.maximum(here, 0, out=here)
        # a gap in the text: the best of all cells to the left, less their distance
        row = np.maximum.accumulate(here + steps, axis=1) - steps
        runs[:, 1:] = np.where(equal, runs[:, :-1] + 1, 0)
        top = row.max(axis=1)
        end[top > best] = i + 1
        np.maximum(best, top, out=best)
        np.maximum(longest, runs.max(axis=1), out=longest)
    return list(zip(best.tolist(), end.tolist(), longest.tolist()))


def smith_waterman(text: np.ndarray, passage: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = 1) -> tuple[int, int, int]:
    """(score, end in text, longest run of equal words) of the best local alignment of two word sequences."""
    return smith_waterman_many([text], [passage], match, mismatch, gap)[0]


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parts, scores = [], {}
        for k, (words, passage, at) in enumerate(zip(batch["words"], batch["passage"], batch["at"])):
            ids = {w: i for i, w in enumerate(dict.fromkeys(passage))}
            p = np.array([ids[w] for w in passage], dtype=np.int32)
            reach, spans = 2 * len(p), []
            for a in sorted(at):
                if spans and a - reach <= spans[-1][1]:
                    spans[-1][1] = a + reach
                else:
                    spans.append([a - reach, a + reach])
            for lo, hi in spans:
                part = np.array([ids.get(w, -1) for w in words[max(0, lo) : hi]], dtype=np.int32)
                parts.append((k, max(0, lo), part, p))
        # parts of about one length go together; long passages in smaller groups
        parts.sort(key=lambda x: (len(x[2]), len(x[3])))
        begin = 0
        while begin < len(parts):
            size, widest = 0, 0
            while begin + size < len(parts) and size < GROUP and (size + 1) * (widest := max(widest, len(parts[begin + size][3]))) <= GROUP_CELLS or not size:
                size += 1
            group = parts[begin : begin + size]
            for (k, lo, *_), (score, end, run) in zip(group, smith_waterman_many([x[2] for x in group], [x[3] for x in group])):
                scores.setdefault(k, []).append((score, run, lo + end))
            begin += size
        out = []
        for k, (doc, item, passage) in enumerate(zip(batch["doc_id"], batch["item_id"], batch["passage"])):
            score, _, end = max(scores[k])
            out.append((doc, item, score, max(f[1] for f in scores[k]), score / (2 * len(passage)), end))
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "longest_run", "share", "end_word"])


def aligned_leaks(docs: DataFrame, items: DataFrame, run: int = 12, n: int = 5, edited: bool = False) -> DataFrame:
    """(doc_id, item_id, score, longest_run, share, end_word) of each pair that shares a seed.

    `docs` has doc_id and text, `items` item_id and passage. `share` is the score over the best
    possible one. With `edited`, each n-gram of a passage is a seed, and not only those that runs need.
    """
    docs = spread(docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL"))
    passages = items.select("item_id", word_list(F.col("passage")).alias("passage")).where(F.col("item_id").isNotNull() & (F.size("passage") >= (n if edited else run))).distinct()
    grams = passages.select("item_id", F.size("passage").alias("len"), F.posexplode(gram_hashes(F.col("passage"), n)).alias("q", "gram"))
    wanted = small(grams.select("gram").distinct())
    each = docs.select("doc_id", F.posexplode(gram_hashes(word_list(F.col("text")), n)).alias("p", "gram"))
    hits = materialize(each.join(wanted, "gram", "left_semi"), "hits")
    if edited:
        seeds = small(grams.select("item_id", "gram").distinct())
    else:
        # the rarest n-gram of each run; one that no document has shows that the run is in none
        rarity = hits.groupBy("gram").agg(F.countDistinct("doc_id").alias("n_docs"))
        counted = grams.join(rarity, "gram", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
        ahead = W.partitionBy("item_id").orderBy("q").rowsBetween(0, run - n)
        rarest = counted.withColumn("r", F.min(F.struct("n_docs", "gram")).over(ahead)).where(F.col("q") <= F.col("len") - run)
        seeds = small(rarest.where("r.n_docs > 0").select("item_id", "r.gram").distinct())
    pairs = hits.join(seeds, "gram").groupBy("doc_id", "item_id").agg(F.collect_set("p").alias("at"))
    pairs = small(materialize(pairs, "pairs"), SMALL_ROWS // 5)
    whole = docs.join(pairs, "doc_id").select("doc_id", "item_id", word_list(F.col("text")).alias("words"), "at")
    whole = whole.join(small(passages), "item_id").select("doc_id", "item_id", "words", "passage", "at")
    kinds = {c: t for c, t in whole.dtypes}
    return whole.mapInPandas(_align, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, score long, longest_run long, share double, end_word long")


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "documents"), table(spark, folder, "eval_items")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least 12 consecutive words of an item's passage."""
    return aligned_leaks(*_tables(spark, folder)).where("longest_run >= 12").select("doc_id", "item_id").distinct()


def p9_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of document and item with five words in a row in common, with its score: edited copies included."""
    return aligned_leaks(*_tables(spark, folder), edited=True).select("doc_id", "item_id", "score", "longest_run", F.round("share", 6).alias("share"))


QUERIES = {"p9_found": p9_found, "p9_alignments": p9_alignments}

SQL = {
    "p9_found": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower(passage), '{WORD}') AS w FROM eval_items WHERE passage IS NOT NULL),
        dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
        ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
