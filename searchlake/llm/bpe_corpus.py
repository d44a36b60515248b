"""Problem 8: token ids of a whole corpus by a public byte-level BPE vocabulary.

Within a batch every distinct word is encoded once. All words lie in one linked sequence of
symbols; an index maps each adjacent pair to its positions, and a heap holds the ranks of the
pairs that occur. The lowest rank is applied to all its positions at once, left to right, and the
index gets the pairs that this makes. Words never share a pair, so applying ranks to all words
together gives each word the ids that it would get alone.

Null and empty texts have the empty list of ids. Strings of special tokens in a text are ordinary
text. Ids don't depend on partitions. Repeated ids of rows come out as often as they are in the table.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.session import spread, table

TOKENIZERS = "/opt/tokenizers"

#: The public pattern that cuts text into words before byte-level BPE (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the code points from 256 on, in order.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairIndexEncoder:
    """Encodes texts by a vocabulary and its merges, in order of rank."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], keep: int = 500_000):
        self.bytes = [vocabulary[c] for c in byte_letters()]
        self.pairs = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        self.cut = regex.compile(WORDS).findall
        self.known: dict[str, list[int]] = {}
        self.keep = keep

    def learn(self, words: Iterable[str]) -> None:
        """Encode words together and remember their ids."""
        words = [w for w in words if w not in self.known]
        symbols: list[int] = []
        ends: list[int] = []
        for w in words:
            symbols += [self.bytes[b] for b in w.encode("utf-8", "surrogatepass")]
            ends.append(len(symbols))
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        begin = 0
        for end in ends:
            before[begin], after[end - 1] = -1, -1
            begin = end
        index: dict[tuple[int, int], list[int]] = {}
        pairs = self.pairs
        for i, j in enumerate(after):
            if j >= 0 and (p := (symbols[i], symbols[j])) in pairs:
                index.setdefault(p, []).append(i)
        active = [(pairs[p][0], p) for p in index]
        heapq.heapify(active)
        while active:
            _, pair = heapq.heappop(active)
            at = index.pop(pair, None)
            if at is None:
                continue
            a, b = pair
            made = pairs[pair][1]
            at.sort()
            for i in at:
                j = after[i]
                if j < 0 or symbols[i] != a or symbols[j] != b:
                    continue  # an earlier merge took one of the two
                symbols[i], symbols[j] = made, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    self._enter(index, active, (made, symbols[k]), i)
                if (h := before[i]) >= 0:
                    self._enter(index, active, (symbols[h], made), h)
        begin = 0
        if len(self.known) > self.keep:
            self.known.clear()
        for w, end in zip(words, ends):
            self.known[w] = [s for s in symbols[begin:end] if s >= 0]
            begin = end

    def _enter(self, index: dict, active: list, pair: tuple[int, int], at: int) -> None:
        if pair in self.pairs:
            if pair in index:
                index[pair].append(at)
            else:
                index[pair] = [at]
                heapq.heappush(active, (self.pairs[pair][0], pair))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
        self.learn({w: None for words in cut for w in words})
        known = self.known
        return [[i for w in words for i in known[w]] for words in cut]


def read_vocabulary(path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges of a tokenizer file in JSON."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return model["vocab"], merges


def encode_corpus(df: DataFrame, id_col: str, text: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(id_col, ids): one row a row of the corpus. The vocabulary, of fixed size, is broadcast from the driver."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return spread(df.select(F.col(id_col), F.col(text).alias("__text"))).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of each document."""
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
