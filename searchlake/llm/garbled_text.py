"""Problem 10: text that was decoded with the wrong character encoding.

Adjacent character pairs of the whole corpus are counted; a pair's score is its share of the
corpus mutual information, p(ab) * log2(p(ab) / (p(a) p(b))). Usual pairs have large shares, and pairs
that wrong decoding makes have next to none, even where their two characters always come together.
Maximum-scoring segments of the improbability of a text's pairs are the runs that are tested:
inside them, and only there, each piece of characters beyond ASCII is taken back to bytes by an
encoding and decoded by another; a mapping counts when it makes the pairs more probable.

Pairs of garbled texts are common themselves where much is garbled. The counts are therefore
cleared once of all texts in which a first round finds mistakes, and a second round decides.

The table of pairs has at most ALPHABET ** 2 entries, as all characters that no tested encoding has
are one class; only it goes to the driver.

Nulls: rows with a null id or text take no part. Empty and ASCII texts are no cases. Replacement
characters and C1 controls are cases that may not be repairable. Repeated rows come out as often
as they are in the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.session import spread, table

#: Encodings that texts are commonly written in or taken for (fixed values).
SINGLE_BYTE = ("cp1252", "latin-1", "cp1250", "cp1251", "iso8859-2", "koi8-r", "cp437", "cp850", "cp866", "mac-roman")
CYRILLIC = {"cp1251", "koi8-r", "cp866"}
#: A pair with at least this share of the corpus information is a usual one; in the first round, more must be tested.
COMMON_SHARE, FIRST_ROUND_SHARE = 3e-4, 5e-3
#: Fewer characters are more probable for their number alone; each one less must gain this much.
CHARACTER_COST = 1.0
OTHER, DIGIT, FIRST = 0, 1, 2
BEYOND = regex.compile(r"[^\x00-\x7f]+")
LOST = regex.compile(r"[\x80-\x84\x86-\x9f�]")


@lru_cache(None)
def byte_table(name: str) -> str:
    """The 256 characters of an encoding; bytes without one stand for the control of that number."""
    return "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))


@lru_cache(None)
def alphabet() -> np.ndarray:
    """The class of each code point: ASCII and the characters of the encodings one by one, digits and the rest together."""
    classes = np.zeros(0x110000, dtype=np.int64)
    chars = sorted({c for name in SINGLE_BYTE for c in byte_table(name)} | {"�"})
    for i, c in enumerate(chars):
        classes[ord(c)] = FIRST + i
    classes[ord("0") : ord("9") + 1] = DIGIT
    return classes


ALPHABET = int(alphabet().max()) + 1


def pair_codes(text: str) -> np.ndarray:
    """A number for each adjacent pair of a text, with a space before and after it."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = alphabet()[points]
    return c[:-1] * ALPHABET + c[1:]


def _pair_rows(texts: Iterator[list[str]]) -> pa.RecordBatch:
    total = np.zeros(ALPHABET * ALPHABET, dtype=np.int64)
    for some in texts:
        total += np.bincount(pair_codes(" ".join(some)), minlength=len(total))
    at = np.nonzero(total)[0]
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def _in_parts(batches: Iterator[pa.RecordBatch], column: int = 0, rows: int = 500) -> Iterator[list[str]]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield [t for t in batch.column(column).slice(k, rows).to_pylist() if t]


def count_pairs(texts: DataFrame) -> dict[int, int]:
    """How often each pair occurs in all texts. A task sends at most one row a pair that it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _pair_rows(_in_parts(batches))

    counted = spread(texts).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r[0]: r[1] for r in counted.collect()}  # at most ALPHABET ** 2 rows


def count_garbled_pairs(texts: DataFrame, counts: dict[int, int]) -> dict[int, int]:
    """count_pairs() of the texts in which the model of `counts` finds mistakes."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(PairModel(shared.value, FIRST_ROUND_SHARE))
        yield _pair_rows([t for t in some if repairer.repair(t)] for some in _in_parts(batches))

    counted = spread(texts).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r[0]: r[1] for r in counted.collect()}


class PairModel:
    """Shares of mutual information and log probabilities of all pairs."""

    def __init__(self, counts: dict[int, int], common: float = COMMON_SHARE):
        n = np.zeros((ALPHABET, ALPHABET))
        if counts:
            n.reshape(-1)[np.fromiter(counts, np.int64)] = np.maximum(np.fromiter(counts.values(), np.int64), 0)
        total = max(n.sum(), 1.0)
        first, second = n.sum(1, keepdims=True), n.sum(0, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.nan_to_num(n / total * np.log2(n * total / (first * second)))
        self.total = total
        # improbability of a pair: how far its share of the information is below a common pair's
        self.score = np.clip(np.log2(common * max(share.sum(), 1e-9)) - np.log2(np.maximum(share, 1e-12)), -6, 6).astype(np.float32).reshape(-1)
        self.logp = np.log((n + 0.02) / (first + 0.02 * ALPHABET)).astype(np.float32).reshape(-1)

    def likelihoods(self, texts: list[str], before: str, after: str) -> list[float]:
        """The log probability of each text between two characters; texts of one length are worked out at once."""
        out = [0.0] * len(texts)
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            by_length.setdefault(len(t), []).append(i)
        for length, at in by_length.items():
            row = length + len(before) + len(after)
            points = alphabet()[np.frombuffer("".join(before + texts[i] + after for i in at).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].reshape(len(at), row)
            others = (points[:, 1:-1] == OTHER).sum(1)  # one of some ten thousand characters each
            for i, x in zip(at, (self.logp[points[:, :-1] * ALPHABET + points[:, 1:]].sum(1) - 9.0 * others).tolist()):
                out[i] = x
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximum-scoring segments of a sequence, by the linear-time method of Ruzzo and Tompa."""
    if not (scores > 0).any():
        return []
    # neighbours of one sign are one element
    edges = np.nonzero(np.diff(scores > 0))[0] + 1
    starts = np.concatenate([[0], edges])
    sums = np.add.reduceat(scores, starts)
    ends = np.concatenate([edges, [len(scores)]])
    found: list[list[float]] = []  # begin, end, sum before, sum up to its end
    so_far, settled = 0.0, 0  # segments before `settled` can't grow any more
    for s, e, x in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        if x <= 0:
            so_far += x
            continue
        new = [s, e, so_far, so_far + x]
        so_far += x
        while True:
            j = len(found) - 1
            while j >= settled and found[j][2] >= new[2]:
                j -= 1
            if j < settled:
                settled = len(found)
            if j < settled or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(f[0]), int(f[1])) for f in found]


@lru_cache(None)
def to_bytes(name: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(byte_table(name))))}


@lru_cache(None)
def translation(wrong: str, right: str) -> dict[int, str]:
    """The characters that differ between two single-byte encodings, as str.translate takes them; others of the wrong one stay."""
    return {ord(c): byte_table(right)[b] for c, b in to_bytes(wrong).items()}


@lru_cache(None)
def encodings_of(char: str) -> frozenset[str]:
    """The encodings that have a character."""
    return frozenset(n for n in SINGLE_BYTE if char in to_bytes(n))


MAPPINGS = [(w, "utf-8") for w in SINGLE_BYTE] + [(w, r) for w in SINGLE_BYTE for r in SINGLE_BYTE if w != r]


def undo(piece: str, wrong: str, right: str) -> str | None:
    """A piece decoded again; null where it can't have been made by that mistake."""
    codes = to_bytes(wrong)
    if any(c not in codes for c in piece):
        return None
    if right == "utf-8":
        try:
            return bytes(codes[c] for c in piece).decode("utf-8")
        except UnicodeDecodeError:
            return None
    new = piece.translate(translation(wrong, right))
    return None if LOST.search(new) and not LOST.search(piece) else new


class Repairer:
    """Finds and repairs the garbled runs of texts."""

    def __init__(self, model: PairModel, least_gain: float = 5.0, least_utf8_gain: float = 1.5, keep: int = 200_000):
        self.model, self.keep = model, keep
        self.least = [least_utf8_gain if right == "utf-8" else least_gain for _, right in MAPPINGS]
        self.gains: dict[tuple[str, str, str], tuple[list[int], dict[int, tuple[float, str]]]] = {}

    def tried(self, piece: str, before: str, after: str) -> tuple[list[int], dict[int, tuple[float, str]]]:
        """The mappings that gain on a piece, and (gain, new text) of each that can be undone on it."""
        key = (piece, before, after)
        if (found := self.gains.get(key)) is None:
            undone: dict[int, tuple[float, str]] = {}
            gaining: list[tuple[int, str]] = []
            possible = frozenset.intersection(*[encodings_of(c) for c in set(piece)])
            for k, (wrong, right) in enumerate(MAPPINGS):
                if wrong not in possible:
                    continue
                new = undo(piece, wrong, right)
                if new is None or new == piece:
                    continue
                if right == "utf-8":
                    # garbled twice: what lies between is as improbable as the text itself
                    while (again := undo(new, wrong, right)) not in (None, new):
                        new = again
                elif not piece.strip("\xa0\xad"):
                    continue  # a space or a hyphen is no letter of another encoding
                if right in CYRILLIC and (len(piece) < 3 or not regex.search(r"\p{Cyrillic}{3}", new)):
                    undone[k] = 0.0, new  # a letter or two among others may be anything: no evidence
                    continue
                gaining.append((k, new))
            if gaining:
                texts = list(dict.fromkeys([piece, *(new for _, new in gaining)]))
                seen = dict(zip(texts, self.model.likelihoods(texts, before, after)))
                for k, new in gaining:
                    undone[k] = seen[new] - seen[piece] - (len(piece) - len(new)) * CHARACTER_COST, new
            found = [k for k, (gain, _) in undone.items() if gain > 0], undone
            if len(self.gains) >= self.keep:
                self.gains.clear()
            self.gains[key] = found
        return found

    def once(self, text: str) -> tuple[str, int, set[str], bool]:
        """The text after one round, the number of places set right, their mistakes, and if any place is lost."""
        score = self.model.score[pair_codes(text)]
        # a piece is tested if a pair of it is improbable; usual texts have none
        beyond = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) > 127
        odd = score > 0
        if not (beyond & (odd[:-1] | odd[1:])).any():
            return text, 0, set(), bool(LOST.search(text))
        pieces = [(m.start(), m.end()) for m in BEYOND.finditer(text)]
        # what a mapping gains on all pieces bounds what it gains on those inside of runs: most texts end here
        bound: dict[int, float] = {}
        for b, e in pieces:
            gaining, undone = self.tried(text[b:e], text[b - 1 : b] or " ", text[e : e + 1] or " ")
            for k in gaining:
                bound[k] = bound.get(k, 0.0) + undone[k][0]
        if not any(gain >= self.least[k] for k, gain in bound.items()):
            return text, 0, set(), bool(LOST.search(text))
        done: dict[tuple[int, int], str] = {}
        mistakes: set[str] = set()
        runs: list[list[tuple[tuple[int, int], dict[int, tuple[float, str]]]]] = []
        useful: set[int] = set()  # a mapping that gains nowhere can't be the mistake
        at = 0
        for lo, hi in segments(score):
            # pair i is the one before character i
            while at < len(pieces) and pieces[at][1] < lo:
                at += 1
            inside = []
            while at < len(pieces) and pieces[at][0] < hi:
                b, e = pieces[at]
                gaining, undone = self.tried(text[b:e], text[b - 1 : b] or " ", text[e : e + 1] or " ")
                useful.update(gaining)
                inside.append(((b, e), undone))
                at += 1
            if inside:
                runs.append(inside)
        sums = [{k: sum(undone[k][0] for _, undone in inside if k in undone) for k in useful} for inside in runs] if useful else []
        whole = {k: sum(s[k] for s in sums) for k in useful}
        for inside, gained in zip(runs, sums):
            best = max(gained, key=lambda k: gained[k] + 0.2 * max(0.0, whole[k]))
            least = self.least[best]
            if gained[best] >= least or (gained[best] >= 0 and whole[best] >= 2 * least):
                for span, undone in inside:
                    if best in undone:
                        done[span] = undone[best][1]
                mistakes.add(f"{MAPPINGS[best][1]} as {MAPPINGS[best][0]}")
        out, last = [], 0
        for (b, e), new in sorted(done.items()):
            out += [text[last:b], new]
            last = e
        new_text = "".join([*out, text[last:]])
        return new_text, len(done), mistakes, bool(LOST.search(new_text))

    def repair(self, text: str) -> tuple[str, int, str, bool] | None:
        """(text set right, places, mistakes, lost) of a garbled text, else null.

        Text that was garbled several times takes as many rounds; they end when nothing changes any
        more, or when a text comes that was there before.
        """
        if text.isascii():
            return None
        places, all_mistakes, lost, seen = 0, [], False, {text}
        while True:
            text, n, mistakes, lost = self.once(text)
            places += n
            all_mistakes += sorted(mistakes)
            if not n or text in seen:
                break
            seen.add(text)
        return (text, places, ", ".join(dict.fromkeys(all_mistakes)), lost) if places or lost else None


def repaired_texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, repaired, places, mistakes, lost) of each garbled text of a corpus."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull())
    beyond = rows.select(F.col(id_col), F.col(text).alias("__text")).where(F.col("__text").rlike(r"[^\x00-\x7f]"))
    counts = count_pairs(rows.select(F.col(text).alias("__text")))
    for pair, n in count_garbled_pairs(beyond.select("__text"), counts).items():
        counts[pair] = counts.get(pair, 0) - n
    shared = df.sparkSession.sparkContext.broadcast(counts)
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(PairModel(shared.value))
        for batch in batches:
            found = [(i, r) for i, t in zip(batch.column(0), batch.column(1).to_pylist()) if t and (r := repairer.repair(t))]
            columns = [pa.array([i.as_py() for i, _ in found], batch.schema.field(0).type)] + [pa.array([r[k] for _, r in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "repaired", "places", "mistakes", "lost"])

    return spread(beyond).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, repaired string, places long, mistakes string, lost boolean")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least one place that was decoded wrongly."""
    return repaired_texts(table(spark, folder, "documents"), "doc_id", "text").select("doc_id").distinct()


def p10_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Those documents with their text set right as far as possible."""
    return repaired_texts(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p10_found": p10_found, "p10_repaired": p10_repaired}
SQL: dict[str, str] = {}
