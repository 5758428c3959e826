"""Benchmark decontamination: a BM25 index of the test items, searched with block-max WAND."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

K1, B = 1.2, 0.75
#: Postings in a block, whose largest weight is kept.
BLOCK = 32
#: Words of a text that are bounded at once, which bounds the memory that a long text takes.
BLOCK_WORDS = 2048
#: Score at which an item is retrieved, as part of the score that the item itself would get.
THRESHOLD = 0.6
#: Words in a shingle; parts of an item's shingles that a passage must hold: of both halves, and of all.
SHINGLE, MIN_PART, MIN_ALL = 5, 0.5, 0.8
#: Characters of test items that one index may hold; it is what each executor gets.
INDEX_CHARS = 16_000_000

_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.?!\n]\s*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def halves(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the first sentence or line, and the rest; the same twice if there is no rest."""
    m = _END.search(text)
    first, rest = (words(text[: m.end()]), words(text[m.end() :])) if m else (words(text), [])
    return first or rest, rest or first


def shingles(found: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    k = min(k, len(found))
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if k else set()


class Index:
    """Inverted lists of test items with normalised BM25 weights and block maxima.

    A weight is divided by its item's own score, so that 1 is a passage with
    all of the item's words and one threshold serves items of every length.
    """

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], n: int, mean: float):
        self.items = [(i, text) for i, text in items if words(text)]
        self.parts = [tuple(shingles(h) for h in halves(text)) for _, text in self.items]
        self.lengths = [len(words(text)) for _, text in self.items]
        self.longest = max(self.lengths, default=1)
        lists: dict[str, list[tuple[int, float]]] = {}
        need = np.zeros(len(self.items))
        essential: list[tuple[str, int, float]] = []
        for k, (_, text) in enumerate(self.items):
            counts = Counter(words(text))
            size = K1 * (1 - B + B * self.lengths[k] / mean)
            weights = {t: math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * (K1 + 1) / (c + size) for t, c in counts.items()}
            own = sum(weights.values())
            rest = 0.0
            for t, w in sorted(weights.items(), key=lambda x: (x[1], x[0])):
                lists.setdefault(t, []).append((k, w / own))
                # The lightest words, which together stay below half the threshold, can't make a hit.
                if rest + w / own < THRESHOLD / 2:
                    rest += w / own
                else:
                    essential.append((t, k, w / own))
            need[k] = THRESHOLD - rest - 1e-9
        self.need = need
        self.ids = {t: i for i, t in enumerate(lists)}
        self.lists = []
        for postings in lists.values():
            at, w = [p[0] for p in postings], [p[1] for p in postings]
            cuts = range(0, len(at), BLOCK)
            self.lists.append((at, w, max(w), [at[min(c + BLOCK, len(at)) - 1] for c in cuts], [max(w[c : c + BLOCK]) for c in cuts]))
        essential.sort(key=lambda x: self.ids[x[0]])
        term = np.array([self.ids[x[0]] for x in essential], np.int64)
        # The last row stands for words outside the index.
        self.begin = np.searchsorted(term, np.arange(len(lists) + 2))
        self.essential_item, self.essential_weight = np.array([x[1] for x in essential], np.int64), np.array([x[2] for x in essential])

    def search(self, terms: set[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Every item that scores at least ``threshold``: block-max WAND without a cut at k."""
        least = threshold - 1e-9
        cursors = [[self.lists[t][0][0], 0, self.lists[t]] for t in sorted(terms)]
        found = []

        def move(c: list, to: int) -> None:
            c[1] = bisect_left(c[2][0], to, c[1])
            c[0] = c[2][0][c[1]] if c[1] < len(c[2][0]) else math.inf

        while True:
            cursors = sorted((c for c in cursors if c[0] < math.inf), key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[2][2]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            bound, edge = 0.0, math.inf
            for c in cursors[: pivot + 1]:
                block = bisect_left(c[2][3], at)
                if block < len(c[2][3]):
                    bound += c[2][4][block]
                    edge = min(edge, c[2][3][block])
            if bound < least:
                # No item up to the nearest block's end, or the next list's item, can reach the threshold.
                to = edge + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    if c[0] < to:
                        move(c, to)
            elif cursors[0][0] == at:
                score = sum(c[2][1][c[1]] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((at, score))
                for c in cursors[: pivot + 1]:
                    move(c, at + 1)
            else:
                for c in cursors[: pivot + 1]:
                    if c[0] < at:
                        move(c, at)

    def likely(self, ids: np.ndarray) -> Iterator[int]:
        """Numbers of the passages whose rare words may reach the threshold for some item.

        Passage k has the words from ``k * longest`` on, twice the longest item, so
        that each place of an item lies in one. They are bounded block by block, so memory doesn't grow with the text.
        """
        none, width, step = len(self.lists), len(self.items), max(1, BLOCK_WORDS // self.longest)
        last = max(1, -(-ids.size // self.longest) - 1)
        for at in range(0, last, step):
            some = ids[at * self.longest : (at + step + 1) * self.longest]
            count = np.where(some == none, 0, self.begin[some + 1] - self.begin[some])
            spots = np.flatnonzero(count)
            if not spots.size:
                continue
            n = count[spots]
            posting = np.repeat(self.begin[some[spots]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, weight, chunk = self.essential_item[posting], self.essential_weight[posting], np.repeat(spots, n) // self.longest
            # A passage is two neighbouring chunks. Words that repeat count again: a bound, never too low.
            key = np.concatenate([chunk * width + item, (chunk - 1) * width + item])
            keys, back = np.unique(key, return_inverse=True)
            bound = np.bincount(back, np.concatenate([weight, weight]))
            hit = np.unique(keys[bound >= self.need[keys % width]] // width)
            yield from (at + hit[(hit >= 0) & (hit < min(step, last - at))]).tolist()

    def matches(self, text: str) -> dict[int, tuple[float, float, float, int]]:
        """Of a document: ``{item: (score, question overlap, answer overlap, word offset)}``, verified."""
        found = words(text)
        get, none = self.ids.get, len(self.lists)
        ids = np.fromiter((get(w, none) for w in found), np.int64, len(found))
        best: dict[int, tuple[float, float, float, int]] = {}
        for k in self.likely(ids):
            a = k * self.longest
            passage = found[a : a + 2 * self.longest]
            held = None
            for at, score in self.search({int(t) for t in ids[a : a + 2 * self.longest] if t != none}):
                held = held or {}
                overlaps = []
                for part in self.parts[at]:
                    size = len(next(iter(part)))
                    if size not in held:
                        held[size] = shingles(passage, size)
                    overlaps.append((len(part & held[size]), len(part)))
                q, r = (x / y for x, y in overlaps)
                both = sum(x for x, _ in overlaps) / sum(y for _, y in overlaps)
                if min(q, r) >= MIN_PART and both >= MIN_ALL and (at not in best or score > best[at][0]):
                    best[at] = (score, q, r, a)
        return best


def indexes(benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> Iterator[Index]:
    """Indexes that together hold all test items, each of at most about ``index_chars`` characters.

    Word counts, item counts and lengths are taken over all items, so scores do
    not depend on how many indexes there are.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(chars / index_chars))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).alias("shard")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = Counter(words(text))
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(counts), pa.int64()), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["shard", "term", "n"])

    terms = items.select(shard.cast("long"), "text").mapInArrow(split, "shard long, term string, n long")
    frequency = terms.groupBy("term").agg(F.count("*").alias("df"))

    def length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(words(t)) for t in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    n, total = items.select("text").mapInArrow(length, "n long").where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not n:
        return
    for s in range(shards):
        own = [(r.item_id, r.text) for r in items.where(shard == s).collect()]
        df = {r.term: r.df for r in terms.where(F.col("shard") == s).select("term").distinct().join(frequency, "term").collect()}
        index = Index(own, df, n, total / n)
        if index.items:
            yield index


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word_offset long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap, word_offset)`` for each test item found in a document.

    Every passage of every document queries the index of test items; items
    that score ``THRESHOLD`` of their own score are retrieved, all of them, and
    kept if the passage holds at least ``MIN_PART`` of the question's and of the
    answer's word shingles and ``MIN_ALL`` of both. A passage whose rare words
    cannot reach the threshold for any item is passed over, which is the bound
    that WAND uses, taken for all passages of a document at once.

    An index has a bound on its size and goes to every executor; more test
    items make more indexes, each of which reads the documents once.

    Null and empty texts hold nothing; null doc_ids and item_ids stay null;
    repeated documents or items each get rows; empty tables give no rows;
    further columns are ignored.
    """
    spark = docs.sparkSession
    out = None
    for index in indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                rows = [(doc_id, index.items[k][0], *hit) for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, hit in sorted(index.matches(text or "").items())]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "word_offset"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a test item; columns, whatever their names, and other rows stay.

    Null and empty texts hold nothing and stay; ids play no part; repeated rows
    stay or go together; an empty table of either sort changes nothing.
    """
    for index in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not sent.value.matches(t or "") for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items of ``benchmark`` found in ``documents``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
