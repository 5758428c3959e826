"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` holds a text's modular prefix sums: any two spans, of one text
or of two, are compared in constant time, and the longest common extension of
two positions is found by binary search. A document's fingerprint is a sketch
of its fixed-length spans, whose hashes all come from the same prefix array.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, table

#: Two primes below 2**31: products stay below 2**62, sums of 2**33 terms fit.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Code points in the spans that a sketch is made of, and spans kept.
SPAN, KEPT = 12, 64

_powers: dict[int, np.ndarray] = {}


def powers(prime: int, base: int, n: int) -> np.ndarray:
    """``base ** i % prime`` for i < n, grown by doubling and kept."""
    have = _powers.get(prime)
    if have is None:
        have = np.ones(1, np.uint64)
    while have.size < n:
        step = pow(base, have.size, prime)
        have = np.concatenate([have, have * np.uint64(step) % np.uint64(prime)])
    _powers[prime] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHash:
    """Prefix sums S[i] = sum of c[j] * base**j for j < i, modulo each prime."""

    def __init__(self, codes: np.ndarray, primes: tuple[int, ...] = PRIMES):
        self.codes, self.primes = codes, primes
        self.sums = []
        for prime, base in zip(primes, BASES, strict=False):
            terms = (codes.astype(np.uint64) + np.uint64(1)) * powers(prime, base, codes.size) % np.uint64(prime)
            sums = np.zeros(codes.size + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums % np.uint64(prime))

    def __len__(self) -> int:
        return self.codes.size

    def span(self, k: int, start: int, length: int) -> int:
        """The span's sum times base**-start, as a fraction of powers: (sum, start)."""
        prime = self.primes[k]
        return (int(self.sums[k][start + length]) - int(self.sums[k][start])) % prime

    def equal(self, start: int, other: PrefixHash, at: int, length: int) -> bool:
        """Whether two spans hold the same code points."""
        for k, (prime, base) in enumerate(zip(self.primes, BASES, strict=False)):
            a, b = self.span(k, start, length), other.span(k, at, length)
            if start < at:
                a = a * pow(base, at - start, prime) % prime
            else:
                b = b * pow(base, start - at, prime) % prime
            if a != b:
                return False
        return True

    def extension(self, start: int, other: PrefixHash, at: int) -> int:
        """The longest common extension of two positions, by binary search."""
        low, high = 0, min(len(self) - start, len(other) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, length: int) -> np.ndarray:
        """Hashes of all spans of ``length``, comparable between texts (first prime)."""
        n = len(self) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        prime = np.uint64(self.primes[0])
        inverse = pow(BASES[0], -1, self.primes[0])
        key = -self.primes[0]
        if key not in _powers or _powers[key].size < n:
            have = np.ones(1, np.uint64)
            while have.size < n:
                have = np.concatenate([have, have * np.uint64(pow(inverse, have.size, self.primes[0])) % prime])
            _powers[key] = have
        sums = self.sums[0]
        return (sums[length:] + prime - sums[:-length]) % prime * _powers[key][:n] % prime

    def whole(self) -> str:
        return "".join(f"{int(s[-1]):08x}" for s in self.sums)


def scrambled(hashes: np.ndarray) -> np.ndarray:
    """A fixed permutation of span hashes, so that the smallest are a random choice."""
    with np.errstate(over="ignore"):
        x = hashes * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def smallest(values: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The ``kept`` smallest distinct values, sorted."""
    while values.size > 4 * kept:
        # Copies may fill the cut, so distinct values are counted after it.
        some = np.unique(np.partition(values, 4 * kept)[: 4 * kept])
        if some.size >= kept:
            return some[:kept]
        break
    return np.unique(values)[:kept]


def sketch(codes: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Smallest scrambled span hashes; a text shorter than a span is one span."""
    if codes.size and not spans.size:
        return scrambled(np.array([int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=4).digest(), "big")], np.uint64))
    return smallest(spans)


def printed(n: int, whole: str, kept: np.ndarray) -> str:
    """Length, whole hash and sketch; the sketch keeps the upper half of each value."""
    return f"{n:x}-{whole}-" + (kept >> np.uint64(32)).astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans (Jaccard) of two fingerprints, 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s.rsplit("-", 1)[1]), ">u4") for s in (a, b))
    if not x.size or not y.size:
        return 0.0
    # Of the smallest values of the union, those that both have.
    union = np.unique(np.concatenate([x, y]))[: max(KEPT, 1)]
    common = np.intersect1d(x, y, assume_unique=False)
    return float(np.isin(union, common).sum() / union.size)


class Document:
    """A text with its prefix sums, scrambled span hashes and fingerprint."""

    def __init__(self, text: str):
        self.text = text
        self.codes = code_points(text)
        self.prefix = PrefixHash(self.codes)
        self.spans = scrambled(self.prefix.spans(SPAN))
        self.print = printed(self.codes.size, self.prefix.whole(), sketch(self.codes, self.spans))


def edited(doc: Document, following: Document) -> tuple[str, str]:
    """``(sha256, fingerprint)`` of the text whose last half is replaced.

    The last floor(n/2) code points make way for the first as many (or all) of
    the following text. Spans inside either part keep their hashes; only those
    across the seam are hashed anew.
    """
    n = doc.codes.size
    head, tail = n - n // 2, min(n // 2, following.codes.size)
    text = doc.text[:head] + following.text[:tail]
    a, b = max(0, head - SPAN + 1), min(tail, SPAN - 1)
    seam = PrefixHash(np.concatenate([doc.codes[a:head], following.codes[:b]]), PRIMES[:1]).spans(SPAN)
    spans = np.concatenate([doc.spans[: max(0, head - SPAN + 1)], scrambled(seam), following.spans[: max(0, tail - SPAN + 1)]])
    whole = ""
    for k, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
        whole += f"{(int(doc.prefix.sums[k][head]) + int(following.prefix.sums[k][tail]) * pow(base, head, prime)) % prime:08x}"
    codes = np.concatenate([doc.codes[:head], following.codes[:tail]]) if head + tail < SPAN else doc.codes[:1]
    kept = sketch(codes, spans) if head + tail else np.zeros(0, np.uint64)
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), printed(head + tail, whole, kept)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix_next long"


#: Where a document stands: nulls last, ids descending, then by a hash of the text.
KEY, NAMES = "none boolean, below long, hash long", ["none", "below", "hash"]
#: Sampled keys for each range, which sets how even the ranges are.
SAMPLED = 20


def _key() -> Column:
    doc_id = F.col("doc_id")
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(F.bitwise_not(doc_id), F.lit(0)).alias("below"), F.xxhash64("text").alias("hash"))


def _bounds(rows: DataFrame, n: int) -> list[tuple]:
    """Keys of rows at which ranges start, at most ``n - 1``, ascending; a key of very many rows is there several times."""
    wanted = SAMPLED * n
    drawn = rows.sample(min(1.0, 2 * wanted / max(1, rows.count())), 42).select("key.*").limit(4 * wanted).collect()
    found = sorted(map(tuple, drawn))
    return [found[k * len(found) // n] for k in range(1, n)] if found else []


def _place(bounds: list[tuple]) -> Column:
    """The number of a key's range: how many bounds are not above it."""
    if not bounds:
        return F.lit(0)
    # One constant, however many bounds, and a binary search in it.
    listed = F.from_json(F.lit(json.dumps([dict(zip(NAMES, x, strict=True)) for x in bounds])), "array<struct<none: boolean, below: bigint, hash: bigint>>")

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        goes, open_ = F.get(listed, middle) <= F.col("key"), s["low"] < s["high"]
        return F.struct(F.when(open_ & goes, middle + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~goes, middle).otherwise(s["high"]).alias("high"))

    begin = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), begin, halve)["low"]


#: Rows that one row stands for at most while equal rows are written out.
COPIES = 10_000


def document_fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and its likeness to the next one.

    ``next`` is the following document in descending doc_id, and the first for
    the last. Documents are dealt into ranges that start at the keys of sampled
    documents, and each range is one sorted partition: texts are shuffled once.
    A range's last row needs the row that the next range starts at, which is
    known beforehand, so it is sent there too; the last range gets the first
    row of all. Of equal rows that are as many as a range or more, one is
    laid and stands for the others, which all follow each other. No task sees more than its range, and what the driver holds are ``SAMPLED`` keys a range.

    Null texts count as empty, with an empty sketch; equal texts have equal
    fingerprints. Rows of equal doc_id are ordered by the hashes of their texts; null doc_ids
    come last; repeated rows get a row each; a single document follows itself;
    an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions or parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", _key())
    drawn = _bounds(rows, n) if n > 1 else []
    bounds = sorted(set(drawn))
    hot = sorted(x for x, times in Counter(drawn).items() if times > 1)
    flat = rows.select("doc_id", "text", "key.*")

    def once(keys: list[tuple], *more: Column) -> DataFrame:
        """One row of each of some keys, few at most, combined before the shuffle."""
        listed = F.broadcast(spark.createDataFrame(keys, KEY))
        return flat.join(listed, NAMES).groupBy(*NAMES).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), *more)

    copies = None
    if hot:
        one = once(hot, (F.count("*") - 1).alias("times"))
        copies = one.where("times > 0").select("doc_id", "text", "times")
        flat = flat.join(F.broadcast(spark.createDataFrame(hot, KEY)), NAMES, "left_anti").unionByName(one.select("doc_id", "text", *NAMES))
    least = rows.agg(F.min("key").alias("key")).first()["key"]
    # Each range's guest is a row with the key that the next one starts at; a bounded list of keys.
    guests = [(*x, k) for k, x in enumerate(bounds)] + ([(*least, len(bounds))] if least is not None else [])
    first = once(sorted({x[:3] for x in guests})).join(F.broadcast(spark.createDataFrame(guests, f"{KEY}, place int")), NAMES)
    key = F.struct(*NAMES).alias("key")
    sent = flat.select("doc_id", "text", key).withColumn("place", _place(bounds)).withColumn("guest", F.lit(False)).unionByName(first.select("doc_id", "text", key, "place", F.lit(True).alias("guest")))
    laid = sent.repartitionById(len(bounds) + 1, "place").sortWithinPartitions("guest", "key")

    def row_of(doc_id: int | None, doc: Document, after: Document) -> tuple:
        sha, changed = edited(doc, after)
        return doc_id, doc.codes.size, sha, doc.print, changed, likeness(doc.print, changed), likeness(doc.print, after.print), doc.prefix.extension(0, after.prefix, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        out: list[tuple] = []

        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield batch.column("doc_id")[k].as_py(), batch.column("text")[k].as_py(), batch.column("guest")[k].as_py()

        for doc_id, text, guest in rows_of():
            doc = Document(text)
            if held is not None:
                out.append(row_of(*held, doc))
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)
                    out = []
            held = None if guest else (doc_id, doc)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)

    kind = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix_next", pa.int64())])
    found = laid.select("doc_id", "text", "guest").mapInArrow(run, OUT)
    if copies is None:
        return found

    def follow_each_other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [row_of(i, doc, doc) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for doc in (Document(t),)]
            if own:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*own, strict=True), kind.types, strict=True)), batch.column(2)], names=[*kind.names, "times"])

    equal = copies.mapInArrow(follow_each_other, f"{OUT}, times long")
    # Written out by many tasks, a part of the rows each.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES))).alias("part")
    dealt = equal.select("*", part).repartition("doc_id", "fingerprint", "part")
    some = F.least(F.lit(COPIES), F.col("times") - F.col("part") * COPIES)
    return found.unionByName(dealt.select(*kind.names, F.explode(F.sequence(F.lit(1).cast("long"), some)).alias("copy")).drop("copy"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents``."""
    return document_fingerprints(table(spark, sf_dir, "documents"))
