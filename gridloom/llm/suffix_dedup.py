"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``LENGTH`` bytes, most significant digits
first, and only as far as they are not yet alone; what is equal after the last
digit are exactly the strings that start more than once.

Sorting a suffix for every byte would move twenty times the text. The first
digit is therefore not a window's first bytes but its anchor, the smallest of
the hashes of all ``DIGIT``-byte strings inside it. It depends on the window's
bytes alone, so equal windows have equal first digits, and neighbouring windows
share theirs: there is one row for a run of about ``(LENGTH - DIGIT) / 2``
windows, which differ in how far they reach to the left of the anchor. The
further digits are the bytes around the anchor. The passes, each a grouped
count that is combined before its shuffle:

1. first digit, the anchor: runs whose anchor is alone hold no repeated window;
2. all bytes that a run covers: runs that are equal there repeat in every
   window, and one of them stands for the others from here on;
3. for each width in ``WIDTHS``, the windows are cut into nodes of so many
   offsets from the anchor. The core of a node, the bytes that all its windows
   share, is the next digit: a node whose core is alone holds no repeated
   window. The hull, all bytes that its windows cover, settles a node that is
   equal to another one as a whole. Only what is neither is cut further, so rows
   go down to single windows about as often as copies begin, end or differ.

No pass needs a group's rows together, whatever its size, and what is found are
ranges of windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filtered, key_filter, maybe_in, release, staged, table

LENGTH, DIGIT = 200, 64
#: Windows handled at once, which bounds the memory that a long text takes.
BLOCK = 1 << 18
#: Offsets in a node, pass by pass; each width divides the one before, and the last is a single window. At most 57, as hulls then have 256 bytes.
WIDTHS = (24, 4, 1)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**64, 256, np.uint64), rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


BYTES, ODD = _tables()


def joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hash of two neighbouring hashes, by place."""
    with np.errstate(over="ignore"):
        x = a * ODD[salt] + b
        x ^= x >> np.uint64(29)
        x *= ODD[salt + 16]
        x ^= x >> np.uint64(32)
        return x


def doubled(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of 64 and of 128 bytes."""
    h, n = BYTES[data], 1
    while n < 128:
        if n == 64:
            short = h
        h = joined(h[:-n], h[n:], n.bit_length()) if h.size > n else h[:0]
        n *= 2
    return short, h


def string_hashes(long: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings from ``start`` to ``end``, of 128 to 256 bytes each: of their first and last 128 bytes and their length."""
    return joined(joined(long[start], long[end - 128], 12), (end - start).astype(np.uint64), 13)


def pieces(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(data, number, begin, offset)``: short texts one after another, long ones cut, so that ``data`` has about ``BLOCK`` bytes.

    Piece k of ``data`` starts at ``begin[k]`` and is text ``number[k]`` from ``offset[k]`` on. Pieces of one text overlap by what a window needs.
    """
    held, number, offset, size = [], [], [], 0
    for k, raw in enumerate(texts):
        for at in range(0, len(raw) - LENGTH + 1, BLOCK):
            part = raw[at : at + BLOCK + LENGTH - 1] if len(raw) > BLOCK else raw
            held.append(part)
            number.append(k)
            offset.append(at)
            size += len(part)
            if size >= BLOCK:
                begin = np.cumsum([0, *map(len, held)])
                yield np.frombuffer(b"".join(held), np.uint8), np.array(number), begin, np.array(offset)
                held, number, offset, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(number), np.cumsum([0, *map(len, held)]), np.array(offset)


def anchored(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(piece, first, last, until, spot, n, anchor, whole)`` of each run of windows that share their anchor.

    A run's windows start at first..last, counted in its piece; ``spot`` is
    where the anchor starts, ``anchor`` the hash of its bytes, ``whole`` that of all bytes
    which the run covers. ``n`` runs in succession that are equal as a whole, as
    those of a periodic text, are one row: its windows go on to ``until``.
    """
    n = data.size - LENGTH + 1
    short, long = doubled(data)
    # The leftmost smallest hash: ranked by its upper bits, then by place.
    key = (short >> np.uint64(20) << np.uint64(20)) | np.arange(short.size, dtype=np.uint64)
    width, span = LENGTH - DIGIT + 1, 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[:n], key[width - span : width - span + n])
    spot = (key[:n] & np.uint64((1 << 20) - 1)).astype(np.int64)
    # Windows that would reach into the next piece don't count.
    inside = np.ones(n, bool)
    for end in begin[1:-1].tolist():
        inside[end - LENGTH + 1 : end] = False
    turn = np.concatenate([[True], spot[1:] != spot[:-1]])
    first = np.flatnonzero(inside & (turn | np.concatenate([[True], ~inside[:-1]])))
    last = np.flatnonzero(inside & np.concatenate([turn[1:] | ~inside[1:], [True]]))
    # A run covers at most 2 * LENGTH - DIGIT bytes: three strings of 128 and the run's length name them.
    end = last + LENGTH - 128
    whole = joined(joined(long[first], long[(first + end) // 2], 9), joined(long[end], (last - first).astype(np.uint64), 10), 11)
    anchor, piece = short[spot[first]], np.searchsorted(begin, first, "right") - 1
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (piece[1:] != piece[:-1])])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], first.size) - 1
    base = begin[piece[head]]
    return piece[head], first[head] - base, last[head] - base, last[tail] - base, spot[first[head]] - base, tail - head + 1, anchor[head], whole[head]


ROWS = "doc_id long, gl_key long, first int, last int, until int, spot int, n int, anchor long, whole long"


def anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() or b"" for t in batch.column(2).cast(pa.binary()))
            for data, number, begin, offset in pieces(texts):
                piece, *places, n, anchor, whole = anchored(data, begin)
                of = pa.array(number[piece])
                places = [pa.array((x + offset[piece]).astype(np.int32)) for x in places]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *places, pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))], names=["doc_id", "gl_key", "first", "last", "until", "spot", "n", "anchor", "whole"])

    return docs.mapInArrow(merged_batches(run), ROWS)


def merged_batches(run):
    """``run`` with its many small batches joined into larger ones."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 16:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return merged


def repeated_windows(rows: DataFrame, docs: DataFrame) -> list[DataFrame]:
    """Staged tables ``(doc_id, gl_key, first, last)`` that together are the ranges of starts whose windows repeat; releases ``rows``."""
    shared = staged(rows.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    # A filter of fixed size keeps most rows of lone anchors out of the shuffle; the join is exact.
    every, rows = rows, staged(maybe_in(rows, "anchor", key_filter(shared, "anchor")).join(shared, "anchor", "left_semi"), "shared")
    release(every, shared)
    one = F.struct("doc_id", "gl_key", "spot", (F.col("spot") - F.col("last")).alias("low"), (F.col("spot") - F.col("first")).alias("high"))
    classes = staged(rows.groupBy("anchor", "whole").agg(F.sum("n").alias("n"), F.min(one).alias("one")), "classes")
    # Plain tables on both sides, so that the join can split what very many rows share.
    often = classes.where("n > 1").select("anchor", "whole")
    found = [staged(rows.join(often, ["anchor", "whole"], "left_semi").select("doc_id", "gl_key", "first", F.col("until").alias("last")), "equal")]
    release(rows)
    # Runs unlike all others, where there is another to compare them with, and one run of each class.
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("anchor")
    spans = staged(classes.join(mixed, "anchor").select("anchor", (F.col("n") == 1).alias("alone"), "one.*"), "open")
    release(classes)
    for width in WIDTHS:
        nodes = staged(cut_out(spans, docs, width), "nodes")
        release(spans)
        classes = staged(nodes.groupBy("anchor", "node", "core", "hull").agg(F.count("*").alias("n"), F.bool_and("alone").alias("alone"), F.min(F.struct("doc_id", "gl_key", "spot", "low", "high")).alias("one")), "classes")
        often = classes.where("n > 1").select("anchor", "node", "core", "hull")
        equal = nodes.where("alone").join(often, ["anchor", "node", "core", "hull"], "left_semi")
        found.append(staged(equal.select("doc_id", "gl_key", (F.col("spot") - F.col("high")).alias("first"), (F.col("spot") - F.col("low")).alias("last")), "equal"))
        release(nodes)
        if width == WIDTHS[-1]:
            release(classes)
            break
        alone = (F.col("n") == 1) & F.col("alone")
        mixed = classes.groupBy("anchor", "node", "core").agg(F.count("*").alias("kinds"), F.bool_or(alone).alias("some")).where("kinds > 1 AND some").select("anchor", "node", "core")
        spans, old = staged(classes.join(mixed, ["anchor", "node", "core"]).select("anchor", alone.alias("alone"), "one.*"), "open"), classes
        release(old)
    return found


NODES = "doc_id long, gl_key long, anchor long, spot int, alone boolean, node int, low int, high int, core long, hull long"


def cut_out(spans: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The nodes of ``width`` offsets that hold windows of ``spans``, with the hashes of their cores and hulls.

    A span has the windows that start ``low`` to ``high`` bytes before ``spot``.
    """
    lists = staged(spans.groupBy("doc_id", "gl_key").agg(F.collect_list(F.struct("spot", "anchor", "alone", "low", "high")).alias("spans")), "spans")
    docs = maybe_in(docs, "gl_key", key_filter(lists, "gl_key"))
    lists = lists.withColumnsRenamed({"doc_id": "s_id", "gl_key": "s_key"})
    same = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("gl_key") == F.col("s_key"))
    # Rows that repeat are cut twice, which changes nothing: none of their spans is alone.
    texts = docs.join(lists.hint("shuffle_hash"), same).select("doc_id", "gl_key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            spot, anchor, alone, low, high = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            texts = (t.as_py() or b"" for t in batch.column(2).cast(pa.binary()))
            for data, some, place in surroundings(texts, row, spot, low, high):
                of, node, lo, hi = cut_into(low[some], high[some], width)
                if of.size:
                    _, long = doubled(data)
                    at, least = place[of], node * width
                    most = np.minimum(least + width, LENGTH - DIGIT + 1) - 1
                    core = string_hashes(long, at - least, at - most + LENGTH)
                    # Equal hulls are those of the same offsets.
                    hull = joined(string_hashes(long, at - hi, at - lo + LENGTH), (lo * LENGTH + hi).astype(np.uint64), 14)
                    span = some[of]
                    taken = pa.array(row[span])
                    numbers = [pa.array(x.astype(np.int32)) for x in (spot[span], node, lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(anchor[span]), numbers[0], pa.array(alone[span]), *numbers[1:], pa.array(core.view(np.int64)), pa.array(hull.view(np.int64))],
                        names=["doc_id", "gl_key", "anchor", "spot", "alone", "node", "low", "high", "core", "hull"],
                    )

    return texts.mapInArrow(merged_batches(run), NODES)


def surroundings(texts: Iterator[bytes], row: np.ndarray, spot: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(data, spans, place)``: bytes around the anchors of ``spans``, and where in them each anchor starts; ``data`` has about ``BLOCK`` bytes."""
    held, spans, places, size = [], [], [], 0
    for k, raw in enumerate(texts):
        own = np.arange(*np.searchsorted(row, [k, k + 1]))
        own = own[np.argsort(spot[own], kind="stable")]
        for some in np.split(own, np.flatnonzero(np.diff(spot[own] // BLOCK)) + 1) if own.size else []:
            begin = int((spot[some] - high[some]).min())
            held.append(raw[begin : int((spot[some] - low[some]).max()) + LENGTH])
            spans.append(some)
            places.append(spot[some].astype(np.int64) - begin + size)
            size += len(held[-1])
            if size >= BLOCK:
                yield np.frombuffer(b"".join(held), np.uint8), np.concatenate(spans), np.concatenate(places)
                held, spans, places, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.concatenate(spans), np.concatenate(places)


def cut_into(low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """``(span, node, low, high)`` of every node of ``width`` offsets that spans from ``low`` to ``high`` reach, and their offsets in it."""
    first = low // width
    n = high // width - first + 1
    span = np.repeat(np.arange(n.size), n)
    node = (first[span] + np.arange(span.size) - np.repeat(np.cumsum(n) - n, n)).astype(np.int64)
    return span, node, np.maximum(low[span], node * width).astype(np.int64), np.minimum(high[span], node * width + width - 1).astype(np.int64)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>, kept binary"


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends, kept)``, a row for each row of ``docs``.

    Removes every byte that lies in a string of ``LENGTH`` bytes which also
    starts anywhere else, in the same document or another; strings are judged
    on the input, and never cross documents. ``starts`` and ``ends`` are the
    removed runs as byte offsets; ``kept`` holds the remaining bytes if
    ``with_text`` is set, else null.

    Strings are compared by 128 bits of hash (of the anchor and of the whole). A row is known by its doc_id and
    text, so repeated rows are documents of their own that repeat each other; a
    null doc_id is an id like any other; null and empty texts have no bytes;
    texts below ``LENGTH`` bytes lose none; an empty table gives no rows;
    further columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("doc_id", F.xxhash64("doc_id", "text").alias("gl_key"), "text")
    rows = staged(anchor_rows(base), "runs")
    found = repeated_windows(rows, base)
    # Ranges of one text meet here; a text's ranges are at most as long as the text.
    lists = reduce(DataFrame.unionByName, found).groupBy("doc_id", "gl_key").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    lists = staged(lists.withColumnsRenamed({"doc_id": "r_id", "gl_key": "r_key"}), "ranges")
    release(*found)
    # Only texts that may have ranges are shuffled to them; the others pass by.
    some = key_filter(lists, "r_key")
    near = maybe_in(base, "gl_key", some).join(lists.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("gl_key") == F.col("r_key")), "left").select("doc_id", "text", "ranges")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                raw = text.as_py() or b""
                starts, ends, kept = [], [], raw
                if spans.is_valid:
                    pairs = spans.values.flatten()
                    steps = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(steps, pairs[0].to_numpy(), 1)
                    np.add.at(steps, pairs[1].to_numpy().astype(np.int64) + LENGTH, -1)
                    gone = np.cumsum(steps[:-1]) > 0
                    turns = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                    starts, ends = np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist()
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((doc_id.as_py(), len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), starts, ends, kept if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "kept"])

    sent = base.sparkSession.sparkContext.broadcast(some)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Filters and passes on in one Python worker, as a second one would hold the texts once more."""
        for batch in batches:
            part = filtered(batch, "gl_key", sent.value, inside=False)
            nothing = pa.nulls(part.num_rows, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
            yield from run(iter([pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), nothing], names=["doc_id", "text", "ranges"])]))

    return near.mapInArrow(run, RESULT).unionByName(base.mapInArrow(untouched, RESULT))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes removed from all ``documents``."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
