"""Near-duplicates by word shingles in common, found through vantage-point trees over their SimHashes.

Texts that share 0.8 of their shingles differ in about 15 % of the bits of a
SimHash. The vantage-point search of ``simhash.near_links`` goes over three
SimHashes, in twelve blocks of 16 bits: balls of radius 1, which overlap few
shards, hold such a text in at least one block 98 times in 100 (a radius of 3,
which never misses, reaches most shards, and the work grows with the square of
the texts). Inside a shard whole SimHashes are compared.

For the rest there are SimHashes of parts: a text's distinct shingles are parted into
classes by their hashes, a class for a few shingles, and each class has a
SimHash of its own. Texts that are alike have some class wholly in common, and
so an equal SimHash, at distance zero. What is near either way is compared
exactly, shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_filter, maybe_in, release, sheltered, staged
from .graph import connected_components
from .simhash import SEED, components_of, hook, near_links

#: Words in a shingle, and the share of distinct shingles that texts must have in common.
WORDS, SIMILAR = 5, 0.8
#: Classes of a text, and shingles that a class has at least on average. Two texts at ``SIMILAR`` have a given class of two or more shingles wholly in common about
#: four times in ten where classes are small and once in four where they are large, so that all 24 miss at most once in 1,000.
CLASSES, CLASS_SIZE = 24, 3
#: Bits of the three SimHashes of all shingles, 192 together, in which candidates may differ. At ``SIMILAR`` about 29 do, with a deviation of 5.
NEAR_TOTAL = 47
#: The three SimHashes' columns, and the radius of balls in one of the four blocks of 16 bits that each has.
PRINT_NAMES, RADIUS = ("fp0", "fp1", "fp2"), 1

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A hash of hashes, one for each salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, kept until there are too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 18:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingle_set(text: bytes, words: int, kept: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's lower-cased word shingles; a text of fewer words is one shingle, an empty one none."""
    found = text.lower().split()  # of bytes: A-Z, and exactly the ASCII white space
    h = np.fromiter(map(kept.__getitem__, found), np.uint64, len(found))
    width = min(words, h.size)
    if not width:
        return h
    out = np.full(h.size - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out ^ h[k : h.size - width + 1 + k], k)
    return np.unique(out)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majorities(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHashes of runs of hashes that start at ``begin``: bits set in over half of a run."""
    out = np.zeros(begin.size, np.uint64)
    step = 1 << 16
    low = 0
    while low < begin.size:
        # As many whole runs as fit, or one longer one in parts.
        high = max(low + 1, int(np.searchsorted(begin, begin[low] + step, "right")) - 1)
        if high == low + 1 and size[low] > step:
            counts = sum(bits_of(hashes[a : min(a + step, begin[low] + size[low])]).sum(0, dtype=np.int64) for a in range(begin[low], begin[low] + size[low], step))[None, :]
        else:
            end = begin[high - 1] + size[high - 1]
            counts = np.add.reduceat(bits_of(hashes[begin[low] : end]), begin[low:high] - begin[low], axis=0, dtype=np.int64)
        out[low:high] = np.packbits(2 * counts > size[low:high, None], axis=1, bitorder="little").view("<u8")[:, 0]
        low = high
    return out


def levels(n: int, similar: float) -> set[int]:
    """Binary logarithms of how many classes a set of ``n`` shingles is parted into: for its own size, and for that of the largest set that may be alike."""
    return {max(1, floor(log2(max(1.0, x / CLASS_SIZE)))) for x in (n, n / similar)}


def class_keys(sets: list[np.ndarray], similar: float) -> list[np.ndarray]:
    """For each set the keys of its classes of two or more shingles: a hash of class and SimHash.

    Where there are fewer than ``CLASSES`` classes, sets are parted anew by
    further hashes; where there are more, the first ones are taken. Sets of up to
    three shingles are alike only if they are equal, and have no keys.
    """
    hashes, places, owner, codes = [], [], [], []
    n = 0
    for k, own in enumerate(sets):
        if own.size < 4:
            continue
        for level in levels(own.size, similar):
            count = min(1 << level, CLASSES)
            for turn in range(max(1, -(-CLASSES >> level))):
                of = (mixed(own, 64 + turn) >> np.uint64(64 - level)).astype(np.int64)
                some = own if count == 1 << level else own[of < count]
                hashes.append(some)
                places.append(n + of[of < count])
                owner.append(np.full(count, k))
                codes.append(np.arange(count) + ((level << 16 | turn) << 16))
                n += count
    out = [np.zeros(0, np.uint64)] * len(sets)
    if not n:
        return out
    place, every = np.concatenate(places), np.concatenate(hashes)
    order = np.argsort(place, kind="stable")
    size = np.bincount(place, minlength=n)
    filled = np.flatnonzero(size)
    begin = (np.cumsum(size) - size)[filled]
    prints = majorities(every[order], begin, size[filled])
    keys = mixed(prints ^ mixed(np.concatenate(codes)[filled].astype(np.uint64), 40), 41)
    whose = np.concatenate(owner)[filled]
    enough = size[filled] >= 2
    keys, whose = keys[enough], whose[enough]
    cuts = np.searchsorted(whose, np.arange(len(sets) + 1))
    return [np.unique(keys[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


PRINTS = "doc_id long, text_key long, node long, fp0 long, fp1 long, fp2 long, size int, classes array<long>"


def prints_of(texts: DataFrame, words: int, similar: float) -> DataFrame:
    """For each ``(doc_id, text_key, text)`` its ``PRINTS``: ``node`` is a hash of the set of shingles, ``fp0`` to ``fp2`` its SimHashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kept = WordHashes()
        for batch in batches:
            every = batch.column("text").cast(pa.binary())
            at = 0
            while at < len(every):
                # So many texts at once that their shingles are few.
                first, sets, total = at, [], 0
                while at < len(every) and total < 1 << 16:
                    sets.append(shingle_set(every[at].as_py() or b"", words, kept))
                    total += sets[-1].size
                    at += 1
                size = np.array([x.size for x in sets], np.int64)
                node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64)
                some = np.flatnonzero(size)
                flat, begin = np.concatenate(sets), (np.cumsum(size) - size)[some]
                prints = np.zeros((3, size.size), np.uint64)
                for k in range(3):
                    prints[k, some] = majorities(mixed(flat, k), begin, size[some])
                keys = class_keys(sets, similar)
                ends = np.cumsum([0, *(x.size for x in keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(node.view(np.int64)), *(pa.array(x.view(np.int64)) for x in prints), pa.array(size.astype(np.int32)), lists],
                    names=["doc_id", "text_key", "node", "fp0", "fp1", "fp2", "size", "classes"],
                )

    return texts.select("doc_id", "text_key", "text").mapInArrow(run, PRINTS)


def candidate_links(distinct: DataFrame, total: int, cell_rows: int = 4096) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the nodes that share a class and differ in at most ``total`` bits.

    Every member of a class is first compared with its smallest node, which
    takes a join and no grouping, so a large class is spread like any other. Only
    members that are too far from it, in a class of three or more, are
    compared with all others of the class, in cells of (part of these, part of the members).
    """
    keys = distinct.select(F.explode("classes").alias("key"), "node")
    shared = staged(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "shared")
    # A filter of fixed size keeps most lone classes out of the shuffle; the join is exact.
    members = staged(maybe_in(keys, "key", key_filter(shared, "key")).join(shared, "key"), "members")
    prints = [distinct.select(F.col("node").alias(end), *[F.col(f"fp{k}").alias(f"{end}{k}") for k in range(3)]) for end in "ab"]
    stars = members.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(3)), F.lit(0))
    stars = staged(stars.join(prints[0], "a").join(prints[1], "b").select("a", "b", apart.alias("apart")), "stars")
    far = stars.where(F.col("apart") > total).select(F.col("a").alias("least"), F.col("b").alias("node"))
    strays = staged(members.where("n > 2").join(far, ["least", "node"], "left_semi").select("key", "node"), "strays")
    cells = staged(strays.groupBy("key").agg(F.count("*").alias("strays")).join(shared, "key").select("key", F.ceil(F.col("strays") / cell_rows).cast("int").alias("down"), F.ceil(F.col("n") / cell_rows).cast("int").alias("across")), "cells")
    cell = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = strays.join(cells, "key").select("key", "node", F.lit(True).alias("stray"), cell("down", 1).alias("q"), every("across").alias("h"))
    rest = members.join(cells, "key").select("key", "node", F.lit(False).alias("stray"), cell("across", 2).alias("h"), every("down").alias("q"))
    rows = some.unionByName(rest).join(distinct.select("node", "fp0", "fp1", "fp2"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows >= 1 << 14:
                cut = ends(held)
                if cut.size > 1:
                    yield from found(held.slice(0, int(cut[-2])))
                    held = held.slice(int(cut[-2]))
        if held is not None and held.num_rows:
            yield from found(held)

    def ends(t: pa.Table) -> np.ndarray:
        at = [t.column(c).to_numpy() for c in ("key", "q", "h")]
        return np.append(np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1, t.num_rows)

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes, stray = t.column("node").to_numpy(), t.column("stray").to_numpy()
        words = np.stack([t.column(f"fp{k}").to_numpy().view(np.uint64) for k in range(3)])
        a, b = [], []
        begin = 0
        for end in ends(t).tolist():
            parent = np.arange(end - begin)
            own, all_of = words[:, begin:end], np.flatnonzero(~stray[begin:end])
            odd = np.flatnonzero(stray[begin:end])
            step = max(1, (1 << 20) // max(1, all_of.size))
            for k in range(0, odd.size, step):
                q = odd[k : k + step]
                far = sum(np.bitwise_count(own[w][q][:, None] ^ own[w][all_of][None, :]).astype(np.int16) for w in range(3))
                i, j = np.nonzero(far <= total)
                hook(parent, q[i], all_of[j])
            child = np.flatnonzero(parent != np.arange(parent.size))
            a.append(nodes[begin:end][child])
            b.append(nodes[begin:end][parent[child]])
            begin = end
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    dealt = rows.repartition("key", "q", "h").sortWithinPartitions("key", "q", "h")
    searched = staged(dealt.select("key", "q", "h", "node", "stray", "fp0", "fp1", "fp2").mapInArrow(compare, "a long, b long"), "searched")
    links = staged(stars.where(F.col("apart") <= total).select("a", "b").unionByName(searched).distinct(), "links")
    release(shared, members, stars, strays, cells, searched)
    return links


def sets_of(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(node, hashes)`` of every ``(node, text_key)`` in ``wanted``: the sorted hashes of a text's shingles, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = WordHashes()
        for batch in batches:
            every = batch.column("text").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(t.as_py() or b"", words, kept).tobytes() for t in every], pa.binary())], names=["node", "hashes"])

    # Few texts are candidates; copies of one are combined before the shuffle.
    some = maybe_in(texts.select("text_key", "text"), "text_key", key_filter(wanted, "text_key")).groupBy("text_key").agg(F.first("text").alias("text"))
    return some.join(wanted, "text_key").select("node", "text").mapInArrow(run, "node long, hashes binary")


def join_alike(sets: list[np.ndarray], parent: np.ndarray, similar: float) -> None:
    """Union all sets that share at least ``similar`` of their elements; every pair is compared, by lists of the sets that hold an element."""
    sizes = np.array([s.size for s in sets], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    elements = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(sizes.size), sizes)[np.argsort(elements, kind="stable")]
    counts = np.bincount(elements)
    first = np.cumsum(counts) - counts
    for k in range(1, sizes.size):
        if not parent.any():  # all are one set already
            return
        own = elements[bounds[k] : bounds[k + 1]]
        n = counts[own]
        listed = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(holders[listed], minlength=sizes.size)[:k]
        near = np.flatnonzero(common / np.maximum(sizes[:k] + sizes[k] - common, 1) >= similar)
        hook(parent, np.full(near.size, k), near)


def alike_links(links: DataFrame, distinct: DataFrame, texts: DataFrame, words: int, similar: float, cell_rows: int = 512) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the nodes of a component of ``links`` whose texts share ``similar`` of their shingles (Jaccard), directly or through others.

    A component of candidates of up to ``cell_rows`` nodes is compared whole,
    each pair of texts exactly. A larger one is first joined along its links,
    which leaves nothing to do in most dense groups; what stays apart is
    compared in cells of (part, other part), so that no task holds more.
    """
    found = staged(connected_components(links).select("node", F.col("component").alias("family")), "families")
    wanted = staged(distinct.join(found, "node").select("node", "text_key"), "wanted")
    sets = staged(sets_of(texts, wanted, words).join(found, "node"), "sets")
    sizes = staged(found.groupBy("family").agg(F.count("*").alias("n")), "sizes")
    large = found.join(sizes.where(F.col("n") > cell_rows), "family").select("node")
    pairs = links.join(large, F.col("a") == F.col("node"), "left_semi")
    ends = [sets.select(F.col("node").alias(k), F.col("hashes").alias(f"set_{k}")) for k in "ab"]

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                common = np.intersect1d(x, y, assume_unique=True).size
                keep.append(common / max(x.size + y.size - common, 1) >= similar)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sure = staged(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "set_a", "set_b").mapInArrow(alike, "a long, b long"), "sure")
    # Plain tables without texts, so that the join can split a large family.
    joined = connected_components(sure)
    labels = staged(found.join(joined, "node", "left").select("node", "family", F.coalesce("component", "node").alias("sub")), "labels")
    apart = labels.groupBy("family").agg(F.count("*").alias("n"), F.min("sub").alias("low"), F.max("sub").alias("high")).where("low < high")
    apart = staged(apart.select("family", F.ceil(F.col("n") / cell_rows).cast("int").alias("cells")), "apart")
    dealt = labels.join(apart, "family").withColumn("c", F.pmod(F.xxhash64("node", F.lit(3)), F.col("cells")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    dealt = staged(dealt.select("family", F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d"), "node", "sub"), "dealt")
    rows = dealt.join(sets.select("node", "hashes"), "node")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        nodes, subs = (group.column(k).to_numpy() for k in ("node", "sub"))
        _, first, back = np.unique(subs, return_index=True, return_inverse=True)
        parent = first[back]
        join_alike([np.frombuffer(s.as_py(), np.uint64) for s in group.column("hashes")], parent, similar)
        child = np.flatnonzero(parent != np.arange(nodes.size))
        return pa.table({"a": nodes[child], "b": nodes[parent[child]]})

    compared = staged(rows.groupBy("family", "c", "d").applyInArrow(compare, "a long, b long"), "compared")
    out = staged(sure.unionByName(compared), "alike")
    release(found, wanted, sets, sizes, sure, labels, apart, dealt, compared)
    return out


def similar_texts(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, total: int = NEAR_TOTAL) -> DataFrame:
    """``(doc_id, text_key, component, component_id)``, a row for each row of ``docs``.

    Texts link that have at least ``similar`` of their distinct word shingles in
    common, compared exactly; ``component_id`` is the smallest doc_id that links
    lead to, the document's own included. Texts of equal sets of shingles are one node.

    Null and empty texts have no shingles and link with each other; a null
    doc_id is never a component's smallest, unless the component has no other;
    repeated rows get a row each; an empty table gives no rows; further columns
    are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    prints = staged(prints_of(texts, words, similar), "prints")
    some = [F.first(c).alias(c) for c in ("fp0", "fp1", "fp2", "classes")]  # equal for equal nodes
    distinct = staged(prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), *some), "distinct")
    near = near_links(distinct, total, fps=PRINT_NAMES, radius=RADIUS)
    rest = candidate_links(distinct, total)
    links = alike_links(near.unionByName(rest), distinct, texts, words, similar)
    classes = components_of(distinct.select("node", "first_id"), links)
    release(near, rest, distinct, links)
    return prints.select("doc_id", "text_key", "node").join(classes, "node").select("doc_id", "text_key", "component", "component_id")


def near_deduplicated(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; columns stay, whatever their names.

    The row with the smallest doc_id stays (nulls last), of a tie the one whose
    text has the smallest hash; rows that repeat each other in both leave the
    one with the smallest hash of all columns. Null and empty texts are
    duplicates of each other; an empty table gives no rows.
    """
    inner, of = sheltered(docs)
    texts = inner.select(of("doc_id").alias("doc_id"), of("text").alias("text"))
    found = staged(similar_texts(texts, words, similar).select("doc_id", "text_key", "component"), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    best = staged(found.groupBy("component").agg(F.min(place).alias("best")), "best")
    lost = staged(found.join(best, "component").where(place != F.col("best")).select(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key")).distinct(), "lost")
    again = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    release(found, best)
    keyed = inner.withColumns({"own_id": of("doc_id").cast("long"), "own_key": F.xxhash64(F.coalesce(of("text"), F.lit("")))})
    out = keyed.join(lost.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("lost_id")) & (F.col("own_key") == F.col("lost_key")), "left_anti")
    if again:
        row = F.struct(*inner.columns)
        out = out.groupBy("own_id", "own_key").agg(F.min_by(row, F.xxhash64(*inner.columns)).alias("row")).select("row.*")
    return out.select(*inner.columns).toDF(*docs.columns)
