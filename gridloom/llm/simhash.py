"""SimHash near-duplicates through vantage-point trees.

Fingerprints are sharded by vantage-point trees: each node splits by the
Hamming distance to a vantage point, and by the triangle inequality a query
with radius ``r`` need not enter a branch whose shell it cannot reach. Queries
go to every shard whose boundary their ball overlaps, where a local tree finds
the exact pairs.

Whole 64-bit fingerprints of unrelated texts all lie about 32 bits from each
other, so radius 4 would overlap most boundaries. The trees therefore measure
distance on one block of bits each. Of ``blocks`` disjoint blocks, two
fingerprints within ``distance`` bits differ by at most ``distance // blocks``
in at least one, so a tree for each block, searched with that small radius,
finds every pair; the whole fingerprints are then compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, staged, table
from .graph import connected_components

SEED = 42
BITS = 64


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of ``hashes``."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, hashes.size, 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > hashes.size, bitorder="little").view("<u8")[0])


def shingles(text: bytes, words: int) -> list[bytes]:
    """A text's lower-cased word shingles in order, repeats included; a text of fewer words is one shingle, an empty one none."""
    found = text.lower().split()  # of bytes: A-Z, and exactly the ASCII white space
    if not found:
        return []
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    n = max(1, len(found) - words + 1)
    return [joined[a : b - 1] for a, b in zip(starts[:n], ends[len(found) - n :], strict=True)]


def hashed(found: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in found), np.uint64, len(found))


def fingerprint(text: bytes, words: int = 4) -> int:
    """The unsigned SimHash of a text's word shingles, repeats included; zero without words."""
    found = shingles(text, words)
    return majority(hashed(found)) if found else 0


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py() or b"", words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("fp", "long"))


class BlockTree:
    """A vantage-point tree of fixed depth over one block of bits, as arrays in heap order."""

    def __init__(self, sample: np.ndarray, shift: int, bits: int, radius: int, depth: int, seed: int = 1):
        self.shift, self.mask, self.radius, self.depth = shift, (1 << bits) - 1, radius, depth
        self.points = np.zeros(max(1, (1 << depth) - 1), np.uint64)
        self.shells = np.full(self.points.size, bits, np.int64)  # all inside: a node that isn't split
        rng = np.random.default_rng(seed)
        rows = {0: self.block(sample)}
        for node in range((1 << depth) - 1):
            own = rows.pop(node, None)
            if own is None or own.size < 16:
                continue
            best = None
            for point in rng.choice(own, 8):
                shares = np.bincount(np.bitwise_count(own ^ point), minlength=bits + 1) / own.size
                below = np.cumsum(shares)
                # An even split whose shell few queries straddle.
                for shell in np.flatnonzero((below >= 0.25) & (below <= 0.75)):
                    cost = shares[max(0, shell - radius + 1) : shell + radius + 1].sum() + abs(below[shell] - 0.5)
                    if best is None or cost < best[0]:
                        best = cost, point, shell
            if best is None:
                continue
            self.points[node], self.shells[node] = best[1], best[2]
            inside = np.bitwise_count(own ^ best[1]) <= best[2]
            rows[2 * node + 1], rows[2 * node + 2] = own[inside], own[~inside]

    def block(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> np.uint64(self.shift)) & np.uint64(self.mask)

    def home(self, fps: np.ndarray) -> np.ndarray:
        """The shard that holds each fingerprint."""
        values, node = self.block(fps), np.zeros(fps.size, np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.bitwise_count(values ^ self.points[node]) > self.shells[node])
        return node - ((1 << self.depth) - 1)

    def visits(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, shard)`` for every shard that a ball around a fingerprint reaches."""
        values, rows, node = self.block(fps), np.arange(fps.size), np.zeros(fps.size, np.int64)
        for _ in range(self.depth):
            far = np.bitwise_count(values[rows] ^ self.points[node]).astype(np.int64)
            inner, outer = far - self.radius <= self.shells[node], far + self.radius > self.shells[node]
            rows, node = np.concatenate([rows[inner], rows[outer]]), np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
        return rows, node - ((1 << self.depth) - 1)


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the sets of ``a[i]`` and ``b[i]``; ``parent`` holds each row's root before and after."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def shard_links(fps: np.ndarray, home: np.ndarray, distance: int, blocks: int, block: int, leaf: int = 256, seed: int = 1, radius: int | None = None) -> np.ndarray:
    """Parent of each row in a spanning forest of the links in one shard of the tree over ``block``.

    ``fps`` has a fingerprint for each row, or several, each of them a row of its own;
    ``distance`` is that of all together, ``blocks`` the blocks of each.

    Links join a row to a home row within ``distance`` bits. A local
    vantage-point search on the shard's block halves the home rows until
    ``leaf`` are left. Home rows that it cannot part, since they agree in the
    block, are searched on: of the other blocks one has to be near too, so a
    search on each of them finds every pair. Whole fingerprints are compared at the leaves.
    A given ``radius`` takes the place of ``distance // blocks``, and one bit more that of the other blocks.
    """
    width = BITS // blocks
    words = np.atleast_2d(fps)
    values = [(word >> np.uint64(width * k)) & np.uint64((1 << width) - 1) for word in words for k in range(blocks)]
    reach = [distance // max(1, len(values) - 1), distance // len(values)] if radius is None else [radius + 1, radius]
    parent = np.arange(words.shape[1])
    rng = np.random.default_rng(seed)
    stack = [(np.arange(parent.size), np.flatnonzero(home), block, True)]
    while stack:
        queries, points, k, first = stack.pop()
        if not points.size or not queries.size:
            continue
        if points.size > leaf:
            radius = reach[first]
            at = values[k][points[rng.integers(points.size)]]
            far = np.bitwise_count(values[k][points] ^ at).astype(np.int64)
            shell = int(np.partition(far, far.size // 2)[far.size // 2])
            inside = far <= shell
            if inside.all():
                shell -= 1
                inside = far <= shell
            if inside.any():
                away = np.bitwise_count(values[k][queries] ^ at).astype(np.int64)
                stack.append((queries[away - radius <= shell], points[inside], k, first))
                stack.append((queries[away + radius > shell], points[~inside], k, first))
                continue
            if first and len(values) > 1 and far.max() == 0:
                near = queries[np.bitwise_count(values[k][queries] ^ at) <= radius]
                stack.extend((near, points, other, False) for other in range(len(values)) if other != block)
                continue
        step = max(1, (1 << 21) // points.size)
        for at in range(0, queries.size, step):
            some = queries[at : at + step]
            q, p = np.nonzero(sum(np.bitwise_count(word[some][:, None] ^ word[points][None, :]) for word in words) <= distance)
            hook(parent, some[q], points[p])
    return parent


def near_links(distinct: DataFrame, distance: int = 4, blocks: int = 4, shard_rows: int = 20_000, sample_rows: int = 8192, fps: tuple[str, ...] = ("fp",), radius: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the fingerprints within ``distance`` bits, from distinct ``(node, fp)``.

    With several columns ``fps``, each is parted into ``blocks``, and ``distance`` is that of all together. A
    ``radius`` less than ``distance // blocks`` of them all sends a fingerprint to fewer shards; links are
    then those of fingerprints that are besides so near in some block, and, where too many agree in it, within
    one bit more in another.

    They are spanning forests of all links, shard by shard: as many components
    as all links have, but never the pairs of a dense group. There are as many
    shards as make ``shard_rows`` home rows each, up to one for each value of a block;
    a fingerprint then visits the values within the radius, 17 at four blocks
    of 16 bits, however many fingerprints there are. The trees are
    built from a sample bounded by ``sample_rows`` and by 32 a shard, which sets how even the shards are, never
    what is found. A shard with more than ``shard_rows`` home rows, or four
    times as many queries, is cut into cells of (part of the queries, part of
    the home rows), so that no task holds more, whatever the data.
    """
    spark = distinct.sparkSession
    width = BITS // blocks
    n = distinct.count()
    depth = 0
    while n > shard_rows << depth and depth < width:
        depth += 1
    taken = distinct.select(*fps).orderBy(F.xxhash64("node")).limit(max(sample_rows, 32 << depth)).toArrow()
    samples = [taken.column(c).to_numpy().view(np.uint64) for c in fps]
    near = distance // (blocks * len(fps)) if radius is None else radius
    trees = [BlockTree(samples[w], width * k, width, near, depth, seed=w * blocks + k + 1) for w in range(len(fps)) for k in range(blocks)]
    sent = spark.sparkContext.broadcast(trees)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in fps]
            for k, tree in enumerate(sent.value):
                own = tree.home(words[k // blocks])
                rows, shard = tree.visits(words[k // blocks])
                # Of two shards, the rows of the later one do the visiting.
                rows, shard = rows[shard <= own[rows]], shard[shard <= own[rows]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.size, k, np.int32)), pa.array(shard.astype(np.int32)), pa.array(shard == own[rows]), *(c.take(pa.array(rows)) for c in batch.columns)], names=["block", "shard", "home", "node", *fps])

    routed = staged(distinct.select("node", *fps).mapInArrow(route, ", ".join(["block int, shard int, home boolean, node long", *(f"{c} long" for c in fps)])), "routed")
    cells = routed.groupBy("block", "shard").agg(
        F.ceil(F.count_if("home") / shard_rows).cast("int").alias("home_cells"), F.ceil(F.count("*") / (4 * shard_rows)).cast("int").alias("query_cells")
    )
    cell = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    sized = routed.join(cells, ["block", "shard"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = sized.select("block", "shard", "node", *fps, F.lit(False).alias("home"), cell("query_cells", 1).alias("q"), every("home_cells").alias("h"))
    homes = sized.where("home").select("block", "shard", "node", *fps, F.lit(True).alias("home"), cell("home_cells", 2).alias("h"), every("query_cells").alias("q"))
    rows = queries.unionByName(homes)

    def search(key: tuple, group: pa.Table) -> pa.Table:
        nodes, first, back = np.unique(group.column("node").to_numpy(), return_index=True, return_inverse=True)
        words = np.stack([group.column(c).to_numpy()[first].view(np.uint64) for c in fps])
        home = np.zeros(nodes.size, bool)
        home[back[group.column("home").to_numpy()]] = True
        parent = shard_links(words, home, distance, blocks, key[0].as_py(), radius=radius)
        child = np.flatnonzero(parent != np.arange(nodes.size))
        return pa.table({"a": nodes[child], "b": nodes[parent[child]]})

    links = staged(rows.groupBy("block", "shard", "q", "h").applyInArrow(search, "a long, b long"), "links")
    release(routed)
    return links


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """``(doc_id, fp, component, component_id)``, a row for each row of ``docs``.

    Fingerprints at ``distance`` or fewer differing bits link their documents;
    ``component_id`` is the smallest doc_id that links lead to, the document's
    own included. Copies share a fingerprint and are searched once; a group of
    copies is combined before the shuffle and rejoined by fingerprint.

    Null and empty texts have fingerprint zero and link like any other; a null
    doc_id is never a component's smallest, unless the component has no other;
    repeated rows get a row each; an empty table gives no rows; further columns
    are ignored.
    """
    prints = staged(fingerprints(docs, words), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.col("fp")), "distinct")
    links = near_links(distinct, distance)
    classes = components_of(distinct, links).select("fp", "component", "component_id")
    release(distinct, links)
    return prints.join(classes, "fp").select("doc_id", "fp", "component", "component_id")


def components_of(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """``distinct (node, first_id, ..)`` with the ``component`` that ``links`` make, and the smallest first_id in it; staged."""
    members = staged(distinct.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node")), "members")
    # A plain table, so that the join can split a component that very many nodes share.
    smallest = staged(members.groupBy("component").agg(F.min("first_id").alias("component_id")), "smallest")
    out = staged(members.join(smallest, "component"), "classes")
    release(members, smallest)
    return out


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
