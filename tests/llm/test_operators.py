"""Operators against brute force, and on rows that are out of the ordinary."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontamination, language_id, line_dedup, mixing, near_texts, prefix_hash, quality, simhash, suffix_dedup, token_counts, url_filter
from gridloom.llm.graph import connected_components

#: Names that operators use inside.
CLASHES = tuple(
    "score fingerprint fp size taken key bucket group spans digest place guest n value component label anchor in_0 in_1 own_id own_key lost_id lost_key list_id list_key text_key node row "
    "none below hash turn earlier inside offset plan target source_size keep_0 keep_1 draw kind low high kinds x first last unit_no unit_start unit_end h1 h2 start number opens removed whole "
    "classes least stray family cells sub hashes first_id component_id fp0 tokenizer n_tokens n_bytes over_limit range_no caps ws cap w whole_text lang_pred item_id question_overlap "
    "doc text1 shard home block until spot core hull alone s_id s_key r_id r_key ranges mix_taken".split()
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * (5 - len(r)), *["clash"] * len(CLASHES)) if len(r) == 5 else (r[0], r[1], r[2], r[3], None, *["clash"] * len(CLASHES)) for r in rows], SCHEMA)


ROWS = [
    (1, prose(1, 120), "en", "a"), (2, prose(1, 120), "en", "a"), (2, prose(1, 120), "en", "a"), (3, prose(1, 119) + " changed", "en", None),
    (4, "", "en", "b"), (5, None, None, "b"), (None, prose(2, 80), "de", None), (6, " \n\t ", "fr", "c"), (7, "ab", "en", "c"),
    (8, "word " * 60_000, "en", "a"), (9, "Été \U0001f600 " * 30, "fr", "b"), (10, prose(3, 300), None, "a"), (11, "a" * 900, "de", "d"),
    (12, "<|endoftext|> and <|endoftext|>", "en", "d"), (-5, prose(4, 50) + "\n" + prose(5, 40) + "\n" + prose(5, 40), "de", "a"), (13, "0123 !!! ???", None, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1] or "") for r in ROWS]


def test_token_counts(spark, docs, none, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, cache = P.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    want = collections.Counter((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts())
    for _ in range(2):  # the second time all counts come from the cache
        got = token_counts.token_counts(docs, path, cache).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
        assert spark.read.parquet(cache).count() == len({t for _, t in texts()})
    assert token_counts.token_counts(none, path, cache=str(tmp_path / "other")).count() == 0


def test_token_counts_of_all_libraries(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    some = ["Plain words, 12 of them.", "über 中文 \U0001f600", "", "tabs\t and   spaces \n\n end ", "İstanbul ʰ ͅx"]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    r = random.Random(12)
    odd = ["".join(r.choice("ab'sA \n\t.,1\u00e9\u4e2d") + r.choice(["", " ", "<|endoftext|>"] if r.random() < 0.2 else [""]) for _ in range(3000)) for _ in range(20)]
    long = [" " * 2_000_000 + "x", "a" * 1_000_000, " ".join(prose(k, 2000) for k in range(40))]
    monkeypatch.setattr(token_counts, "BLOCK", 50)
    model = token_counts.Counter(P.path("byte_bpe_50k.json"))
    assert model.parts and model.counts(some + odd + long) == [whole(t) for t in some + odd + long]
    assert all("".join(token_counts.blocks(t, 50)) == t for t in some + odd)
    words = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    other = token_counts.Counter(P.path("word_bpe_49k.json"))
    assert not other.parts and other.counts(some + odd) == [len(words.encode(t, add_special_tokens=False).ids) for t in some + odd]
    pieces = token_counts.Counter(P.path("piece_bpe_32k.model"))
    own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert pieces.counts(some) == [len(own.encode(t)) for t in some]


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    again = mixing.mix(docs.repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    size = lambda t: len((t or "").encode().split())
    totals = collections.Counter()
    for r in ROWS:
        totals[r[3]] += size(r[1])
    order = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(totals.values()), set(order)
    while True:
        share = left / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if share * weight[s] >= 2 * totals[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * totals[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: share * weight[s] for s in open_}
    taken = collections.Counter()
    for r in mixing.mix(docs.withColumn("of", F.col("source")), keep=("of",)).collect():
        assert r.size <= r.source_size == totals[r.of] and r.target == pytest.approx(target[r.of]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.of] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    assert mixing.mix(none).count() == 0


def test_prefix_hashes_answer_spans():
    r = random.Random(5)
    text = "".join(r.choice("ab") for _ in range(400))
    p = prefix_hash.PrefixHash(prefix_hash.code_points(text))
    q = prefix_hash.PrefixHash(prefix_hash.code_points(text[100:] + "c"))
    for _ in range(300):
        i, j = r.randrange(400), r.randrange(301)
        n = r.randint(0, min(400 - i, 301 - j))
        assert p.equal(i, q, j, n) == (text[i : i + n] == (text[100:] + "c")[j : j + n])
        k = 0
        while i + k < 400 and j + k < 301 and text[i + k] == (text[100:] + "c")[j + k]:
            k += 1
        assert p.extension(i, q, j) == k


def plain_print(text: str) -> str:
    """The fingerprint by its definition, span by span, without prefix sums."""
    codes = [ord(c) + 1 for c in text]
    (p, b), (q, c) = zip(prefix_hash.PRIMES, prefix_hash.BASES, strict=True)
    whole = "".join(f"{sum(x * pow(base, k, prime) for k, x in enumerate(codes)) % prime:08x}" for prime, base in ((p, b), (q, c)))
    if len(codes) >= 12:
        hashes = {sum(x * pow(b, k, p) for k, x in enumerate(codes[i : i + 12])) % p for i in range(len(codes) - 11)}
    else:
        raw = b"".join((x - 1).to_bytes(4, "little") for x in codes)
        hashes = {int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest(), "big")} if codes else set()
    mixed = []
    for h in hashes:
        x = h * 0x9E3779B97F4A7C15 % 2**64
        mixed.append((x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64)
    return f"{len(codes):x}-{whole}-" + "".join(f"{x >> 32:08x}" for x in sorted(mixed)[:64])


def plain_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = ({s[k : k + 8] for k in range(0, len(s), 8)} for s in (a.rsplit("-", 1)[1], b.rsplit("-", 1)[1]))
    least = sorted(x | y)[:64]
    return sum(s in x and s in y for s in least) / len(least) if x and y else 0.0


def test_fingerprints(spark, docs, none):
    same = [(2, ROWS[1][1], "en", "a")] * 30 + [(None, "the same text without an id, again and again", "en", "a")] * 90 + [(7, "another text of that id", "en", "a"), (7, "ab", "fr", "a")]
    rare = docs.where("doc_id <> 8 OR doc_id IS NULL")
    for table in (rare, rare.unionByName(frame(spark, same))):
        keyed = table.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
        rows = [(r.doc_id, r.text) for r in sorted(keyed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))]
        want = collections.Counter()
        for k, (i, t) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            h = len(t) // 2
            e = t[: len(t) - h] + after[:h]
            a, b, c = map(plain_print, (t, e, after))
            want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c)] += 1
        for partitions in (1, 3, 8, 40):
            got = prefix_hash.document_fingerprints(table, partitions).drop("common_prefix_next").collect()
            assert collections.Counter(map(tuple, got)) == want
    assert prefix_hash.document_fingerprints(none, 3).count() == 0
    one = prefix_hash.document_fingerprints(docs.where("doc_id = 1"), 3).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert prefix_hash.Document("word " * 60_000).print == prefix_hash.Document("word " * 60_000).print


def edited(text: str, seed: int) -> str:
    """A copy with a few characters replaced, inserted or left out."""
    r = random.Random(seed)
    for _ in range(r.randint(1, 3)):
        at = r.randrange(len(text))
        text = text[:at] + r.choice(["", "#", "##" + text[at]]) + text[at + 1 :]
    return text


@pytest.mark.parametrize("widths", [(24, 4, 1), (48, 1)])
def test_suffix_dedup(spark, docs, none, monkeypatch, widths):
    monkeypatch.setattr(suffix_dedup, "WIDTHS", widths)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    shared = prose(77, 60)
    more = frame(spark, [(100 + i, prose(200 + i, 30) + " " + shared[i * 7 :] + prose(300 + i, 20), "en", "a") for i in range(6)]).unionByName(docs.where("doc_id <> 8 OR doc_id IS NULL"))
    periodic = [("abc" * 400, 120), ("=" * 300 + "x" + "=" * 400, 121), (prose(600, 20) + "-+" * 150 + prose(601, 30), 122), (prose(602, 9)[:40] * 30 + prose(603, 40), 123), ("=" * 230, 124)]
    more = more.unionByName(frame(spark, [(i, t, "en", "a") for t, i in periodic] + [(200 + i, edited(prose(700, 90), i), "en", "a") for i in range(40)]))
    rows = [(r.doc_id, (r.text or "").encode()) for r in more.select("doc_id", "text").collect()]
    n = suffix_dedup.LENGTH
    counts = collections.Counter(b[i : i + n] for _, b in rows for i in range(len(b) - n + 1))
    want = collections.Counter()
    for k, b in rows:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - n + 1):
            if counts[b[i : i + n]] > 1:
                gone[i + 1 : i + n + 1] = True
        kept = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        want[k, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.remove_repeats(more, with_text=True).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert sum(w * k[2] for k, w in want.items()) > 2000
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(e - s for s, e in zip(r.starts, r.ends, strict=True)) == r.n_removed for r in got)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_line_dedup(spark, docs, none):
    line = "this very line is found in more than one place"
    more = docs.unionByName(frame(spark, [(20, f"{line}\nown words of the first text here\n{line}.", "en", "a"), (21, f"before it. {line.upper()}  \nshort line", "en", "a"), (22, "short line", "en", "a")]))
    for unit in line_dedup.UNITS:
        seen: dict[str, tuple] = {}
        want = collections.Counter()
        rows = {(r.doc_id, r.text or "") for r in more.select("doc_id", "text").collect()}
        ranked = sorted(((i is not None, i or 0, k, i, t, a, b, piece) for i, t in rows for k, a, b, piece in line_dedup.units(t, unit, 5)), key=lambda x: (*x[:3], x[6]))
        for _, _, k, i, _, a, b, piece in ranked:
            if piece in seen:
                want[i, k, a, b, *seen[piece]] += 1
            seen.setdefault(piece, (i, k))
        got = collections.Counter(tuple(r)[:6] for r in line_dedup.repeated_units(more, unit, 5).distinct().collect())
        assert got == want
        assert all("".join(m[0] for m in line_dedup.UNITS[unit].finditer(t)) == t for _, t in rows)
    kept = line_dedup.deduplicated(more, min_words=5, spans="cut")
    assert kept.columns == [*more.columns, "cut"] and kept.count() == more.count()
    assert kept.where("doc_id = 21").first().text == "before it.\nshort line"
    cut = {(r.doc_id, r.text): r.cut for r in kept.where("cut IS NOT NULL").collect()}
    whole = {r.doc_id: r.text for r in more.collect()}
    assert cut and all("".join(t.split()) == "".join("".join(whole[i][a:b] for a, b in zip([0, *(x.end for x in c)], [*(x.start for x in c), None], strict=True)).split()) for (i, t), c in cut.items() if i is not None and i != 2)
    assert line_dedup.cut_out("a\nbc\nd", [(2, 5)]) == "a\nd" and line_dedup.cut_out("a bc\nd", [(2, 5)]) == "a \nd"
    assert line_dedup.repeated_units(none).count() == 0 and line_dedup.deduplicated(none).count() == 0


def brute_components(prints, near):
    u = sorted(set(prints))
    parent = {x: x for x in u}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(u):
        for y in u[:i]:
            if near(x, y):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in u}


def test_simhash(spark, docs, none):
    import xxhash

    def bits(text: str) -> int:
        """The contract, word by word and bit by bit."""
        found = [w for w in re.split("[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
        hashes = [xxhash.xxh64_intdigest(" ".join(found[k : k + 4]).encode(), 42) for k in range(max(1, len(found) - 3))] if found else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    assert simhash.fingerprint(b"A b\x0bC\x1c d E") != 0 and simhash.fingerprint(b"") == 0
    more = docs.unionByName(frame(spark, [(30 + i, prose(9, 400) + f" v{i}", "en", "a") for i in range(12)]))
    rows = [(r.doc_id, bits(r.text or "")) for r in more.select("doc_id", "text").collect()]
    label = brute_components([p for _, p in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    least: dict[int, int] = {}
    for i, p in rows:
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    got = simhash.near_duplicates(more).collect()
    assert collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == collections.Counter((i, p, least.get(label[p])) for i, p in rows)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("distance", "leaf"), [(4, 256), (4, 2), (7, 256), (7, 4), (11, 256)])
def test_vantage_point_trees_find_every_pair(spark, distance, leaf, monkeypatch):
    import functools

    monkeypatch.setattr(simhash, "shard_links", functools.partial(simhash.shard_links, leaf=leaf))
    r = random.Random(distance)
    base = [r.getrandbits(64) for _ in range(300)]
    prints = set(base)
    # Many that agree in the first block, which a search on it cannot part.
    base += [base[0] & 0xFFFF | r.getrandbits(48) << 16 for _ in range(60)]
    prints |= set(base)
    for x in base[:150] + base[-60:]:
        y = x
        for b in r.sample(range(64), r.randint(1, 13)):
            y ^= 1 << b
        prints.add(y)
    label = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= distance)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    distinct = spark.createDataFrame(signed, "fp long").withColumn("node", F.col("fp"))
    # Small shards make deep trees, and cells within shards.
    links = simhash.near_links(distinct, distance, shard_rows=40).collect()
    found = {p: p for p in prints}
    pairs = [(x.a % 2**64, x.b % 2**64) for x in links]
    assert all((a ^ b).bit_count() <= distance * 64 for a, b in pairs)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(found[a], found[b])
            if found[a] != low or found[b] != low:
                found[a] = found[b] = low
                changed = True
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(found) == groups(label)


def test_near_deduplicated(spark, docs, none):
    kept = near_texts.near_deduplicated(docs)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect())
    assert kept.columns == docs.columns
    assert (False, 1) in ids and (False, 2) not in ids and (False, 3) not in ids and (True, 0) in ids
    assert near_texts.near_deduplicated(none).count() == 0


def test_connected_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (300, None)] + [(400, x) for x in range(401, 440)] + [(r.randint(500, 600), r.randint(500, 600)) for _ in range(60)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    full = [(a, b) for a, b in edges if b is not None]
    label = {n: n for e in full for n in e}
    for _ in range(100):
        for a, b in full:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


ITEMS = [(0, "Where does the river run dry? It runs dry below the old mill at the end of summer."), (1, prose(50, 40)), (None, prose(51, 25)), (3, ""), (4, None), (5, "short item")]


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    leak = frame(spark, [(40, prose(60, 200) + " " + ITEMS[0][1].upper() + " " + prose(61, 90), "en", "a"), (41, ITEMS[1][1], "en", "a"), (42, prose(62, 30) + ITEMS[2][1][:60], "en", "a"), (43, prose(63, 500) + "\n" + ITEMS[2][1], "en", "a")])
    more = docs.unionByName(leak)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(more, bench).collect()}
    assert got == {(40, 0), (41, 1), (43, None)}
    kept = decontamination.decontaminated(more, bench)
    assert kept.columns == more.columns and kept.count() == more.count() - 3
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0
    whole = {(r.doc_id, r.item_id, round(r.score, 9)) for r in decontamination.contaminated(more, bench).collect()}
    several = list(decontamination.indexes(bench, index_chars=100))
    assert len(several) > 1
    again = {(r[0], ix.items[k][0], round(hit[0], 9)) for ix in several for r in more.select("doc_id", "text").collect() for k, hit in ix.matches(r.text or "").items()}
    assert again == whole


def scanned(texts: list[tuple[int, str]], items: list[tuple[int, str]]) -> dict[tuple[int, int], float]:
    """Every item against every passage of every text, without an index: BM25 of the item's words, then its halves' shingles."""
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    kept = [(i, t, split(t)) for i, t in items if split(t)]
    n, mean = len(kept), sum(len(w) for *_, w in kept) / len(kept)
    df = collections.Counter(x for *_, w in kept for x in set(w))
    longest = max(len(w) for *_, w in kept)

    def parts(t):
        m = re.search(r"[.?!\n]\s*", t)
        q, r = (split(t[: m.end()]), split(t[m.end() :])) if m else (split(t), [])
        return q or r, r or q

    def grams(w, k):
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}

    found = {}
    for doc_id, text in texts:
        words = split(text)
        for at in range(0, max(1, len(words) - longest), longest):
            passage = words[at : at + 2 * longest]
            own = set(passage)
            for i, t, w in kept:
                counts = collections.Counter(w)
                weight = {x: np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, c in counts.items()}
                score = sum(v for x, v in weight.items() if x in own) / sum(weight.values())
                if score < 0.6 - 1e-9:
                    continue
                held = [(len(grams(h, min(5, len(h))) & grams(passage, min(5, len(h)))), len(grams(h, min(5, len(h))))) for h in parts(t)]
                if min(a / b for a, b in held) >= 0.5 and sum(a for a, _ in held) >= 0.8 * sum(b for _, b in held):
                    found[doc_id, i] = max(found.get((doc_id, i), 0.0), score)
    return found


def test_decontamination_finds_what_a_scan_finds(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)  # many blocks a text
    r = random.Random(17)
    vocabulary = [f"w{k}" for k in range(160)]
    sentence = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(k, sentence(r.randint(3, 20)) + r.choice(["? ", ". ", "\n", " "]) + sentence(r.randint(2, 25))) for k in range(60)]
    texts = []
    for d in range(140):
        body = []
        for _ in range(r.randint(0, 4)):
            body += sentence(r.randint(0, 120)).split()
            own = r.choice(items)[1].replace("\n", " ").split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):  # words changed, on both sides of the thresholds
                own[r.randrange(len(own))] = r.choice(vocabulary).upper()
            body += own
        texts.append((d, " ".join(body) + sentence(r.randint(0, 60))))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items + [(99, None), (98, "?!")], "item_id long, text string")
    want = scanned(texts, items)
    got = {(x.doc_id, x.item_id): x.score for x in decontamination.contaminated(docs, bench).collect()}
    assert got.keys() == want.keys() and len(want) > 60
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert decontamination.decontaminated(docs, bench).count() == len(texts) - len({d for d, _ in want})


def test_wand_finds_all_above_threshold():
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(3, 30)))) for k in range(300)]
    frequency = collections.Counter(t for _, x in items for t in set(decontamination.words(x)))
    index = decontamination.Index(items, frequency, len(items), sum(len(x.split()) for _, x in items) / len(items))
    for _ in range(60):
        terms = {index.ids[t] for t in r.choices(vocabulary, k=25) if t in index.ids}
        scores = collections.Counter()
        for t in terms:
            for k, w in zip(*index.lists[t][:2], strict=True):
                scores[k] += w
        for threshold in (0.2, 0.5, 0.8):
            assert {k for k, _ in index.search(terms, threshold)} == {k for k, v in scores.items() if v >= threshold - 1e-9}


def test_language_id(spark, docs, none):
    words = {"en": "the and of that with from this have", "de": "der und die nicht auf eine werden schön", "fr": "le et les dans pour été être où"}
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(words[lang].split(), k=30)), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 60)]
    all_rows = frame(spark, rows)
    model = language_id.train(language_id.eligible(all_rows), sample_rows=30)
    got = {x.doc_id: x for x in language_id.identified(all_rows, model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].lang_pred == rows[i][2] for i in held) and all(0 <= x.score <= 1 for x in got.values())
    assert np.count_nonzero(model.weights == 0) > model.weights.size / 4  # the penalty leaves zeros
    odd = language_id.identified(docs, model).collect()
    assert len(odd) == len(ROWS)
    assert {x.doc_id for x in odd if x.lang_pred == "und"} >= {4, 5, 6, 13} and all(x.score == 0 for x in odd if x.lang_pred == "und")
    assert language_id.accepted(docs, model, 0.0).columns == docs.columns
    nothing = language_id.train(none)
    assert {x.lang_pred for x in language_id.identified(docs, nothing).collect()} == {"und"} and language_id.identified(none, nothing).count() == 0


def test_ngram_blocks(monkeypatch):
    text = prose(8, 300)
    whole = language_id.ngram_counts(text)
    monkeypatch.setattr(language_id, "BLOCK", 97)
    assert (language_id.ngram_counts(text) == whole).all()


def test_quality(spark, docs, none):
    r = random.Random(6)
    good = lambda i: prose(1000 + i, r.randint(40, 90))
    bad = lambda i: " ".join(w.upper() + "$$!!" for w in prose(5000 + i, 50).split())
    kinds = [i % 5 != 0 for i in range(900)]
    rows = frame(spark, [(i, good(i) if k else bad(i), "en", "a") for i, k in enumerate(kinds)])
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(kinds) if i % 2] + [(None, 1)], "doc_id long, quality int")
    model = quality.train(rows, labels, positives=250, unlabelled=400)
    assert 0.65 <= model.prior <= 0.95
    got = {x.doc_id: x.score for x in quality.scored(rows, model).collect()}
    assert np.mean([(got[i] >= 0.5) == k for i, k in enumerate(kinds)]) > 0.97
    odd = quality.scored(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= x.score <= 1 for x in odd)
    assert {x.score for x in quality.scored(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.scored(none, model).count() == 0 and quality.train(none, labels).prior == 0.5


def test_url_filter(spark):
    rows = [
        (1, "https://a.example.org/x", '<link rel="canonical" href="http://b.net/y">'), (2, "http://c.example.org/q", '<meta http-equiv="refresh" content="0; url=https://a.example.org/x#z">'),
        (3, "https://d.example.org/", None), (4, None, None), (5, "nourl", ""), (6, "HTTP://B.NET/y?", ""), (7, "https://e.example.org", "<link href=/fr/1 rel=canonical>"),
        (8, "https://e.example.org/fr/1", '<link rel=canonical href="//b.net/z">'), (9, "https://q.net", ""), (10, "https://x.example.net/en/1", ""), (None, "https://example.com/de/", ""), (3, "https://d.example.org/", None),
    ]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, node string")
    got = collections.Counter((r.page_id, r.rule, r.verdict) for r in url_filter.filtered(pages).collect())
    assert got == collections.Counter(
        [(1, None, "block"), (2, None, "block"), (3, None, "allow"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (6, "net/", "block"), (7, None, "allow"), (8, "org/fr/", "allow"), (9, None, "allow"), (10, "example.net/en/", "allow"), (None, "example.com/de/", "block")]
    )
    redirects = spark.createDataFrame([("https://d.example.org/", "https://k.net/"), (None, "x")], "source string, target string")
    assert {r.verdict for r in url_filter.filtered(pages, redirects).where("page_id = 3").collect()} == {"block"}
    assert url_filter.filtered(pages.limit(0)).count() == 0


def test_url_filter_follows_links_as_its_sql_does(spark):
    """Pages whose links make chains, hubs and rings, against union-find and against the SQL."""
    import duckdb

    r = random.Random(31)
    hosts = ["a.example.net", "b.example.com", "c.org", "d.example.org", "e.test", "f.test", "G.Test", "h.example.com", "i.co.org"]
    sections = ["/en/", "/de/", "/fr/", "/x/", "/x/y/", "/"]
    urls = [f"https://{r.choice(hosts)}{r.choice(sections)}{k}" for k in range(160)]
    kinds = [
        lambda u, v: f'<link href="{v}" rel="canonical">', lambda u, v: f"<LINK REL='alternate canonical' data-x=1 HREF='{v.replace('https', 'http')}#part'>", lambda u, v: f"<link rel=canonical href={v}>",
        lambda u, v: f'<meta content="0; URL={v}" http-equiv="Refresh">', lambda u, v: "<link rel='canonical' href='" + v.split(":", 1)[1] + "'/>", lambda u, v: '<link rel="canonical" href="../' + v.rsplit("/", 1)[1] + '">',
        lambda u, v: '<link rel="canonical" href="/q/./' + v.rsplit("/", 1)[1] + '/../z">', lambda u, v: '<link rel="stylesheet" href="' + v + '">', lambda u, v: '<meta name="refresh" content="5; url=' + v + '">', lambda u, v: '<link rel="canonical" href="mailto:x@y">',
        lambda u, v: f'<link rel="canonical" href="{v}?a=1&amp;b=2"><link rel="canonical" href="{v}"> text <meta http-equiv=refresh content="3,url={urls[0]}">',
    ]
    rows = [(k, u, "<html>" + (r.choice(kinds)(u, r.choice(urls)) if r.random() < 0.7 else "")) for k, u in enumerate(urls)] + [(900, None, None), (901, "no url", "<link rel=canonical href=https://c.org/fr/1>"), (902, urls[3], None), (903, "https://K.test", "<link rel=canonical href='fr/../de/./'>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter(tuple(x) for x in url_filter.filtered(pages).drop("component").collect())
    con = duckdb.connect()
    frame_ = pages.toPandas()
    con.register("pages", frame_)
    want = collections.Counter(con.execute(url_filter.OP2_SQL).fetchall())
    assert got == want
    links = {tuple(x) for x in url_filter.page_links(pages).collect()}
    assert len(links) > 80 and ("k.test/", "k.test/de/") in links and any(b.endswith("/z") for _, b in links)
    label = {n: n for e in links for n in e}
    for _ in range(60):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    part = {x.page_id: x.component for x in url_filter.filtered(pages).select("page_id", "component").collect()}
    node = {x.page_id: x.n for x in pages.select("page_id", url_filter.node_of(F.col("url")).alias("n")).collect()}
    assert all(part[i] == label.get(n) for i, n in node.items())
    assert sum(v for (_, _, _, rule, verdict), v in got.items() if rule is None and verdict == "block") >= 3


def shingle_sets(text: str) -> frozenset:
    found = [w for w in re.split("[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    return frozenset(" ".join(found[k : k + 5]) for k in range(max(1, len(found) - 4))) if found else frozenset()


@pytest.mark.parametrize("cell_rows", [512, 4])
def test_near_duplicates_share_eight_tenths_of_their_shingles(spark, cell_rows, monkeypatch):
    import functools

    monkeypatch.setattr(near_texts, "alike_links", functools.partial(near_texts.alike_links, cell_rows=cell_rows))
    monkeypatch.setattr(near_texts, "candidate_links", functools.partial(near_texts.candidate_links, cell_rows=cell_rows))
    r = random.Random(8)
    rows = []
    for k in range(40):  # copies with more and more words replaced, on both sides of 0.8
        own = prose(1000 + k, 300).split()
        rows.append(" ".join(own))
        for n in (3, 6, 7, 8, 10, 14):
            other = list(own)
            for i in r.sample(range(300), n):
                other[i] = f"new{r.random()}"
            rows.append(" ".join(other))
    rows += ["again and again the same few words " * 40 + prose(s, 12) for s in (1, 2, 3)]  # repeats rule the bits, not the set
    for k in range(60):  # short ones, which are alike with one word more at one end
        own = prose(3000 + k, 8 + k % 30)
        rows += [own, own + " more", "else " + own + " more"]
    sets = {i: shingle_sets(t) for i, t in enumerate(rows)}
    label = brute_components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_texts.similar_texts(docs).collect()}
    assert got == label
    assert {x.doc_id for x in near_texts.near_deduplicated(docs).select("doc_id").collect()} == set(label.values())


def test_balls_over_several_fingerprints(spark):
    """Every pair within the radius in some block and within the distance in all is linked, none that is not within the distance."""
    r = random.Random(11)
    base = [r.getrandbits(192) for _ in range(200)]
    prints = set(base)
    for x in base[:150]:
        for n in (12, 25, 35, 47, 52):
            y = x
            for b in r.sample(range(192), n):
                y ^= 1 << b
            prints.add(y)
    own = sorted(prints)
    word = lambda x, k: (x >> 64 * k) % 2**64
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    distinct = spark.createDataFrame([(i, *(signed(word(x, k)) for k in range(3))) for i, x in enumerate(own)], "node long, fp0 long, fp1 long, fp2 long")
    links = simhash.near_links(distinct, 47, shard_rows=60, fps=near_texts.PRINT_NAMES, radius=1)
    got = {x.node: x.component for x in connected_components(links).collect()}
    block = lambda x: min((x >> 16 * k & 0xFFFF).bit_count() for k in range(12))
    sure, label = (brute_components(own, lambda a, b, some=some: (a ^ b).bit_count() <= 47 and (not some or block(a ^ b) <= 1)) for some in (True, False))
    at = {x: got.get(i, i) for i, x in enumerate(own)}
    assert len(set(sure.values())) < len(own) - 300
    assert all(at[x] == at[y] for x, y in sure.items())
    assert all(label[x] == label[own[c]] for x, c in at.items())


def test_near_duplicates_come_from_vantage_point_trees(spark, monkeypatch):
    """Without the classes, which cover what chance puts too far apart, nearly all texts that are alike are still found."""
    r = random.Random(12)
    rows = []
    for k in range(40):
        own = prose(7000 + k, 300).split()
        other = list(own)
        for i in r.sample(range(300), 3 + k % 3):
            other[i] = f"new{r.random()}"
        rows += [" ".join(own), " ".join(other)]
    sets = [shingle_sets(t) for t in rows]
    label = brute_components(list(range(80)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    monkeypatch.setattr(near_texts, "candidate_links", lambda distinct, total: near_texts.staged(spark.createDataFrame([], "a long, b long"), "none"))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_texts.similar_texts(docs).collect()}
    assert len(set(label.values())) == 40 and all(label[i] == label[c] for i, c in got.items())
    assert sum(got[i] != label[i] for i in got) <= 2


def test_classes_find_pairs_at_the_threshold():
    """Of pairs of sets that share just 0.8, hardly any has no class in common, whatever their size."""
    rng = np.random.default_rng(5)
    for n in (5, 6, 9, 14, 23, 24, 40, 47, 48, 95, 96, 191, 400, 1500):
        lost = 0
        for _ in range(300):
            every = rng.integers(0, 2**63, n, np.uint64)
            gone = int(n * 0.2 + 1e-9)
            cut = int(rng.integers(0, gone + 1))
            a, b = np.unique(every[cut:]), np.unique(every[: n - (gone - cut)])
            x, y = near_texts.class_keys([a, b], 0.8)
            lost += not np.intersect1d(x, y).size
        assert lost <= 3, (n, lost)


def test_majorities_of_runs():
    rng = np.random.default_rng(1)
    size = np.array([1, 2, 3, 70_000, 1, 140_000, 5])
    values = rng.integers(0, 2**64, size.sum(), np.uint64)
    begin = np.cumsum(size) - size
    got = near_texts.majorities(values, begin, size)
    assert got.tolist() == [simhash.majority(values[a : a + n]) for a, n in zip(begin, size, strict=True)]


def test_short_units_are_joined(spark):
    passage = " ".join(f"{w}. Not {w} two! So?" for w in (f"w{i}" for i in range(40)))
    chinese = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u3002"
    rows = [(1, "One own start. " + passage + " Own end."), (2, "Other. " + passage + " And the end."), (3, passage), (4, passage), (5, "Yes. No."), (6, "Yes. No."), (7, chinese), (8, "\u524d\u3002" + chinese)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.deduplicated(docs, min_words=5).collect()}
    assert kept[1] == rows[0][1] and kept[2] == "Other. And the end." and kept[3].strip() == kept[4].strip() == ""
    assert kept[5] == kept[6] == "Yes. No." and kept[7] == chinese and kept[8] == "\u524d\u3002"


def test_joined_units_cover_every_passage_of_enough_words():
    r = random.Random(3)
    for _ in range(200):
        text = "".join(" ".join(r.choice("abc") for _ in range(r.randint(0, 7))) + r.choice([". ", "!", "\n", "\n\n"]) for _ in range(r.randint(1, 12)))
        found = list(line_dedup.units(text, "sentence", 5))
        # The shortest run from each unit on and up to each unit, tried one by one.
        parts = [(m.start(), m.end(), len(m[0].split())) for m in line_dedup.UNITS["sentence"].finditer(text) if m[0].strip()]
        long = lambda a, b: sum(n for *_, n in parts[a:b]) >= 5
        ends = {(a, min(b for b in range(len(parts) + 1) if long(a, b))) for a in range(len(parts)) if long(a, len(parts))} | {(max(a for a in range(b) if long(a, b)), b) for b in range(1, len(parts) + 1) if long(0, b)}
        assert {(a, b) for _, a, b, _ in found} == {(parts[a][0], parts[b - 1][1]) for a, b in ends}
        assert all(x[1] <= y[1] and x[2] <= y[2] for x, y in zip(found, found[1:]))
        covered = {i for _, a, b, _ in found for i in range(a, b)}
        enough = sum(line_dedup.word_count(line_dedup.normalised(m[0])) for m in line_dedup.UNITS["sentence"].finditer(text)) >= 5
        assert (not enough) or all(i in covered for i, c in enumerate(text) if c in "abc")


def test_very_long_texts(spark):
    """One text of each kind that made an operator fail or fill its memory."""
    P = pytest.importorskip("public_tokenizers")
    words = prose(71, 4000)
    many = " ".join(words.split()[k % 4000][::-1] if k % 7 else f"w{k}" for k in range(400_000))
    every = many.split()
    texts = {1: "=" * 3_000_000, 2: " " * 2_000_000 + "x", 3: many, 4: "ab. " * 500_000, 5: "\n" * 1_000_000, 6: "one line\n" * 200_000}
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").repartition(3)
    items = spark.createDataFrame([(k, " ".join(every[k * 1900 : k * 1900 + 45])) for k in range(200)] + [(900, prose(72, 40))], "item_id long, text string")
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert found[1].n_removed == 3_000_000 and found[1].n_spans == 1 and found[4].n_removed == 2_000_000 and found[5].n_removed == 1_000_000 and found[2].n_removed == 2_000_000
    assert len(found[3].starts) < 1000
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).where("doc_id = 2").collect()} == {2: 2_000_000}
    assert {r.doc_id for r in decontamination.contaminated(docs, items).collect()} == {3}
    assert decontamination.contaminated(docs, items).count() == 200
    assert language_id.identified(docs, language_id.train(docs)).count() == 6
    model = quality.train(docs, spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, model).collect())
    assert prefix_hash.document_fingerprints(docs, 3).count() == 6
    kept = {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()}
    assert len(kept[4]) < 1000 and len(kept[6]) < 1000 and kept[1] == texts[1] and kept[5] == texts[5]
    assert simhash.near_duplicates(docs).count() == 6 and near_texts.near_deduplicated(docs).count() == 6
    assert sum(r.taken for r in mixing.mix(docs).collect()) == round(1.5 * sum(len(t.split()) for t in texts.values()))


def test_one_id_of_very_many_rows(spark):
    """What the fits collect is bounded by rows, not ids; a hot or null id neither fills the sample nor is all of it."""
    rows = [(5, "again and again the same row", "en", "s")] * 3000 + [(None, f"no id {prose(k, 6)}", "en" if k % 2 else "de", "s") for k in range(400)] + [(1000 + k, prose(k, 12), "en" if k % 2 else "de", "s") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(5, 1)] + [(1000 + k, 1) for k in range(0, 400, 2)], "doc_id long, quality int")
    seen = []
    fit = quality.fit_pu
    quality.fit_pu = lambda xp, xu, *a: seen.append((len(xp), len(xu))) or fit(xp, xu, *a)
    try:
        quality.train(docs, labels, positives=50, unlabelled=70)
        quality.train(docs, labels, positives=5000, unlabelled=5000)
    finally:
        quality.fit_pu = fit
    assert seen == [(50, 70), (201, 200)]
    assert len(language_id.train(docs, sample_rows=20).languages) == 2
    taken = mixing.mix(docs).collect()
    assert len(taken) == len(rows) and sum(r.taken for r in taken) == round(1.5 * sum(len(t.split()) for _, t, _, _ in rows))
    assert len({r.taken for r in taken if r.doc_id == 5}) <= 3
