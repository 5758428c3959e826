"""Substring deduplication by hashing lines, paragraphs or sentences, short ones together with their neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, sheltered, staged, table

#: Where units end. Pieces cover the text, so their lengths are its offsets.
UNITS = {
    "paragraph": re.compile(r"(?:[^\n]|\n(?!\n))*(?:\n\n+)|(?:[^\n]|\n(?!\n))+"),
    "line": re.compile(r"[^\n]*\n|[^\n]+"),
    "sentence": re.compile("[^.!?\u3002\uFF01\uFF1F\n]*[.!?\u3002\uFF01\uFF1F\n]+|[^.!?\u3002\uFF01\uFF1F\n]+"),
}
#: Words below which units are joined: shorter ones recur by chance, or as turns of phrase. On the documents of sf0.1, 5 words
#: touch 43 % of those that share no passage of 51 words with an earlier one, 13 words touch 10 %; 97 and 96 % of those that do are found.
MIN_WORDS = 13

_UPPER = {c: c + 32 for c in range(65, 91)}
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def normalised(piece: str) -> str:
    """A-Z lower-cased, runs of ASCII white space made one space, ends trimmed."""
    return _SPACE.sub(" ", piece.translate(_UPPER)).strip(" ")


#: Letters of scripts written without spaces: Han and kana; Thai, Lao, Burmese and Khmer.
_IDEOGRAPH = re.compile("[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")
_UNSPACED = re.compile("[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF]")


def word_count(piece: str) -> int:
    """Words of a normalised piece; two ideographs, or four letters of other scripts without spaces, count as one too."""
    n = piece.count(" ") + 1 if piece else 0
    return n if piece.isascii() else max(n, len(_IDEOGRAPH.findall(piece)) // 2 + len(_UNSPACED.findall(piece)) // 4)


def pieces(text: str, unit: str) -> tuple[list[int], list[int], list[int], list[str]]:
    """``(numbers, starts, ends, normalised)`` of a text's units that aren't blank; offsets in code points."""
    numbers, starts, ends, found = [], [], [], []
    for k, m in enumerate(UNITS[unit].finditer(text)):
        if piece := normalised(m[0]):
            numbers.append(k)
            starts.append(m.start())
            ends.append(m.end())
            found.append(piece)
    return numbers, starts, ends, found


def runs(sizes: np.ndarray, min_words: int, join: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """First and last units of the runs of units that have enough words, in order.

    With ``join`` they are the shortest run from each unit onwards and the
    shortest up to each unit, so that every passage of enough words consists of
    such runs wherever it stands; else, single units with enough words.
    """
    if not join:
        alone = np.flatnonzero(sizes >= min_words)
        return alone, alone
    n = sizes.size
    end = np.cumsum(sizes)
    begin = end - sizes
    forwards = np.searchsorted(end, begin + min_words)
    backwards = np.searchsorted(begin, end - min_words, "right") - 1
    places = np.arange(n)
    some, most = forwards < n, backwards >= 0
    both = np.unique(np.concatenate([places[some] * n + forwards[some], backwards[most] * n + places[most]]))
    return both // max(n, 1), both % max(n, 1)


def units(text: str, unit: str, min_words: int, join: bool = True) -> Iterator[tuple[int, int, int, str]]:
    """``(number, start, end, normalised)`` of the runs of units with enough words; those of several units may overlap."""
    numbers, starts, ends, found = pieces(text, unit)
    first, last = runs(np.array([word_count(x) for x in found], np.int64), min_words, join)
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        yield numbers[a], starts[a], ends[b], "\n".join(found[a : b + 1])


#: Odd factors of the two halves of a run's digest, and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(x, -1, 2**64) for x in _BASES)


def run_digests(digests: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """128-bit digests of runs of units, from the units' own: a polynomial in each half, read off prefix sums."""
    out = np.empty((first.size, 2), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(2):
            powers = np.cumprod(np.full(digests.shape[0], _BASES[k], np.uint64))
            back = np.cumprod(np.full(digests.shape[0], _INVERSES[k], np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digests[:, k] * powers)])
            out[:, k] = (sums[last + 1] - sums[first]) * back[first] + (last - first).astype(np.uint64)
    return out


SCHEMA = "doc_id long, text_key long, unit_no int, unit_start int, unit_end int, h1 long, h2 long"


def unit_rows(docs: DataFrame, unit: str, min_words: int, join: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            of, parts = [], []
            for row, text in enumerate(batch.column(2)):
                numbers, starts, ends, found = pieces(text.as_py(), unit)
                first, last = runs(np.array([word_count(x) for x in found], np.int64), min_words, join)
                if first.size:
                    own = np.frombuffer(b"".join(digest(x.encode("utf-8", "surrogatepass")) for x in found), "<u8").reshape(-1, 2)
                    of.append(np.full(first.size, row))
                    parts.append((np.array(numbers, np.int32)[first], np.array(starts, np.int32)[first], np.array(ends, np.int32)[last], run_digests(own, first, last).view(np.int64)))
            if of:
                taken = pa.array(np.concatenate(of))
                numbers, starts, ends, both = (np.concatenate(x) for x in zip(*parts, strict=True))
                columns = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(numbers), pa.array(starts), pa.array(ends), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "unit_no", "unit_start", "unit_end", "h1", "h2"])

    return docs.mapInArrow(run, SCHEMA)


def repeated_units(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, join: bool = True) -> DataFrame:
    """The removed units: ``(doc_id, unit_no, unit_start, unit_end, first_doc_id, first_unit_no, text_key)``.

    Units are normalised and digested (128 bits); digests are grouped over the
    whole corpus, the occurrence with the smallest (doc_id, unit_no) stays, and
    every other one is a row here, with its offsets in the original text.

    The grouping keeps one minimum a digest and is combined before the
    shuffle; the join that follows reads only digests that recur, so a very
    common line is neither gathered nor sorted in one place.

    ``unit`` is ``line``, ``paragraph`` or ``sentence`` (lines cut further at
    ``.``, ``!`` and ``?``, since passages often repeat inside a line). Units below ``min_words`` words are joined with their
    neighbours, before and after, until they have enough (``runs``); without ``join`` they stay.
    Each removed unit's text stays somewhere, where it comes first. Null and empty
    texts have no units; null doc_ids rank first; of several texts with one
    doc_id, the one with the smallest hash does; repeated rows count as one
    document, whose units repeat each other only if the text repeats them; an
    empty table gives no rows; further columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), "text")
    rows = staged(unit_rows(base, unit, min_words, join), "units")
    place = F.struct("doc_id", "unit_no", "text_key", "unit_end")
    firsts = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    firsts = staged(firsts, "firsts")  # a plain table, so that the join below can split a digest that very many rows share
    joined = rows.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return joined.select("doc_id", "unit_no", "unit_start", "unit_end", F.col("first.doc_id").alias("first_doc_id"), F.col("first.unit_no").alias("first_unit_no"), "text_key")


def deduplicated(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, spans: str | None = None) -> DataFrame:
    """``docs`` with repeated units cut out of ``text``; all columns stay, in order, whatever their names.

    ``spans`` names an additional column with the removed offsets of the
    original text, ``array<struct<start, end>>``, in order and apart. A unit that
    starts a line goes with its line break; one inside a line leaves it, so
    that lines never run together. A text that loses all its units becomes empty and stays; null texts stay null.
    """
    inner, of = sheltered(docs)
    removed = staged(repeated_units(inner.select(of("doc_id").alias("doc_id"), of("text").alias("text")), unit, min_words).select("doc_id", "text_key", "unit_start", "unit_end").distinct(), "removed")
    # Spans that overlap or touch are one: a span opens one if it starts after all before it have ended.
    order = Window.partitionBy("doc_id", "text_key").orderBy("unit_start", "unit_end")
    before = F.max("unit_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = removed.withColumn("opens", F.coalesce(F.col("unit_start") > before, F.lit(True)).cast("int")).withColumn("number", F.sum("opens").over(order))
    whole = opened.groupBy("doc_id", "text_key", "number").agg(F.min("unit_start").alias("start"), F.max("unit_end").alias("end"))
    lists = whole.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    lists = staged(lists.withColumnsRenamed({"doc_id": "list_id", "text_key": "list_key"}), "spans")
    release(removed)
    keyed = inner.withColumns({"own_id": of("doc_id").cast("long"), "own_key": F.xxhash64(of("doc_id").cast("long"), F.coalesce(of("text"), F.lit("")))})
    both = keyed.join(lists.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("list_id")) & (F.col("own_key") == F.col("list_key")), "left").select(*inner.columns, "spans")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            touched = batch.column("spans").is_valid()
            yield batch.filter(pa.compute.invert(touched))
            some = batch.filter(touched)
            texts = [cut_out(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(some.column(at).to_pylist(), some.column("spans").to_pylist(), strict=True)]
            yield some.set_column(at, some.schema.field(at), pa.array(texts, some.schema.field(at).type))

    out = both.mapInArrow(run, both.schema)
    return out.toDF(*docs.columns, spans) if spans else out.drop("spans").toDF(*docs.columns)


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without ``spans``, which are in order and apart."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        if start and text[start - 1] != "\n" and text[end - 1] == "\n":
            kept.append("\n")
        at = end
    return "".join([*kept, text[at:]])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit of ``documents`` that repeats an earlier one."""
    return repeated_units(table(spark, sf_dir, "documents")).drop("text_key")


OP6_SQL = r"""
WITH pieces AS (
  SELECT doc_id, regexp_extract_all(text, '[^.!?\x{3002}\x{FF01}\x{FF1F}\n]*[.!?\x{3002}\x{FF01}\x{FF1F}\n]+|[^.!?\x{3002}\x{FF01}\x{FF1F}\n]+') AS p FROM documents WHERE text IS NOT NULL),
placed AS (
  SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS unit_no FROM pieces),
spans AS (
  SELECT doc_id, unit_no, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY unit_no) AS unit_end,
    trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM placed),
sized AS (
  SELECT doc_id, unit_no, (unit_end - length(piece))::INT AS unit_start, unit_end::INT AS unit_end, norm,
    greatest(length(norm) - length(replace(norm, ' ', '')) + 1,
      len(regexp_extract_all(norm, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}]')) // 2
      + len(regexp_extract_all(norm, '[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}]')) // 4) AS words
  FROM spans WHERE norm <> ''),
placed_again AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS k, sum(words) OVER (PARTITION BY doc_id ORDER BY unit_no) AS upto FROM sized),
runs AS (
  SELECT a.doc_id, a.k AS a, b.k AS b FROM placed_again a JOIN placed_again b
    ON a.doc_id = b.doc_id AND b.upto >= a.upto - a.words + 13 AND b.upto - b.words < a.upto - a.words + 13
  UNION
  SELECT b.doc_id, a.k, b.k FROM placed_again b JOIN placed_again a
    ON a.doc_id = b.doc_id AND a.upto - a.words <= b.upto - 13 AND a.upto > b.upto - 13),
listed AS (SELECT doc_id, list(norm ORDER BY k) AS norms, list(unit_no ORDER BY k) AS numbers, list(unit_start ORDER BY k) AS starts, list(unit_end ORDER BY k) AS ends FROM placed_again GROUP BY doc_id),
units AS (
  SELECT doc_id, numbers[a]::INT AS unit_no, starts[a] AS unit_start, ends[b] AS unit_end, array_to_string(norms[a:b], chr(10)) AS norm FROM runs JOIN listed USING (doc_id)),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(unit_no) OVER w AS first_unit_no, row_number() OVER w AS rank
  FROM units WINDOW w AS (PARTITION BY norm ORDER BY doc_id, unit_no, unit_end))
SELECT doc_id, unit_no, unit_start, unit_end, first_doc_id, first_unit_no FROM ranked WHERE rank > 1
"""
