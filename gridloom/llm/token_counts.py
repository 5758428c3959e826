"""Token counts through a digest cache.

A text's count is stored under the digest of its normalised content and of the
tokenizer's file. Only contents that the cache has never seen are encoded,
each once however many documents hold it, and appended to the cache.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, shared_dir, shuffles_removed, staged, table

CACHE = "digest binary, tokenizer string, n_tokens long"
#: Characters encoded at once: the libraries take some 130 bytes of memory for each.
BLOCK = 1 << 18
#: A space between two other characters, where byte-level tokenizers always part words.
_PART = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts tokens as the library of the vocabulary file gives them: sentencepiece for .model, else tokenizers.

    Where a tokenizer is known to part words at single spaces, long texts are
    encoded block by block, cut there; the counts are the same, and memory is bounded.
    """

    def __init__(self, path: str):
        self.piece = path.endswith(".model")
        if self.piece:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as f:
            self.parts = parts_at_spaces(json.load(f))

    def counts(self, texts: list[str]) -> list[int]:
        if self.piece:
            return [len(x) for t in texts for x in self.model.encode([t], num_threads=1)]
        out = [0] * len(texts)
        rows, held, size = [], [], 0
        for i, text in enumerate(texts):
            for part in blocks(text, BLOCK) if self.parts else [text]:
                rows.append(i)
                held.append(part)
                size += len(part)
                if size >= BLOCK:
                    self._add(out, rows, held)
                    rows, held, size = [], [], 0
        self._add(out, rows, held)
        return out

    def _add(self, out: list[int], rows: list[int], held: list[str]) -> None:
        for i, x in zip(rows, self.model.encode_batch_fast(held, add_special_tokens=False), strict=True):
            out[i] += len(x.ids)


def parts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer's file says that words always part before a space that stands between two other characters.

    So it is for byte-level ones with their own pattern, nothing added or
    changed before it, and special tokens without white space around or inside.
    """
    before = spec.get("pre_tokenizer") or {}
    plain = all(not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    return spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and plain


def blocks(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of ``size`` characters and up to the next place where words part, if there is one."""
    at = 0
    while len(text) - at > size:
        m = _PART.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def counter(path: str) -> Counter:
    """One counter a worker process, kept between tasks."""
    kept = sys.__dict__.setdefault("_gridloom_counters", {})
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept[path] = Counter(path)
    return kept[path]


def content(text: Column) -> Column:
    """The normalised content that is digested: null counts as the empty text.

    Nothing else may be normalised away, as every character can change a count.
    """
    return F.coalesce(text, F.lit(""))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 1024) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, a row for each row of ``docs``.

    1. Digest every text (SHA-256) and keep one text of each digest. The
       grouping combines copies before the shuffle, so a group of copies of any
       size sends one row a task.
    2. Drop digests that the cache has for this tokenizer, encode the rest, and
       append their counts to the cache.
    3. Join the documents' digests, without texts, to the stored counts.

    ``cache`` is a Parquet folder, by default one in the shared folder. Two
    runs at once may store a digest twice; reads take one. A null or empty text
    has 0 bytes and 0 tokens; repeated rows each get their row; a null doc_id
    stays null; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/gridloom/token_cache"
    version = tokenizer_digest(tokenizer)
    base = docs.select("doc_id", content(F.col("text")).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    known = read_cache(spark, cache).where(F.col("tokenizer") == version)
    texts = base.select(digest, "text").groupBy("digest").agg(F.first("text").alias("text"))
    misses = texts.join(known.select("digest"), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(tokenizer)
        for batch in batches:
            n = model.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    with shuffles_removed(spark):
        misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    stored = staged(stored, "counts")  # a plain table, so that the join below can split a digest that very many rows share
    keyed = base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest)
    return keyed.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of ``documents`` under the 50k byte-level vocabulary.

    The query starts from an empty cache of its own, so that every run does and
    measures the whole work; pass a lasting ``cache`` to the operator to keep counts.
    """
    import public_tokenizers

    cache = f"{shared_dir(spark)}/gridloom/{uuid.uuid4().hex}/token_cache"
    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    remove(spark, cache.rpartition("/")[0])  # the counts that the result reads are stored by themselves
    return found
