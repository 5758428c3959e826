"""Quality scores from positive and unlabelled texts.

The classifier never sees a negative label. It minimises the non-negative
unbiased risk: positives stand for themselves, unlabelled texts for the whole
web, and the share of positives among them, the class prior, is estimated.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table

#: Kinds of characters, whose triples are counted; and features of the whole text.
KINDS, EXTRA = 10, 5
FEATURES = KINDS**3 + EXTRA
#: Positives and unlabelled texts that the classifier may be fitted on; the smallest hashes are taken.
POSITIVES, UNLABELLED = 3000, 6000
BLOCK = 1 << 18


def _kind(c: str) -> int:
    group = unicodedata.category(c)
    if c == "\n":
        return 5
    if c.isspace():
        return 4
    if group[0] == "L":
        return (1 if c.isupper() else 0) if c.isascii() else (1 if c.isupper() else 2)
    if group[0] == "N":
        return 3
    if c in ".,;:'\"-()":
        return 6
    if c in "!?":
        return 7
    return 8 if group[0] in "PS" else 9


_table: list[np.ndarray] = []


def kinds(text: str) -> np.ndarray:
    if not _table:
        _table.append(np.array([_kind(chr(i)) if not 0xD800 <= i < 0xE000 else 9 for i in range(1 << 16)], np.int64))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _table[0][np.minimum(codes, 0xFFFF)]


def features(text: str) -> np.ndarray:
    """Root frequencies of kind triples, and length, word and line statistics; zero for an empty text."""
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    counts = np.zeros(KINDS**3, np.int64)
    k = kinds(text)
    for at in range(0, max(k.size - 2, 0), BLOCK):
        part = k[at : at + BLOCK + 2]
        counts += np.bincount(part[:-2] * KINDS * KINDS + part[1:-1] * KINDS + part[2:], minlength=KINDS**3)
    out[: KINDS**3] = np.sqrt(counts / max(1, counts.sum()))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    out[-EXTRA:] = np.log1p(k.size) / 10, len(set(words)) / n, sum(map(len, words)) / n / 10, 1 - len(set(lines)) / len(lines), np.log1p(len(lines)) / 10
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_pu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 300, l2: float = 1e-3) -> np.ndarray:
    """Weights (bias last) with the least non-negative unbiased logistic risk.

    The risk of calling texts positive is ``prior`` times that over the
    positives. The risk of calling them negative is that over the unlabelled
    less the positives' share; it cannot be below zero in truth, so where the
    estimate is, the step goes back up instead of fitting the noise.
    """

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = xp @ w, xu @ w
        up = prior * (xp * (sigmoid(zp) - 1)[:, None]).mean(0)
        of_u, of_p = np.logaddexp(0, zu).mean(), prior * np.logaddexp(0, zp).mean()
        down = (xu * sigmoid(zu)[:, None]).mean(0) - prior * (xp * sigmoid(zp)[:, None]).mean(0)
        g = up + down if of_u - of_p >= 0 else -down
        return g + l2 * np.append(w[:-1], 0)

    return _adam(gradient, xp.shape[1], steps)


def class_prior(xp: np.ndarray, xu: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, by the best bin of a two-fold score.

    A classifier of positives against unlabelled ranks each fold that it has
    not seen. Above a threshold that keeps a share q of the positives, the
    unlabelled keep at least prior * q; the threshold with the lowest upper
    confidence bound on their ratio gives the estimate.
    """
    sp, su = np.zeros(len(xp)), np.zeros(len(xu))
    for fold in (0, 1):
        p, u = xp[fold::2], xu[fold::2]

        def gradient(w: np.ndarray, p=p, u=u) -> np.ndarray:
            return (p * (sigmoid(p @ w) - 1)[:, None]).mean(0) + (u * sigmoid(u @ w)[:, None]).mean(0) + 1e-3 * np.append(w[:-1], 0)

        w = _adam(gradient, xp.shape[1], 200)
        sp[1 - fold :: 2], su[1 - fold :: 2] = xp[1 - fold :: 2] @ w, xu[1 - fold :: 2] @ w
    cuts = np.quantile(sp, np.linspace(0.02, 0.9, 89))
    qp = np.array([(sp >= c).mean() for c in cuts])
    qu = np.array([(su >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / delta) / (2 * len(su))) + np.sqrt(np.log(4 / delta) / (2 * len(sp)))
    best = np.argmin((qu + slack) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 64):
            x = (np.stack([features(t or "") for t in texts[at : at + 64]]) - self.mean) / self.scale
            out[at : at + 64] = sigmoid(x @ self.weights[:-1] + self.weights[-1])
        return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from texts whose label is 1 and texts that have none.

    Labels of 0 are never read as negatives; such rows, and rows labelled both
    ways, are left out, as are rows without doc_id. The classifier is fitted on the ``positives`` and
    ``unlabelled`` rows with the smallest hashes of id and text; rows that repeat count once, so
    no more than these are ever collected, and ties can't occur. Without rows of
    either sort every score is 0.5.
    """
    spark = docs.sparkSession
    told = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("high"))
    draw = F.xxhash64(F.lit("quality"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("draw")
    drawn = docs.where(F.col("doc_id").isNotNull()).select("doc_id", draw).join(told, "doc_id", "left")
    drawn = drawn.select("draw", F.when((F.col("low") == 1) & (F.col("high") == 1), 1).when(F.col("low").isNull() & F.col("high").isNull(), 0).alias("kind"))
    # At most positives + unlabelled hashes: a bounded list.
    chosen = [(r.draw, kind) for kind, n in ((1, positives), (0, unlabelled)) for r in drawn.where(F.col("kind") == kind).select("draw").distinct().orderBy("draw").limit(n).collect()]
    if len({kind for _, kind in chosen}) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), 0.5)
    some = F.broadcast(spark.createDataFrame(chosen, "draw long, kind int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [features(t or "").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("kind"), pa.array(xs, pa.binary())], names=["draw", "kind", "x"])

    once = docs.where(F.col("doc_id").isNotNull()).select(draw, "text").join(some, "draw").groupBy("draw", "kind").agg(F.first("text").alias("text"))
    rows = sorted(once.mapInArrow(run, "draw long, kind int, x binary").collect(), key=lambda r: (r.kind, r.draw))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(np.float64)
    kind = np.array([r.kind for r in rows])
    mean, scale = x.mean(0), x.std(0)
    scale = np.maximum(scale, 1e-2)  # kinds that hardly occur keep small weights
    x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    prior = class_prior(x[kind == 1], x[kind == 0])
    return Model(mean, scale, fit_pu(x[kind == 1], x[kind == 0], prior), prior)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)``, a row for each row of ``docs``; null texts score as empty ones.

    Repeated rows get a row each, a null doc_id stays null, an empty table
    gives no rows, and further columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``, learned where the remainder modulo 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fits = remainder(F.col("doc_id"), 3) != 1
    model = train(docs.where(fits), labels.where(fits))
    found = scored(docs, model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
