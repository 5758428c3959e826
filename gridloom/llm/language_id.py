"""Language identification: multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table

#: Hashed n-grams of 1 to ``ORDERS`` characters.
FEATURES, ORDERS = 4096, 3
#: Documents that the regression and the calibration may learn from, for each language, and for all together. Document frequencies are taken from all.
SAMPLE_ROWS, SAMPLE_TOTAL = 1500, 12_000
#: Code points hashed at once, which bounds the memory that a long text takes.
BLOCK = 1 << 18
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed character n-grams of the lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    counts = np.zeros(FEATURES, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, codes.size, BLOCK):
            # Blocks overlap by what an n-gram that starts in the block still needs.
            part = codes[at : at + BLOCK + ORDERS - 1]
            h = np.zeros(part.size, np.uint64)
            for n in range(1, ORDERS + 1):
                h = (h[: part.size - n + 1] + part[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                own = h[: min(BLOCK, h.size)]
                counts += np.bincount((own >> np.uint64(52)).astype(np.int64), minlength=FEATURES)
    return counts


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of damped frequencies times idf, of unit length."""
    x = np.log1p(counts) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights (features + 1, classes) by follow-the-regularised-leader (proximal) with elastic net.

    ``rows`` are (places, values) of sparse rows. Each coordinate has its own
    rate; its weight is zero until its gradient sum exceeds ``l1``.
    """
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            places, values = rows[k]
            w = weights(z[places], n[places])
            p = softmax(values @ w)
            p[labels[k]] -= 1
            g = values[:, None] * p[None, :]
            g2 = n[places] + g * g
            z[places] += g - (np.sqrt(g2) - np.sqrt(n[places])) / alpha * w
            n[places] = g2
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for at in range(0, len(texts), 64):
            some = [t or "" for t in texts[at : at + 64]]
            x = tf_idf(np.stack([ngram_counts(t) for t in some]), self.idf)
            if self.languages:
                p = softmax((x @ self.weights[:-1] + self.weights[-1]) / self.heat)
            for k, t in enumerate(some):
                if not self.languages or not has_letter(t):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    best = int(p[k].argmax())
                    names.append(self.languages[best])
                    scores.append(float(p[k, best]))
        return names, scores


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``(doc_id, text, lang)``; rows without text, letter or language are left out.

    Document frequencies cover all rows. The regression is fitted on at most
    ``sample_rows`` rows of each language and ``SAMPLE_TOTAL`` of all, those with the smallest hashes of id and text, and
    the temperature on a fifth of them that the regression has not seen. Rows that
    repeat count once there, so no id or text, null or not, makes the sample
    larger. Languages are what the rows hold: their number must be small.
    """
    base = rows.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += ngram_counts(t) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(np.append(total, n))], names=["place", "n"])

    found = base.select("text").mapInArrow(frequency, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES + 1)
    for r in found:
        df[r.place] = r.n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    base = base.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id", "text"), 1))
    each = {r.lang: r.n for r in base.groupBy("lang").agg(F.approx_count_distinct("draw", 0.01).alias("n")).collect()}
    languages = sorted(each)
    if not languages:
        return Model([], idf, np.zeros((FEATURES + 1, 0)), 1.0)
    sample_rows = max(1, min(sample_rows, SAMPLE_TOTAL // len(languages)))
    # A part of the hash range that nearly always has enough rows, and few more; the cut below is exact.
    wanted = 1.05 * sample_rows + 5 * sample_rows**0.5
    limit = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(2**63 - 1, int(wanted / each[lang] * 2**63)))])
    chosen = base.where(F.col("draw") <= limit[F.col("lang")]).groupBy("lang", "draw").agg(F.first("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, d, c) for lang, d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(t) for c in (ngram_counts(t),)]
            if rows:
                places = [np.flatnonzero(c) for _, _, c in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([p.astype(np.int16).tobytes() for p in places]), pa.array([c[p].astype(np.int32).tobytes() for (_, _, c), p in zip(rows, places, strict=True)])],
                    names=["lang", "draw", "places", "counts"],
                )

    got = sorted(chosen.mapInArrow(features, "lang string, draw long, places binary, counts binary").collect(), key=lambda r: (r.lang, r.draw, bytes(r.places)))
    taken: dict[str, int] = {}
    places, values, labels, held = [], [], [], []
    for r in got:
        k = taken[r.lang] = taken.get(r.lang, 0) + 1
        if k > sample_rows:
            continue
        p = np.frombuffer(r.places, np.int16).astype(np.int64)
        x = np.log1p(np.frombuffer(r.counts, np.int32)) * idf[p]
        places.append(np.append(p, FEATURES))
        values.append(np.append(x / max(np.linalg.norm(x), 1e-12), 1.0))
        labels.append(languages.index(r.lang))
        held.append(k % 5 == 0)
    y, held_out = np.array(labels), np.array(held)
    fit = np.flatnonzero(~held_out)
    w = ftrl([(places[k], values[k]) for k in fit], y[fit], len(languages))
    rest = np.flatnonzero(held_out)
    logits = np.array([values[k] @ w[places[k]] for k in rest]).reshape(len(rest), len(languages))
    return Model(languages, idf, w, temperature(logits, y[rest]))


def identified(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keep, lang_pred, score)``, a row for each row of ``docs``.

    ``lang_pred`` is the likeliest learned language and ``score`` its calibrated
    probability; ``und`` and 0 if the text is null or has no letter, or if
    there was nothing to learn from. Repeated rows get a row each; a null doc_id
    stays null; an empty table gives no rows; further columns are ignored, unless named in ``keep``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = sent.value.predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col("text").alias("whole_text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """``docs`` without rows of undetermined language or a score below ``min_score``; columns stay, whatever their names.

    Null and empty texts, and texts without a letter, are undetermined and go;
    ids play no part, repeated rows stay or go together, and an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = sent.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNDETERMINED and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def eligible(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn from: remainder modulo 4 is not 2."""
    return docs.where(remainder(F.col("doc_id"), 4) != 2)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, train(eligible(docs)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
