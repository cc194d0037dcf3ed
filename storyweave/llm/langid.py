"""Language identification: multinomial logistic regression on TF-IDF character
n-grams, trained by follow-the-regularised-leader (FTRL-proximal) with an
elastic-net penalty, its probabilities calibrated by a temperature.

Characters are lower-cased; ASCII characters that are no letters count as blanks. All n-grams of
1 to 3 characters of the whole text are hashed to ``DIMENSIONS`` features.
Document frequencies are counted over all documents that may be learned from;
the weights are fitted on a sample of about ``per_language`` of them for each
language, chosen by a hash of doc_id.

Defined cases: a text that is null or has no letter gets ``und`` with score 0;
documents without a language, or a null doc_id, are never learned from; without
any document to learn from every text gets ``und``; repeated rows are predicted
one by one. Extra columns are ignored by ``predict`` and carried by ``accept``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweave.llm.batches import Step, map_batches

DIMENSIONS = 1 << 14
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: ASCII characters that are no letters become blanks.
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode's category L occurs; numeric signs are none."""
    return text is not None and any(map(str.isalpha, text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs, in blocks of bounded size."""
    total = np.zeros(DIMENSIONS, np.int64)
    lowered = text.lower()
    overlap = max(ORDERS) - 1
    for at in range(0, max(len(lowered), 1), 1 << 20):
        block = lowered[max(at - overlap, 0) : at + (1 << 20)]
        codes = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 128, _FOLD[np.minimum(codes, 127)], codes).astype(np.uint64)
        before = min(at, overlap)
        for order in ORDERS:
            size = len(codes) - order + 1
            if size <= 0:
                continue
            h = np.full(size, order, np.uint64) * _MULTIPLIERS[0]
            for k in range(order):
                h = (h ^ codes[k : k + size]) * _MULTIPLIERS[k]
            ends_new = h[max(before - order + 1, 0) :]  # n-grams that the block before has not counted
            total += np.bincount((ends_new >> np.uint64(50)).astype(np.int64), minlength=DIMENSIONS)
    features = np.flatnonzero(total)
    return features, total[features]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # features and a bias, by language
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return weigh(*counts(text), self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        features, values = self.vector(text)
        p = softmax((values @ self.weights[features] + self.weights[-1]) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def weigh(features: np.ndarray, found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = (1 + np.log(found)) * idf[features]
    norm = np.sqrt(values @ values)
    return features, values / norm if norm else values


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, rounds: int = 3, dimensions: int = DIMENSIONS,
) -> np.ndarray:
    """Weights by per-coordinate FTRL-proximal steps, one document at a time.
    The bias is the last feature and bears no penalty."""
    z = np.zeros((dimensions + 1, classes))
    n = np.zeros((dimensions + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    bias = np.array([dimensions])
    for _ in range(rounds):
        for (features, values), label in zip(rows, labels, strict=True):
            at, x = np.concatenate((features, bias)), np.append(values, 1.0)
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(z, n)


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on held-back documents."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.02, 10, 80)
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(docs: DataFrame, learn: Column, per_language: int = 1000) -> Model:
    """``learn`` says which documents may be learned from."""
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.select(F.col("doc_id").cast("long"), "text", "lang")

    def document_counts() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            # one row of sums per batch, not one per document
            df = np.zeros(DIMENSIONS, np.int64)
            texts = [t for t in batch.column("text").to_pylist() if has_letter(t)]
            for text in texts:
                df[counts(text)[0]] += 1
            seen = np.flatnonzero(df)
            return pa.record_batch(
                [pa.array(np.append(seen, DIMENSIONS)), pa.array(np.append(df[seen], len(texts)))], names=["feature", "n"])

        return step

    sums = map_batches(usable.select("text"), document_counts, "feature long, n long").groupBy("feature").agg(F.sum("n"))
    df = np.zeros(DIMENSIONS + 1)
    for feature, n in sums.collect():  # at most DIMENSIONS + 1 rows
        df[feature] = n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    sizes = dict(usable.groupBy("lang").count().collect())
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), idf, np.zeros((DIMENSIONS + 1, 0)), 1.0)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(per_language / sizes[lang], 1.0))])[F.col("lang")]
    taken = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))

    def vectors() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, lang, counts(t)) for i, lang, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True) if has_letter(t)]
            return pa.record_batch([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2][0].astype(np.uint16).tobytes() for r in rows], pa.binary()),
                pa.array([np.minimum(r[2][1], 65535).astype(np.uint16).tobytes() for r in rows], pa.binary()),
            ], names=["doc_id", "lang", "features", "found"])

        return step

    sample = map_batches(taken, vectors, "doc_id long, lang string, features binary, found binary").collect()
    # an order that depends on the rows alone
    sample = sorted(sample, key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) % (1 << 64), bytes(r[2]), bytes(r[3])))
    rows = [weigh(np.frombuffer(r[2], np.uint16).astype(np.int64), np.frombuffer(r[3], np.uint16).astype(np.int64), idf) for r in sample]
    labels = np.array([languages.index(r[1]) for r in sample], np.int64)
    held = np.arange(len(rows)) % 5 == 4
    kept = np.flatnonzero(~held)
    weights = ftrl([rows[k] for k in kept], labels[kept], len(languages))
    logits = np.array([v @ weights[f] + weights[-1] for f, v in (rows[k] for k in np.flatnonzero(held))]).reshape(-1, len(languages))
    return Model(languages, idf, weights, calibrated(logits, labels[held]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score."""
    # the model travels with the plan; DIMENSIONS and the languages bound it

    def make() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            return pa.record_batch(
                [batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose language is told with a score of ``least`` or more,
    all columns kept; a null lang is filled with the prediction."""

    def make() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if "lang" in columns:
                columns["lang"] = pa.array(
                    [p[0] if x is None else x for p, x in zip(found, columns["lang"].to_pylist(), strict=True)], batch.schema.field("lang").type)
            keep = pa.array([p[0] != UNKNOWN and p[1] >= least for p in found], pa.bool_())
            return pa.record_batch(list(columns.values()), names=batch.schema.names).filter(keep)

        return step

    return map_batches(docs, make, docs.schema)


