"""Toxicity by compression distance. zstandard dictionaries are trained on
ordinary and on toxic text; a window of words is compressed with the ordinary
dictionary and with it and a toxic one together, and the bytes that the toxic
one saves are the window's distance. There are two toxic dictionaries, of the
strictest and of more words. A document's windows give counts above thresholds,
which a logistic regression on labelled documents turns into a probability.

A hash of doc_id deals labelled documents to two halves at every size: one
teaches the dictionaries, the other calibrates, as words of a document that
taught are known to the dictionaries. Of each half a sample of about ``per_class``
toxic and twice as many ordinary documents is read. The ordinary dictionary is trained by zstandard on windows of
ordinary documents. Toxic documents are mostly ordinary prose, so the toxic
dictionary takes the words that are over-represented in them, by the lower
bound of the ratio of document frequencies, the most frequent last, where
matches are cheapest. Of a document of over ``most_windows`` windows evenly
spaced ones are used for the dictionaries; scores always use every window.

Defined cases: a null or empty text has no window and gets the score of a
document in which nothing is found; without labels of both kinds in both halves
every score is 0; repeated rows are scored one by one; a label for an id that occurs
several times holds for each row. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweave.llm.batches import Step, map_batches, sampled, utf8
from storyweave.llm.quality import fit_logistic

WINDOW = 6
LEVEL = 3
ORDINARY_BYTES = 16_384
TOXIC_BYTES = 16_384
#: How many times as frequent a word of each toxic dictionary has to be in toxic documents.
RATIOS = (8.0, 5.0)
STEPS = np.arange(1, 9)
#: Windows are compressed in groups of about this many bytes of text.
GROUP = 4_000_000


def windows(text: bytes | None, size: int = WINDOW) -> tuple[bytes, np.ndarray]:
    """The words of a text, one blank before and after each, and the (start,
    length) of every run of ``size`` words in it; the last run may be shorter."""
    words = (text or b"").lower().split()
    if not words:
        return b"", np.zeros((0, 2), np.int64)
    starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
    first = starts[:-1][::size]
    last = np.append(starts[::size][1:], starts[-1])[: len(first)]
    return b" " + b" ".join(words) + b" ", np.column_stack((first, last - first + 1))


@dataclass(frozen=True)
class Dictionaries:
    ordinary: bytes
    toxic: tuple[bytes, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        """The ordinary one first."""
        made = []
        for content in (self.ordinary, *(self.ordinary + t for t in self.toxic)):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(content), source_size=64, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
            dictionary.precompute_compress(compression_params=settings)
            made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings))
        return made


def _lengths(compressor: zstandard.ZstdCompressor, text: bytes, spans: np.ndarray) -> np.ndarray:
    segments = zstandard.BufferWithSegments(text, np.ascontiguousarray(spans, np.uint64).tobytes())
    return np.fromiter(map(len, compressor.multi_compress_to_buffer(segments)), np.int64, len(spans))


def describe(texts: list[bytes | None], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """A row per text: what the distances of its windows come to."""
    width = 2 * len(STEPS) + 2
    rows = np.zeros((len(texts), width * (len(compressors) - 1) + 1))
    at = 0
    while at < len(texts):
        parts, spans, owners, size, first = [], [], [], 0, at
        while at < len(texts) and (size < GROUP or at == first):
            text, found = windows(texts[at])
            parts.append(text)
            spans.append(found + [size, 0])
            owners.append(np.full(len(found), at - first))
            size += len(text)
            at += 1
        span, owner, joined = np.concatenate(spans), np.concatenate(owners), b"".join(parts)
        if not len(span):
            continue
        count = at - first
        n = np.bincount(owner, minlength=count)
        rows[first:at, -1] = np.log1p(n)
        plain = _lengths(compressors[0], joined, span)
        for k, compressor in enumerate(compressors[1:]):
            saved = plain - _lengths(compressor, joined, span)
            over = np.column_stack([np.bincount(owner, saved >= step, count) for step in STEPS])
            mean = np.bincount(owner, saved, count) / np.maximum(n, 1)
            best = np.zeros(count)
            np.maximum.at(best, owner, saved)
            rows[first:at, width * k : width * (k + 1)] = np.column_stack((np.log1p(over), np.sqrt(over / np.maximum(n, 1)[:, None]), mean, best))
    return rows


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[bytes | None], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
        x = np.clip((describe(texts, compressors) - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(np.column_stack((x, np.ones(len(x)))) @ self.weights, -30, 30)))


def train_dictionaries(documents: list[tuple[int, list[bytes]]]) -> Dictionaries:
    """From (label, windows) of each sampled document."""
    counts = (Counter(), Counter())
    totals = [0, 0]
    for y, runs in documents:
        totals[y] += 1
        counts[y].update({w for run in runs for w in run.split() if 4 <= len(w) <= 40})
    bounds: dict[bytes, float] = {}
    for word, n in counts[1].items():
        if n >= 3:
            m = counts[0][word]
            ratio = np.log((n + 0.5) / (totals[1] + 1)) - np.log((m + 0.5) / (totals[0] + 1))
            bounds[word] = float(ratio - 2.3 * np.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)))
    frequent = sorted(bounds, key=lambda w: (-counts[1][w], w))
    toxic = []
    for least in RATIOS:
        kept = [w for w in frequent if bounds[w] > np.log(least)]
        fits = np.cumsum([len(w) + 2 for w in kept]) <= TOXIC_BYTES
        toxic.append(b" " + b"  ".join(reversed([w for w, ok in zip(kept, fits, strict=True) if ok])) + b" ")
    ordinary = [run for y, runs in documents if not y for run in runs]
    step = max(1, len(ordinary) // 40_000)
    try:
        content = zstandard.train_dictionary(ORDINARY_BYTES, ordinary[::step], k=16, d=6, level=LEVEL).as_bytes()[-ORDINARY_BYTES:]
    except zstandard.ZstdError:  # too few windows to train on: they are the dictionary
        content = b"".join(ordinary)[-ORDINARY_BYTES:] or b" "
    return Dictionaries(content, tuple(toxic))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 3000, most_windows: int = 256) -> Model | None:
    """``learn`` says, of doc_id, which labels may be learned from."""
    usable = (
        labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    # words of what teaches are known to the dictionaries, so other documents calibrate
    usable = usable.withColumn("teaches", F.pmod(F.xxhash64("doc_id", F.lit("teaches")), F.lit(2)) == 0)
    sizes = {(r["teaches"], r["y"]): r["count"] for r in usable.groupBy("teaches", "y").count().collect()}
    if len(sizes) < 4:
        return None

    def some(teaches: bool) -> DataFrame:
        share = {y: per_class * (2 - y) / sizes[teaches, y] for y in (0, 1)}
        key, half = F.col("doc_id"), F.col("teaches") == teaches
        return usable.where(half & F.when(F.col("y") == 1, sampled(key, share[1])).otherwise(sampled(key, share[0]))).select("doc_id", "y")

    taken, judged = some(True), some(False)
    # the sampled labels are about 3 * per_class rows
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(taken), "doc_id")

    def runs() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for raw in utf8(batch.column("text")):
                text, spans = windows(raw)
                spans = spans[:: max(1, -(-len(spans) // most_windows))]
                out.append([text[a : a + n] for a, n in spans.tolist()])
            return pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "y", "runs"])

        return step

    read = map_batches(sample, runs, "doc_id long, y int, runs array<binary>").collect()
    read = sorted(read, key=lambda r: (r[0], r[2]))
    dictionaries = train_dictionaries([(r[1], [bytes(x) for x in r[2]]) for r in read])
    del read

    def rows() -> Step:
        compressors = dictionaries.compressors()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = describe(utf8(batch.column("text")), compressors)
            return pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

        return step

    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(judged), "doc_id")
    found = sorted(map_batches(again, rows, "doc_id long, y int, x array<double>").collect(), key=lambda r: (r[0], r[2]))
    y = np.array([r[1] for r in found], float)
    if len(set(y.tolist())) < 2:
        return None
    x = np.array([r[2] for r in found])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    weights = fit_logistic(np.column_stack((np.clip((x - mean) / scale, -8, 8), np.ones(len(x)))), y)
    # the sample holds the labels in other shares than the documents do
    odds = np.log(y.mean() / (1 - y.mean())) - np.log((sizes[True, 1] + sizes[False, 1]) / (sizes[True, 0] + sizes[False, 0]))
    weights[-1] -= odds
    return Model(dictionaries, mean, scale, weights)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted of every document."""
    # two dictionaries of bounded size and a few weights travel with the plan

    def make() -> Step:
        compressors = model.dictionaries.compressors() if model else []

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = model.scores(utf8(batch.column("text")), compressors) if model else np.zeros(batch.num_rows)
            return pa.record_batch([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, score double, predicted int")
