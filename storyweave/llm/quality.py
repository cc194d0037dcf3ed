"""Quality by hierarchical empirical Bayes: a classifier reads each document,
and what is known of its host and of its path on that host joins the evidence.

The document classifier is a logistic regression on shares that one pass over
the whole text gives, fitted on a sample of about ``max_rows`` labelled
documents. Hosts and paths then get posteriors of their share of good
documents: a path is shrunk toward its host and a host toward the corpus, the
more so the fewer documents it has and the less hosts (or paths of a host)
differ beyond what chance gives. The strengths are estimated from sums over all
documents, so only grouped sums are ever exchanged. What a site says of a
document rests on the site's other documents: its own evidence is taken out of
the sums before they are shrunk, as the classifier has counted it already.

Defined cases: a null or empty text has the features of no text; a null host or
path is a group of its own; documents without a label are scored alike; without
labels of both kinds every document gets the prior of one half and is kept;
repeated rows count as often as they occur, each among the others of its copy;
a site's only document has the odds of its host, or of the corpus. Extra columns
are ignored by ``score`` and carried by ``keep``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from storyweave.llm.batches import Step, free_name, map_batches, sampled, utf8
from storyweave.session import cut_lineage

#: Kinds of bytes: 0 other ASCII, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 outside ASCII.
_KIND = np.array(
    [5 if b > 127 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in (9, 10, 11, 12, 13, 32) else 0 for b in range(256)],
    np.uint8,
)
FEATURES = ("log_words", "upper", "digit", "symbol", "commas", "word_length", "repeats", "distinct", "marked_words", "lines")
EDGE = 1e-4


def features(text: bytes | None) -> list[float]:
    """Shares of a whole text, in one pass over its bytes."""
    text = text or b""
    raw = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=6) if len(raw) else np.zeros(6)
    letters = kinds[1] + kinds[2] + kinds[5]
    prose = text.count(b",") + text.count(b".")
    words = text.split()
    n = max(len(words), 1)
    ends = np.cumsum([len(w) + 1 for w in words]) if words else np.zeros(0, np.int64)
    joined = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    # words that end in a sign other than those of plain prose
    last = joined[ends - 2] if len(ends) else np.zeros(0, np.uint8)
    marked = ((_KIND[last] == 0) & (last != 44) & (last != 46)).sum() if len(last) else 0
    repeats = sum(map(bytes.__eq__, words[1:], words))
    return [
        float(np.log1p(len(words))), kinds[2] / max(letters, 1), kinds[3] / max(len(raw), 1),
        (kinds[0] - prose) / max(len(raw), 1), prose / n, min(len(raw) / n, 40.0) / 10, repeats / n,
        float(np.log1p(len(set(words))) / np.log1p(n)), marked / n, min((text.count(b"\n") + 1) / n, 1.0),
    ]


def site() -> tuple[Column, Column]:
    """Host and path of a table of documents: its source, and the language
    section of that source, as the first step of a page's path is its language."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


@dataclass(frozen=True)
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, their squares and a bias

    def probability(self, rows: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(design(rows, self.mean, self.scale) @ self.weights, -30, 30)))
        return np.clip(p, EDGE, 1 - EDGE)


def design(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = np.clip((rows - mean) / scale, -8, 8)
    return np.column_stack((x, x * x, np.ones(len(x))))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton steps of ridge logistic regression; the last column is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
        size = np.abs(move).max()
        w -= move * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """Text and label of about ``max_rows`` labelled documents, by a hash of
    doc_id. The sampled labels have a bounded size and go to the documents."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = labels.count()
    taken = clean.where(sampled(F.col("doc_id"), max_rows / max(n, 1)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(taken), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Classifier | None:
    def make() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.array([features(t) for t in utf8(batch.column("text"))])
            return pa.record_batch(
                [batch.column("doc_id"), batch.column("y"), pa.array(list(rows), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

        return step

    found = map_batches(labelled_sample(docs, labels, "quality", max_rows), make, "doc_id long, y int, x array<double>").collect()
    found = sorted(found, key=lambda r: (r[0], r[2]))
    y = np.array([r[1] for r in found], float)
    if len(set(y.tolist())) < 2:
        return None
    rows = np.array([r[2] for r in found])
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    return Classifier(mean, scale, fit_logistic(design(rows, mean, scale), y))


@dataclass(frozen=True)
class Strengths:
    """The corpus mean and how many documents the prior of a host, and that of a path, is worth."""

    mean: float
    host: float
    path: float


def _strength(between: float, mean: float) -> float:
    """Prior documents of a beta distribution with this mean and variance."""
    return 1e9 if between <= 1e-9 else float(np.clip(mean * (1 - mean) / between - 1, 1.0, 1e9))


def with_evidence(docs: DataFrame, classifier: Classifier | None, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and evidence, the classifier's probability of good."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), "text")

    def make() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch(
                [*(batch.column(c) for c in ("doc_id", "host", "path")), pa.array(evidence(batch.column("text"), classifier))],
                names=["doc_id", "host", "path", "evidence"])

        return step

    return map_batches(rows, make, "doc_id long, host string, path string, evidence double")


def evidence(texts: pa.Array, classifier: Classifier | None) -> np.ndarray:
    if classifier is None:
        return np.full(len(texts), 0.5)
    return classifier.probability(np.array([features(t) for t in utf8(texts)]))


def site_sums(scored: DataFrame) -> tuple[DataFrame, Strengths]:
    """host and path with number and sum of the evidence of the path (n, s) and
    of its host (hn, hs), and the strengths. The variances are those of one-way
    layouts with unequal groups: hosts in the corpus, and paths within their hosts."""
    paths = cut_lineage(scored.groupBy("host", "path").agg(
        F.count("*").cast("double").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("q")))
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"),
        F.sum("q").alias("hq"), F.count("*").cast("double").alias("k"))
    row = hosts.agg(
        F.sum("hn"), F.sum("hs"), F.sum("hq"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")), F.sum(F.col("hn") * F.col("hn")),
        F.count("*").cast("double"), F.sum("ss"), F.sum(F.col("nn") / F.col("hn")), F.sum("k")).first()
    n, s, q, hss, hnn, h, pss, pnn, k = (float(x or 0) for x in row)
    mean = float(np.clip(s / n if n else 0.5, EDGE, 1 - EDGE))

    def between(groups: float, above: float, squares: float, spread: float, upper: float) -> float:
        # groups under ``above`` parents; squares of group sums, of their parents' sums, and of values
        if groups <= above or n <= groups:
            return 0.0
        within = (q - squares) / (n - groups)
        room = n - spread
        return ((squares - upper) - (groups - above) * within) / room if room > 0 else 0.0

    host_between = between(h, 1.0, hss, hnn / n if n else 0.0, s * s / n if n else 0.0)
    path_between = between(k, h, pss, pnn, hss)
    of_host = hosts.select(F.col("host").alias("_host"), "hn", "hs")
    sums = paths.join(of_host, F.col("host").eqNullSafe(F.col("_host"))).select("host", "path", "n", "s", "hn", "hs")
    return sums, Strengths(mean, _strength(host_between, mean), _strength(path_between, mean))


def others_odds(evidence_: Column, sums: Column, strengths: Strengths) -> Column:
    """The log odds that the other documents of a document's site add to those
    of the corpus: its path's posterior, shrunk toward its host's, which is
    shrunk toward the corpus mean, all without the document's own evidence."""
    host = (F.lit(strengths.host * strengths.mean) + sums["hs"] - evidence_) / (F.lit(strengths.host - 1) + sums["hn"])
    path = (F.lit(strengths.path) * host + sums["s"] - evidence_) / (F.lit(strengths.path - 1) + sums["n"])
    p = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), path))
    return F.log(p / (1 - p)) - F.lit(float(np.log(strengths.mean / (1 - strengths.mean))))


def with_posterior(rows: DataFrame, sites: DataFrame, strengths: Strengths, evidence_: str, host: Column, path: Column, most: int = 100_000) -> DataFrame:
    """Rows as one struct ``row``, and ``posterior``: evidence and site odds put
    together. Sites are counted first: up to ``most`` of them are broadcast,
    more meet the rows by a shuffle, whose hot sites adaptive execution splits."""
    sites = cut_lineage(sites.select(F.struct(*sites.columns).alias("site")))
    small = F.broadcast(sites) if sites.count() <= most else sites
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), host.alias("at_host"), path.alias("at_path"))
    joined = packed.join(small, F.col("at_host").eqNullSafe(F.col("site.host")) & F.col("at_path").eqNullSafe(F.col("site.path")))
    own = F.col("row")[evidence_]
    odds = F.log(own / (1 - own)) + others_odds(own, F.col("site"), strengths)
    return joined.select("row", (1 / (1 + F.exp(-odds))).alias("posterior"))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_rows: int = 20_000, least: float = 0.5) -> DataFrame:
    """doc_id, host, path, evidence, score and accepted."""
    scored = with_evidence(docs, fit(docs, labels, max_rows), host, path)
    joined = with_posterior(scored, *site_sums(scored), "evidence", F.col("host"), F.col("path"))
    return joined.select("row.*", F.col("posterior").alias("score")).withColumn("accepted", F.col("score") >= least)


def keep(docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_rows: int = 20_000, least: float = 0.5) -> DataFrame:
    """The documents whose score is ``least`` or more, all columns kept. Two
    passes read the texts: one for the sites' sums, one to judge each document,
    so that no text is ever shuffled for a decision."""
    classifier = fit(docs, labels, max_rows)
    sums = site_sums(with_evidence(docs, classifier, host, path))
    added = free_name("evidence", docs.columns)
    schema = StructType([*docs.schema.fields, StructField(added, DoubleType())])

    def make() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([*batch.columns, pa.array(evidence(batch.column("text"), classifier))], names=[*batch.schema.names, added])

        return step

    judged = map_batches(docs, make, schema)
    joined = with_posterior(judged, *sums, added, host.cast("string"), path.cast("string"))
    return joined.where(F.col("posterior") >= least).select(*[F.col("row")[c].alias(c) for c in docs.columns])
