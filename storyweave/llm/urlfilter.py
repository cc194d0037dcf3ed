"""URL filtering: rules decide the URLs they fit, and gradient-boosted trees on
lexical features, trained from those decided URLs, decide the rest.

A rule is a host and a path, like ``example.com/en/``: it fits its host and all
subdomains if the URL's path starts with the rule's; the longest rule wins. The
features are lengths, depth, digit ratio, entropies, counts of parameters,
labels and signs, and suffix statistics: how often URLs with the same last one,
two or three labels of the host, alone or with the head of the path, were blocked
among all decided URLs, by hashed suffix, so that the table has a fixed size. The
trees learn from statistics of other folds than a URL's own, so that no label
is inside the features it is predicted from; later URLs get those of all folds.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is judged by its features; without decided URLs of both
verdicts all others get the only one there is, or ``allow``; repeated rows are
judged one by one. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweave.llm.batches import Step, map_batches

#: The production rules: verdict and rule. Fixed values.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
_UPPER = {c: c + 32 for c in range(65, 91)}
BUCKETS = 1 << 16
SUFFIXES = (1, 2, 3)
FOLDS = 4


def parts(url: str | None) -> tuple[str, str]:
    found = _PARTS.search(url or "")
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


class Rules:
    """Rules by host; a URL looks up its host and each parent domain."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_UPPER), []).append((slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        while host:
            for prefix, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            host = host.partition(".")[2]
        return best


def suffix_buckets(host: str, path: str) -> list[int]:
    """Of the host's suffixes, alone and with the head of the path."""
    labels, head = host.split("."), path[1:].partition("/")[0]
    suffixes = [".".join(labels[-k:]) for k in SUFFIXES]
    keys = [f"{k}:{s}" for k, s in zip(SUFFIXES, suffixes, strict=True)] + [f"{k}:{s}/{head}" for k, s in zip(SUFFIXES, suffixes, strict=True)]
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) % BUCKETS for k in keys]


def fold_of(url: str) -> int:
    return zlib.crc32(url.encode("utf-8", "surrogatepass")) % FOLDS


def suffix_odds(n: np.ndarray, blocked: np.ndarray, share: float, strength: float = 20.0) -> np.ndarray:
    """Log odds that a suffix adds to those of all URLs, shrunk by ``strength`` rows."""
    p = (blocked + strength * share) / (n + strength)
    return np.log(p / (1 - p)) - np.log(share / (1 - share))


def entropy(text: str) -> float:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return 0.0
    p = np.bincount(raw)
    p = p[p > 0] / len(raw)
    return float(-(p * np.log2(p)).sum())


def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    segments = [s for s in path.split("/") if s]
    digits = sum(map(str.isdigit, url))
    return [
        len(url), len(host), len(path), len(segments), digits / max(len(url), 1), entropy(url), entropy(host),
        query.count("&") + 1 if query else 0, len(query), host.count("."), host.count("-"), url.count("-") + url.count("_"),
        len(segments[0]) if segments else 0, max(map(len, segments), default=0), float("#" in url), float(url.startswith("https")),
        float("." in segments[-1]) if segments else 0.0, float(path.endswith("/")),
    ]


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: a feature and a border per inner node."""

    base: float
    features: np.ndarray
    borders: np.ndarray
    leaves: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        inner = self.features.shape[1] if len(self.features) else 0
        for features, borders, leaves in zip(self.features, self.borders, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while (node < inner).any():
                node = 2 * node + 1 + (x[np.arange(len(x)), features[node]] > borders[node])
            total += leaves[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, weights: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Forest:
    """Second-order boosting of the logistic loss over quantile histograms; a row counts ``weights`` times."""
    mean = np.clip(np.average(y, weights=weights), 1e-4, 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    inner = (1 << depth) - 1
    total = np.full(len(x), base)
    kept_f, kept_b, kept_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = weights * (y - p), weights * p * (1 - p)
        features, borders = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = node - first
            gain, choice, border = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, np.inf)
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                size = len(edges[f]) + 1
                cell = at * size + binned[:, f]
                gs = np.bincount(cell, g, width * size).reshape(width, size).cumsum(axis=1)
                hs = np.bincount(cell, h, width * size).reshape(width, size).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                won = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                k = won.argmax(axis=1)
                top = won[np.arange(width), k]
                better = top > gain
                gain[better], choice[better], border[better] = top[better], f, edges[f][k[better]]
            features[first : first + width], borders[first : first + width] = choice, border
            node = 2 * node + 1 + (x[np.arange(len(x)), features[node]] > borders[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += value[leaf]
        kept_f.append(features)
        kept_b.append(borders)
        kept_v.append(value)
    return Forest(base, np.array(kept_f), np.array(kept_b), np.array(kept_v))


@dataclass(frozen=True)
class Model:
    forest: Forest | None
    only: str
    suffixes: np.ndarray  # log odds of block by hashed suffix

    def features(self, url: str | None, host: str, path: str, suffixes: np.ndarray | None = None) -> list[float]:
        odds = self.suffixes if suffixes is None else suffixes
        return lexical(url, host, path) + [float(odds[b]) for b in suffix_buckets(host, path)]

    def verdicts(self, rows: list[tuple[str | None, str, str]]) -> list[str]:
        if self.forest is None or not rows:
            return [self.only] * len(rows)
        p = self.forest.scores(np.array([self.features(*r) for r in rows]))
        return ["block" if v >= 0.5 else "allow" for v in p.tolist()]


def _decided(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """url and blocked (1 or 0) of the URLs that a rule decides."""

    def make() -> Step:
        own = Rules(rules)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            urls, blocked = [], []
            for url in batch.column("url").to_pylist():
                if found := own.match(*parts(url)):
                    urls.append(url)
                    blocked.append(int(found[1] == "block"))
            return pa.record_batch([pa.array(urls, pa.string()), pa.array(blocked, pa.int32())], names=["url", "blocked"])

        return step

    return map_batches(pages.select("url"), make, "url string, blocked int")


def fit(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_rows: int = 20_000) -> Model:
    """Suffix statistics of all decided URLs, and trees from a sample of at most
    ``max_rows`` distinct ones, chosen by a hash of the URL and weighed by how
    often each occurs, so that a URL that is everywhere is one row."""
    decided = _decided(pages, rules)

    def counts() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, b = np.zeros((2, FOLDS, BUCKETS + 1), np.int64)  # the last bucket is of all URLs
            for url, blocked in zip(batch.column("url").to_pylist(), batch.column("blocked").to_pylist(), strict=True):
                fold = fold_of(url)
                for bucket in [*suffix_buckets(*parts(url)), BUCKETS]:
                    n[fold, bucket] += 1
                    b[fold, bucket] += blocked
            seen = np.flatnonzero(n.sum(axis=0))
            return pa.record_batch([pa.array(seen), *map(pa.array, n[:, seen]), *map(pa.array, b[:, seen])], names=["bucket", *names])

        return step

    names = [f"{c}{fold}" for c in "nb" for fold in range(FOLDS)]
    summed = map_batches(decided, counts, ", ".join(f"{c} long" for c in ["bucket", *names])).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
    table = summed.toArrow()  # at most BUCKETS + 1 rows
    n, b = np.zeros((2, FOLDS, BUCKETS + 1))
    at = table.column("bucket").to_numpy()
    for k in range(FOLDS):
        n[k, at], b[k, at] = table.column(f"n{k}").to_numpy(), table.column(f"b{k}").to_numpy()
    total, blocked = n[:, BUCKETS].sum(), b[:, BUCKETS].sum()
    if total == 0 or blocked in (0, total):
        return Model(None, "block" if total and blocked == total else "allow", np.zeros(BUCKETS))
    share = blocked / total
    suffixes = suffix_odds(n.sum(axis=0), b.sum(axis=0), share)
    others = [suffix_odds(n.sum(axis=0) - n[k], b.sum(axis=0) - b[k], share) for k in range(FOLDS)]
    distinct = decided.groupBy("url", "blocked").agg(F.count("*").alias("n"))
    # the first by hash, so no more than ``max_rows`` come to the driver
    rows = sorted((r[0], r[1], r[2]) for r in distinct.orderBy(F.xxhash64("url"), "url").limit(max_rows).collect())
    labels = np.array([r[1] for r in rows], float)
    weights = np.array([r[2] for r in rows], float)
    if not 0 < labels.sum() < len(labels):
        return Model(None, "block" if share >= 0.5 else "allow", suffixes)
    model = Model(None, "allow", suffixes)
    x = np.array([model.features(url, *parts(url), others[fold_of(url)]) for url, *_ in rows])
    return Model(grow(x, labels, weights * len(weights) / weights.sum()), "allow", suffixes)


def judge(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""

    def make() -> Step:
        own = Rules(rules)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            urls = batch.column("url").to_pylist()
            split = [parts(u) for u in urls]
            found = [own.match(*p) for p in split]
            verdicts = [f[1] if f else "" for f in found]
            open_ = [k for k, f in enumerate(found) if f is None]
            for k, verdict in zip(open_, model.verdicts([(urls[k], *split[k]) for k in open_]), strict=True):
                verdicts[k] = verdict
            texts = ([p[0] for p in split], [p[1] for p in split], [f[0] if f else None for f in found], verdicts)
            return pa.record_batch(
                [batch.column("page_id"), *(pa.array(c, pa.string()) for c in texts)], names=["page_id", "host", "path", "rule", "verdict"])

        return step

    return map_batches(
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")), make, "page_id long, host string, path string, rule string, verdict string")
