"""Hard negatives by Fagin's threshold algorithm.

Components become whole numbers, floor(256 * x), and a score is an inner
product. An anchor's positives are its best rows of the same label; a hard
negative of a positive is a row of another label whose score lies in the window
from 80 % to 100 % of the positive's.

Candidates are dealt to shards of bounded size. A shard keeps, for every
dimension, its rows sorted by that component. An anchor reads all lists at
once, from the top where its own component is positive and from the bottom
where it is negative (sorted access); every row met for the first time is
scored in whole numbers (random access). The components last read, weighed by
the anchor, add up to a threshold that no unread row exceeds; reading stops
once it falls strictly below the kth score of every window, or below the
window's low end where the window holds fewer than k. So ties at the kth place
are always read, and the answer is exact.

Shard and anchors travel as one sorted stream: a task gets the rows of a shard
first, builds the lists once and answers the anchors batch by batch, holding
one shard and one batch. Positives are searched among rows of the anchor's
label alone. Windows are first searched in a bounded sample, whose kth scores
raise the low ends before all rows are read, so that most shards answer little.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component take no part; vectors of one length meet; no row of an
anchor's id is its candidate; equal repeated rows are one anchor and a
candidate each; an anchor without positives, a positive below zero and a window
without rows have no answer; ties go to the smaller vec_id. A product beyond 64
bits is given as the nearest long. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyweave.llm.batches import Step, few, map_batches
from storyweave.session import cut_lineage

SCALE = 256
LONG = (1 << 63) - 1


def whole_vectors(rows: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, dim and v (whole numbers as doubles) of the rows that take part."""

    def make() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, labels, vectors = (batch.column(c) for c in ("vec_id", "label", "embedding"))
            out = []
            for at in range(batch.num_rows):
                value = vectors[at].values
                if value is None or value.null_count:
                    continue
                x = value.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    out.append((ids[at].as_py(), labels[at].as_py(), len(x), np.floor(x * scale).tobytes()))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["vec_id", "label", "dim", "v"])

        return step

    taking_part = rows.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), "embedding").dropna(subset=["vec_id", "label"])
    return map_batches(taking_part, make, "vec_id long, label long, dim int, v binary")


def exact(vectors: np.ndarray, kind: type) -> np.ndarray:
    if kind is object:
        return np.array([int(x) for x in vectors.ravel()], object).reshape(vectors.shape)
    return vectors.astype(kind)


class Lists:
    """The rows of one shard, sorted by each of their components."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T  # a list per dimension
        self.largest = float(np.abs(vectors).max(initial=0))
        self.forms: dict[type, np.ndarray] = {float: vectors}
        self.read = 0

    def form(self, anchor: np.ndarray) -> type:
        """Doubles and longs where every sum of products is exact in them, else Python's integers."""
        most = self.largest * float(np.abs(anchor).max(initial=0)) * max(len(anchor), 1)
        return float if most < 1 << 52 else np.int64 if most < 1 << 62 else object

    def search(self, anchor_id: int, anchor: np.ndarray, skip_label: int | None, windows: list[tuple[int, int]], k: int) -> Iterator[tuple[int, int, int]]:
        """(window, row's id, score) of the ``k`` best in each window (low, high), both included."""
        kind = self.form(anchor)
        if kind not in self.forms:
            self.forms[kind] = exact(self.vectors, kind)
        rows, a = self.forms[kind], exact(anchor, kind)
        n = len(self.ids)
        used = np.flatnonzero(anchor)
        up, down = used[anchor[used] > 0], used[anchor[used] < 0]
        open_rows = self.ids != anchor_id
        if skip_label is not None:
            open_rows &= self.labels != skip_label
        unread = np.ones(n, bool)
        found: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        best = [np.zeros(0, kind if kind is object else np.int64) for _ in windows]
        depth, start = 0, 16
        while depth < n:
            to = min(n, depth * 4 or start)
            met = np.zeros(n, bool)
            if len(used):
                met[self.order[up, n - to : n - depth].ravel()] = True
                met[self.order[down, depth:to].ravel()] = True
            else:  # a zero anchor scores zero with all rows
                met[:], to = True, n
            new = np.flatnonzero(met & unread)
            unread[new] = False
            new = new[open_rows[new]]
            self.read += len(new)
            got = rows[new] @ a
            if kind is object:
                got = np.array([max(-LONG - 1, min(LONG, x)) for x in got], object)
            else:
                got = got.astype(np.int64)
            found.append(new)
            scores.append(got)
            for w, (low, high) in enumerate(windows):
                inside = np.sort(np.concatenate([best[w], got[(got >= low) & (got <= high)]]))
                best[w] = inside[-k:]
            depth = to
            if depth < n and len(used):
                ends = np.empty(len(used), a.dtype)
                ends[anchor[used] > 0] = rows[self.order[up, n - depth], up]
                ends[anchor[used] < 0] = rows[self.order[down, depth - 1], down]
                threshold = ends @ a[used]
                # a window that is not full yet may be filled by any score down to its low end
                if all(threshold < (best[w][0] if len(best[w]) == k else low) for w, (low, _) in enumerate(windows)):
                    break
        at, got = np.concatenate(found), np.concatenate(scores)
        for w, (low, high) in enumerate(windows):
            if not len(best[w]):
                continue
            inside = np.flatnonzero((got >= best[w][0]) & (got >= low) & (got <= high))
            ids, values = self.ids[at[inside]], got[inside]
            # best first, ties to the smaller id
            first = np.lexsort((ids, -values))[:k] if kind is not object else sorted(range(len(ids)), key=lambda i: (-values[i], ids[i]))[:k]
            for i in first:
                yield w, int(ids[i]), int(values[i])


STREAM = "vec_id long, label long, dim int, v binary, anchor long, windows array<struct<place:int,low:long,high:long>>"


def answer(stream: DataFrame, shard: list[str], k: int, other_label: bool) -> DataFrame:
    """anchor, place, vec_id, score of each window's best rows in each shard.
    Rows without ``anchor`` are the shard's candidates, the others ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, lists = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in shard), strict=True))
            ids, labels, vectors, anchors, windows = (batch.column(c).to_pylist() for c in ("vec_id", "label", "v", "anchor", "windows"))
            out: list[tuple[int, int, int, int]] = []
            for at, of in enumerate(keys):
                if of != key:
                    key, waiting, lists = of, [], None
                if anchors[at] is None:
                    waiting.append((ids[at], labels[at], vectors[at]))
                    continue
                if lists is None:
                    if not waiting:
                        continue
                    own_ids, own_labels, own = zip(*waiting, strict=True)
                    lists = Lists(np.array(own_ids), np.array(own_labels), np.frombuffer(b"".join(own)).reshape(len(own), -1))
                    waiting = []
                asked = [(w["low"], w["high"]) for w in windows[at]]
                for w, i, score in lists.search(ids[at], np.frombuffer(vectors[at]), labels[at] if other_label else None, asked, k):
                    out.append((anchors[at], windows[at][w]["place"], i, score))
            if out:
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor", "place", "vec_id", "score"])

    dealt = stream.repartition(*shard).sortWithinPartitions(*shard, F.col("anchor").isNotNull())
    return dealt.mapInArrow(run, "anchor long, place int, vec_id long, score long")


def search(candidates: DataFrame, anchors: DataFrame, by: list[str], k: int, shard_rows: int, other_label: bool) -> DataFrame:
    """The best ``k`` rows of each window of each anchor, among candidates that
    agree in ``by``, with their rank. ``candidates`` has a column ``row`` that tells rows apart."""
    sizes = few(candidates.groupBy(*by).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")))
    dealt = candidates.join(sizes, by).select(
        "vec_id", "label", "dim", "v", F.lit(None).cast("long").alias("anchor"),
        F.lit(None).cast("array<struct<place:int,low:long,high:long>>").alias("windows"),
        F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"),
    )
    asking = anchors.join(sizes, by).select(
        "vec_id", "label", "dim", "v", "anchor", "windows", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    found = answer(dealt.unionByName(asking), [*by, "part"], k, other_label)
    order = W.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5,
    low_percent: int = 80, shard_rows: int = 16384, seeds: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    whole = whole_vectors(rows, F.col("label") if label is None else label)
    vectors = cut_lineage(whole.withColumn("row", F.monotonically_increasing_id()))
    everything = F.array(F.struct(F.lit(1).alias("place"), F.lit(-LONG - 1).alias("low"), F.lit(LONG).alias("high")))
    anchors = vectors.where(is_anchor).groupBy("vec_id", "label", "dim", "v").agg(F.min("row").alias("anchor"))
    near = search(vectors, anchors.withColumn("windows", everything), ["dim", "label"], positives, shard_rows, False)
    near = cut_lineage(near.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # score >= low_percent of the positive's, in whole numbers: the least such score is a rounded-up quotient
    product = F.lit(low_percent).cast("decimal(3,0)") * F.col("positive_score")
    low = (-F.floor(-product / 100)).cast("long")
    windows = near.where("positive_score >= 0").withColumn("low", low)

    def ask(bounds: DataFrame) -> DataFrame:
        listed = bounds.groupBy("anchor").agg(F.collect_list(F.struct("place", "low", F.col("positive_score").alias("high"))).alias("windows"))
        return anchors.join(listed, "anchor")

    count = vectors.count()
    share = int(min(1.0, seeds / max(count, 1)) * (1 << 30))
    sample = vectors.where(F.pmod(F.xxhash64("row", F.lit("seed")), F.lit(1 << 30)) < share)
    seen = search(sample, ask(windows), ["dim"], negatives, shard_rows, True)
    raised = seen.where(F.col("rank") == negatives).select("anchor", "place", F.col("score").alias("least"))
    bounds = windows.join(raised, ["anchor", "place"], "left").withColumn("low", F.greatest("low", "least"))
    found = search(vectors, ask(bounds), ["dim"], negatives, shard_rows, True)
    return (
        found.join(near, ["anchor", "place"])
        .join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def rotated(every: int = 7, labels: int = 10) -> Column:
    """The label of a row, moved on by one for rows whose id ``every`` divides."""
    return F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
