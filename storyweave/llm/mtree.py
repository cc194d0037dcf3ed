"""Exact top-k search by inner product over a forest of M-trees.

Vectors become whole numbers, floor(1024 * x). With one more coordinate,
sqrt(M - |v|^2) for the largest squared length M, the largest inner product is
the smallest Euclidean distance, so a metric tree answers it. A tree holds a
bounded number of rows that lie near the same pivot; a page of it is a routing
object's entries, each with its covering radius and its distance to the
routing object. A search opens the page with the least possible distance first
and skips, by the triangle inequality over the stored distances, entries whose
distance need not be computed. Whatever the trees prune is proven to be out, so
the answer is exact; scores are compared as whole numbers.

Stated queries meet all trees in blocks: a task gets some trees and the query
blocks one after the other, and answers at most k rows per query and tree. A
sample of rows gives each query a first bound, so most trees answer less.

Defined cases: vectors that are null or hold a null or a non-finite component
take no part, like rows without an id. Vectors with a squared length of 2^60 or
more, as whole numbers, stand in trees of their own and are compared in Python's
integers; a score beyond 64 bits counts as the nearest long, in ties too. Only vectors of one length meet; a query is not its own candidate, nor is
any row of its id; equal repeated rows of a query are one query, and of a
candidate are candidates each; ties go to the smaller vec_id. Extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyweave.llm.batches import Step, map_batches
from storyweave.session import cut_lineage, shuffle_partitions

SCALE = 1024
SLACK = 1e-6
SMALL = 2.0**60  # squared length under which components take 32 bits and inner products 64
LEAST_LONG, GREATEST_LONG = -(1 << 63), (1 << 63) - 1


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, dim, v, norm2 and big of the vectors that take part: v holds
    whole components of 32 bits, or, where that is too little (big), the doubles
    as they came, and norm2 is 0."""

    def make() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, vectors = batch.column("vec_id").to_pylist(), batch.column("embedding")
            out = []
            for at, i in enumerate(ids):
                value = vectors[at].values
                if i is None or value is None or value.null_count:
                    continue
                raw = value.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(raw).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(raw * SCALE)
                    small = float(x @ x) < SMALL
                if small:
                    v = x.astype(np.int32)
                    out.append((i, len(v), v.tobytes(), int(v.astype(np.int64) @ v.astype(np.int64)), False))
                else:
                    out.append((i, len(raw), raw.tobytes(), 0, True))
            columns = list(zip(*out, strict=True)) or [(), (), (), (), ()]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_())
            names = ["vec_id", "dim", "v", "norm2", "big"]
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

        return step

    return map_batches(
        rows.select(F.col("vec_id").cast("long"), "embedding"), make, "vec_id long, dim int, v binary, norm2 long, big boolean"
    )


def unpack(values: list[bytes], dim: int, big: bool = False) -> np.ndarray:
    """Rows of whole components: 64 bits, or Python's integers for big vectors."""
    if not big:
        return np.frombuffer(b"".join(values), np.int32).reshape(len(values), dim).astype(np.int64)
    out = np.empty((len(values), dim), object)
    for row, raw in zip(out, values, strict=True):
        # beyond 2^53 every double is whole, and 1024 times it may be no double
        row[:] = [math.floor(x * SCALE) if abs(x) < 1 << 43 else int(x) * SCALE for x in np.frombuffer(raw, np.float64).tolist()]
    return out


def exact_type(largest: int) -> type:
    """Doubles hold every partial sum of an inner product if no squared length
    reaches 2^53, whole numbers of 64 bits up to 2^60, Python's integers all."""
    return np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 60 else object


def roots(squares: np.ndarray, shift: int = 0) -> np.ndarray:
    """Square roots of numbers that are not negative, in units of 2^(shift/2);
    those of Python's integers are cut to whole ones, and infinite beyond 2^1000."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([float(math.isqrt(x >> shift)) if x >> shift < 1 << 2000 else np.inf for x in squares.tolist()], np.float64)


def as_longs(scores: np.ndarray) -> np.ndarray:
    return np.array([max(LEAST_LONG, min(GREATEST_LONG, x)) for x in scores.tolist()], object)


class Tree:
    """Pages over the rows of one tree. A page is (entries' rows, radii, distances
    to the page's routing object, child pages); a leaf has neither radii nor children."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: int, capacity: int = 256):
        self.ids, self.vectors = ids, vectors
        self.norm2 = (vectors * vectors).sum(axis=1)
        self.shift = 2 * max(0, largest.bit_length() // 2 - 500)
        self.extra = roots(np.maximum(largest - self.norm2, 0), self.shift)
        self.largest = largest
        self.pages: list[tuple[np.ndarray, np.ndarray | None, np.ndarray, list[int] | None]] = []
        everything = np.arange(len(ids))
        self.root = self._page(everything, 0, self._distances(0, everything), capacity)
        self.computed = 0
        # the rows of a leaf stand side by side
        order = np.concatenate([rows for rows, *_, children in self.pages if children is None])
        place = np.empty(len(order), np.int64)
        place[order] = everything
        self.pages = [(place[rows], radii, stored, children) for rows, radii, stored, children in self.pages]
        self.top = int(place[0])
        self.ids, self.vectors = self.ids[order], self.vectors[order]
        del self.norm2, self.extra

    def pack(self) -> bytes:
        state = vars(self) if self.vectors.dtype == object else dict(vars(self), vectors=self.vectors.astype(np.int32))
        return pickle.dumps(state, 5)

    @classmethod
    def unpack(cls, packed: bytes) -> Tree:
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(packed))
        tree.vectors = tree.vectors.astype(exact_type(tree.largest))
        return tree

    def _distances(self, row: int, others: np.ndarray) -> np.ndarray:
        d2 = self.norm2[row] + self.norm2[others] - 2 * (self.vectors[others] @ self.vectors[row])
        if d2.dtype == object:
            return np.hypot(roots(np.maximum(d2, 0), self.shift), self.extra[row] - self.extra[others])
        return np.sqrt(np.maximum(d2 + (self.extra[row] - self.extra[others]) ** 2, 0.0))

    def _page(self, rows: np.ndarray, routing: int, to_routing: np.ndarray, capacity: int) -> int:
        if len(rows) <= capacity:
            self.pages.append((rows, None, to_routing, None))
            return len(self.pages) - 1
        # routing objects that lie far from one another, each row with its nearest
        nearest, owner = to_routing.copy(), np.zeros(len(rows), np.int64)
        centres = [routing]
        while len(centres) < min(capacity, -(-len(rows) // (capacity // 2))):
            far = int(np.argmax(nearest))
            if nearest[far] <= 0:
                break
            d = self._distances(int(rows[far]), rows)
            owner[d < nearest] = len(centres)
            nearest = np.minimum(nearest, d)
            centres.append(int(rows[far]))
        groups = [np.flatnonzero(owner == k) for k in range(len(centres))]
        if len(centres) == 1:  # equal rows can't be told apart by distance
            groups = np.array_split(np.arange(len(rows)), -(-len(rows) // capacity))
            centres = [routing] * len(groups)
        entries, radii, children = [], [], []
        for centre, group in zip(centres, groups, strict=True):
            if len(group):
                inside = nearest[group]
                entries.append(centre)
                radii.append(float(inside.max()))
                children.append(self._page(rows[group], centre, inside, capacity))
        at = np.array(entries)
        self.pages.append((at, np.array(radii), self._distances(routing, at), children))
        return len(self.pages) - 1

    def search(self, query_id: int, q: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """Up to ``k`` (score, vec_id), best first. Rows that score under
        ``least`` are known to be out."""
        whole = object in (q.dtype, self.vectors.dtype)  # Python's integers
        vectors = self.vectors.astype(np.int64).astype(object) if whole and self.vectors.dtype != object else self.vectors
        base = int(q @ q) + self.largest
        q = q.astype(vectors.dtype)
        # roots of whole numbers and sums of large ones are off by more than those of small ones
        slack = SLACK * float(roots(np.array([base], object), self.shift)[0]) + 4 if whole else SLACK

        def reach(score: int | None) -> float:
            if score is None or whole and (score == LEAST_LONG or (base - 2 * score) >> self.shift >= 1 << 1900):
                return np.inf
            left = max(base - 2 * score, 0) >> self.shift
            return (float(math.isqrt(left)) if whole else float(np.sqrt(left))) * (1 + SLACK) + slack

        def distance(scores: np.ndarray) -> np.ndarray:
            return roots(np.maximum(base - 2 * scores, 0), self.shift)

        best: list[tuple[int, int]] = []  # a heap of (score, -vec_id), the worst on top
        bound = reach(least)
        d_root = float(distance(vectors[self.top : self.top + 1] @ q)[0])
        queue = [(0.0, self.root, d_root)]
        while queue:
            low, page, d_page = heapq.heappop(queue)
            if low > bound:
                break
            rows, radii, stored, children = self.pages[page]
            # triangle inequality over the stored distances: no new distance is needed to skip these
            near = np.abs(d_page - stored) - (0 if radii is None else radii) <= bound
            count = int(np.count_nonzero(near))
            if not count:
                continue
            self.computed += count
            if children is None:
                at = slice(int(rows[0]), int(rows[0]) + len(rows)) if count == len(rows) else rows[near]
                scores, ids = vectors[at] @ q, self.ids[at]
                if whole:
                    scores = as_longs(scores)
                worst = best[0][0] if len(best) == k else least
                if worst is not None:
                    maybe = scores >= worst
                    scores, ids = scores[maybe], ids[maybe]
                for score, i in zip(scores.astype(np.int64).tolist(), ids.tolist(), strict=True):
                    if i == query_id:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                if len(best) == k:
                    bound = min(bound, reach(best[0][0]))
                continue
            distances = distance(vectors[rows[near]] @ q)
            for place, d, r in zip(np.flatnonzero(near).tolist(), distances.tolist(), radii[near].tolist(), strict=True):
                if max(d - r, 0.0) <= bound:
                    heapq.heappush(queue, (max(d - r, 0.0), children[place], d))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def top_k(
    rows: DataFrame, is_query: Column, k: int = 10, tree_rows: int = 2048, block_rows: int = 256, seeds: int = 1024
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product for
    every row that ``is_query`` names, out of all others. ``seeds`` rows at most
    are sent to every task."""
    vectors = cut_lineage(whole_vectors(rows))
    n, largest = vectors.agg(F.count("*"), F.coalesce(F.max("norm2"), F.lit(0))).first()
    share = min(1.0, seeds / max(n, 1))
    sample = vectors.where(~F.col("big") & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))).orderBy(F.xxhash64("vec_id", "v")).limit(2 * seeds).collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in sample}:
        own = [r for r in sample if r["dim"] == dim]
        by_dim[dim] = (np.array([r["vec_id"] for r in own]), unpack([r["v"] for r in own], dim))
    pivots = max(1, min(256, -(-n // tree_rows)))
    sent = rows.sparkSession.sparkContext.broadcast(by_dim)

    def nearest() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            dims, norms, values = batch.column("dim").to_numpy(), batch.column("norm2").to_numpy(), batch.column("v").to_pylist()
            big = batch.column("big").to_numpy(zero_copy_only=False)
            pivot = np.where(big, -1, 0).astype(np.int32)
            for dim in np.unique(dims).tolist():
                if dim in sent.value:
                    at = np.flatnonzero((dims == dim) & ~big)
                    p = sent.value[dim][1][:pivots].astype(np.float64)
                    x = unpack([values[j] for j in at.tolist()], dim).astype(np.float64)
                    p2 = (p * p).sum(axis=1)
                    extra = (np.sqrt(np.maximum(largest - norms[at], 0))[:, None] - np.sqrt(np.maximum(largest - p2, 0))[None, :]) ** 2
                    pivot[at] = np.argmin(p2[None, :] - 2 * (x @ p.T) + extra, axis=1)
            return pa.record_batch([*batch.columns, pa.array(pivot)], names=[*batch.schema.names, "pivot"])

        return step

    near = map_batches(vectors, nearest, "vec_id long, dim int, v binary, norm2 long, big boolean, pivot int")
    # rows near one pivot, however many, are dealt to trees of bounded size
    sizes = near.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / tree_rows).alias("trees"))
    dealt = near.join(sizes, ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v", F.lit("part")), F.col("trees")))
    lanes = shuffle_partitions(rows.sparkSession)

    def grow(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        order = np.argsort(group.column("vec_id").to_numpy(), kind="stable")
        values = group.column("v").to_pylist()
        big = group.column("big")[0].as_py()
        own = unpack([values[j] for j in order.tolist()], dim, big)
        longest = int((own * own).sum(axis=1).max()) if big else largest
        tree = Tree(group.column("vec_id").to_numpy()[order], own, longest)
        lane = hash((dim, group.column("pivot")[0].as_py(), group.column("part")[0].as_py())) % lanes
        return pa.table({"dim": pa.array([dim], pa.int32()), "lane": pa.array([lane], pa.int32()), "tree": pa.array([tree.pack()], pa.binary())})

    trees = dealt.groupBy("dim", "pivot", "part").applyInArrow(grow, "dim int, lane int, tree binary")

    queries = vectors.where(is_query).select("vec_id", "dim", "v", "big").distinct()
    blocks_of = F.greatest(F.lit(1), F.ceil(F.lit(queries.count()) / block_rows))
    blocks = (
        queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks_of))
        .groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v", "big")).alias("queries"))  # about block_rows each
        .withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    )
    # a lane's copies of the blocks are made after their size is measured: unasked, all of them would be sent through the driver
    pairs = trees.join(blocks.hint("merge"), ["dim", "lane"]).select("dim", "tree", "queries")

    def search() -> Step:
        bounds: dict[tuple[int, bytes], int | None] = {}

        def least(dim: int, i: int, raw: bytes, q: np.ndarray) -> int | None:
            if (i, raw) not in bounds:
                if len(bounds) > 100_000:
                    bounds.clear()
                ids, seed = sent.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim), np.int64)))
                scores = np.sort((as_longs(seed.astype(object) @ q) if q.dtype == object else seed @ q)[ids != i])
                bounds[i, raw] = int(scores[-k]) if len(scores) >= k else None
            return bounds[i, raw]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple[int, int, int, int]] = []
            for dim, packed, queries in zip(*(batch.column(c) for c in ("dim", "tree", "queries")), strict=True):
                tree = Tree.unpack(packed.as_py())
                for query in queries.as_py():
                    i, raw = query["vec_id"], query["v"]
                    q = unpack([raw], dim.as_py(), query["big"])[0]
                    key = zlib.crc32(raw)
                    out += [(i, key, found, score) for score, found in tree.search(i, q, k, least(dim.as_py(), i, raw, q))]
            table = np.array(out, np.int64).reshape(-1, 4).T
            return pa.record_batch([pa.array(c) for c in table], names=["query_id", "of", "vec_id", "score"])

        return step

    found = map_batches(pairs, search, "query_id long, of long, vec_id long, score long")
    order = W.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
