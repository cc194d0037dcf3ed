"""What a task does with the rows of two tiles: best matches, peaks, links.

Tiles may be large, so that few copies of a row travel. A task multiplies them
block by block in single precision, which bounds every score to within ``SINGLE``;
only pairs that may count by that bound are computed in double precision. Pairs of
sets with an overlap of ``OVERLAP`` or more are found by a prefix of their rarest
entities instead, so that the bound of all other pairs is far below the floor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SCORE_DIGITS = 9

#: More than the error of a cosine in single precision.
SINGLE = 2e-5

#: Overlap of entities from which on pairs are found by their sets.
OVERLAP = 0.5

#: Tiles of fewer pairs are multiplied only; the sets of larger ones are joined too.
SET_JOIN_PAIRS = 1 << 14

#: Rows of a block and columns of a chunk that are multiplied at once, and pairs that are computed in full at once.
BLOCK, CHUNK, PAIRS = 512, 4096, 1 << 16


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A row per vector, all of one length."""
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def squares(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.concatenate([
            (x * x).sum(axis=1) for x in (vectors[at:at + CHUNK].astype(np.float64) for at in range(0, len(vectors), CHUNK))
        ] or [np.zeros(0)])


def singles(vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray | None:
    """Unit vectors in single precision, zero where there is no direction; none if lengths are too odd for that."""
    known = np.isfinite(lengths) & (lengths > 0)
    if not ((lengths[known] > 1e-100) & (lengths[known] < 1e100)).all():
        return None
    out = np.zeros(vectors.shape, np.float32)
    np.divide(vectors, np.sqrt(np.where(known, lengths, 1.0))[:, None], out=out, where=known[:, None], casting="same_kind")
    return out


def exact_cosines(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Cosines row by row; ``la`` and ``lb`` are the squares of the lengths."""
    with np.errstate(all="ignore"):
        cos = np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)) / np.sqrt(la * lb)
    return np.where(np.isfinite(cos), np.clip(cos, -1.0, 1.0), 0.0)


class Sets:
    """Sets of keys, row after row."""

    def __init__(self, column: pa.ChunkedArray, order: np.ndarray):
        values = column.combine_chunks().take(pa.array(order))
        self.sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.keys = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)


def spread_out(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ranges, and the places in it, range after range."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class Overlaps:
    """Overlaps of the sets of two tiles, for chosen pairs."""

    def __init__(self, a: Sets, b: Sets):
        self.a, self.b = a, b
        self.known, codes = np.unique(np.concatenate([a.keys, b.keys]), return_inverse=True)
        self.codes = codes[: len(a.keys)], codes[len(a.keys):]
        self.marks = np.sort(b.owner * np.int64(len(self.known) + 1) + self.codes[1])

    def jaccards(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        which, at = spread_out(self.a.starts[rows], self.a.sizes[rows])
        wanted = cols[which] * np.int64(len(self.known) + 1) + self.codes[0][at]
        place = np.searchsorted(self.marks, wanted)
        place[place == len(self.marks)] = 0
        hit = self.marks[place] == wanted if len(self.marks) else np.zeros(len(wanted), bool)
        common = np.bincount(which[hit], minlength=len(rows))
        union = self.a.sizes[rows] + self.b.sizes[cols] - common
        return np.divide(common, union, out=np.zeros(len(rows)), where=union > 0)

    def likely(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows, some of them more than once, with every pair whose overlap is ``least`` or more:
        prefixes of the rarest keys, of sets of like size, have a key in common."""
        counts = np.bincount(np.concatenate(self.codes), minlength=len(self.known))
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        tokens, owners = [], []
        for sets, codes in zip((self.a, self.b), self.codes, strict=True):
            ranks = np.sort(sets.owner * np.int64(len(counts) + 1) + rank[codes]) % np.int64(len(counts) + 1)
            length = np.where(sets.sizes > 0, sets.sizes - np.ceil(least * sets.sizes - 1e-9).astype(np.int64) + 1, 0)
            which, at = spread_out(sets.starts, np.minimum(length, sets.sizes))
            order = np.argsort(ranks[at], kind="stable")
            tokens.append(ranks[at][order])
            owners.append(which[order])
        first, last = (np.searchsorted(tokens[1], tokens[0], side) for side in ("left", "right"))
        ends = np.cumsum(last - first)
        at = 0
        while at < len(first):
            # at least one key's rows, however many, and about 16 times PAIRS
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 16 * PAIRS, "right")))
            which, place = spread_out(first[at:stop], (last - first)[at:stop])
            rows, cols = owners[0][at:stop][which], owners[1][place]
            small = np.minimum(self.a.sizes[rows], self.b.sizes[cols])
            alike = small >= least * np.maximum(self.a.sizes[rows], self.b.sizes[cols]) - 1e-9
            yield rows[alike], cols[alike]
            at = stop


class _Items:
    def __init__(self, table: pa.Table):
        ts = table.column("ts").combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False)
        order = np.argsort(ts, kind="stable")
        self.ts = ts[order]
        self.ids, self.floor = (table.column(c).to_numpy()[order] for c in ("item_id", "floor"))
        self.new, self.candidate = (table.column(c).to_numpy().astype(bool)[order] for c in ("is_new", "is_candidate"))
        self.vectors = matrix(table.column("vec"))[order]
        self.lengths = squares(self.vectors)
        self.units = singles(self.vectors, self.lengths)
        self.entities, self.links = (Sets(table.column(c), order) for c in ("entities", "links"))
        self.dated = not np.isnan(self.ts).any()
        # the best match so far; a score must exceed the floor
        self.best, self.match = self.floor.copy(), np.full(len(order), -1, np.int64)

    def offer(self, rows: np.ndarray, score: np.ndarray, match: np.ndarray) -> None:
        order = np.lexsort((match, -score, rows))
        order = order[np.r_[True, np.diff(rows[order]) > 0]] if len(order) else order
        rows, score, match = rows[order], score[order], match[order]
        better = (score > self.best[rows]) | ((score == self.best[rows]) & (self.match[rows] >= 0) & (match < self.match[rows]))
        self.best[rows[better]], self.match[rows[better]] = score[better], match[better]


class _Matching:
    def __init__(self, left: _Items, right: _Items, cosine_weight: float, entity_weight: float, window_us: float):
        self.left, self.right = left, right
        self.weights, self.window = (cosine_weight, entity_weight), window_us
        self.entities, self.links = Overlaps(left.entities, right.entities), Overlaps(left.links, right.links)
        self.floor = min(left.floor.min(), right.floor.min())
        # a floor of zero or less is reached at any distance
        self.dated = left.dated and right.dated and self.floor > 0
        self.slack = SINGLE * abs(cosine_weight) + 1e-6
        self.fast = left.units is not None and right.units is not None
        if self.fast:
            # one more dimension adds what links may add, where both sides have some
            sides = [np.concatenate([x.units, (x.links.sizes > 0)[:, None]], axis=1, dtype=np.float32) for x in (left, right)]
            sides[0] *= np.r_[np.full(left.units.shape[1], cosine_weight), 0.10].astype(np.float32)
            self.sides = sides

    def decay(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        gap = np.abs(self.left.ts[rows] - self.right.ts[cols])
        return np.where(np.isnan(gap), 1.0, np.maximum(0.0, 1.0 - gap / self.window))

    def run(self, one: bool) -> None:
        """``one`` says that both sides are the same tile, of which each pair is met once."""
        most = 1.0
        if self.fast and len(self.left.ids) * len(self.right.ids) >= SET_JOIN_PAIRS:
            most = OVERLAP
            for rows, cols in self.entities.likely(OVERLAP):
                if one:
                    rows, cols = rows[rows < cols], cols[rows < cols]
                for at in range(0, len(rows), PAIRS):
                    r, c = rows[at:at + PAIRS], cols[at:at + PAIRS]
                    self.consider(r, c, np.einsum("ij,ij->i", self.sides[0][r], self.sides[1][c]), 1.0)
        for at in range(0, len(self.left.ids), BLOCK):
            block = slice(at, min(at + BLOCK, len(self.left.ids)))
            first, last = at if one else 0, len(self.right.ids)
            if self.dated:
                # nothing that is further apart reaches the floor
                reach = self.window * (1.0 - self.floor) + 1.0
                first = max(first, int(np.searchsorted(self.right.ts, self.left.ts[block.start] - reach, "left")))
                last = int(np.searchsorted(self.right.ts, self.left.ts[block.stop - 1] + reach, "right"))
            for start in range(first, last, CHUNK):
                self.multiply(block, slice(start, min(start + CHUNK, last)), most)

    def multiply(self, block: slice, chunk: slice, most: float) -> None:
        if not self.fast:
            rows, cols = np.indices((block.stop - block.start, chunk.stop - chunk.start)).reshape(2, -1)
            for at in range(0, len(rows), PAIRS):
                self.consider(rows[at:at + PAIRS] + block.start, cols[at:at + PAIRS] + chunk.start, None, 1.0)
            return
        near = 1.0
        if self.dated:
            a, b = self.left.ts, self.right.ts
            gap = max(0.0, b[chunk.start] - a[block.stop - 1], a[block.start] - b[chunk.stop - 1])
            near = max(1.0 - gap / self.window, 1e-9)
        score = self.sides[0][block] @ self.sides[1][chunk].T
        least = self.floor / near if self.floor > 0 else -np.inf
        found = np.flatnonzero(score.ravel() > np.float32(least - max(0.0, self.weights[1]) * most - self.slack))
        for at in range(0, len(found), PAIRS):
            some = found[at:at + PAIRS]
            rows, cols = np.divmod(some, chunk.stop - chunk.start)
            self.consider(rows + block.start, cols + chunk.start, score.ravel()[some], most)

    def consider(self, rows: np.ndarray, cols: np.ndarray, bound: np.ndarray | None, most: float) -> None:
        """Score the pairs that may be better than what their rows have. ``bound`` is
        the weighted cosine with what links may add; overlaps above ``most`` are met elsewhere."""
        a, b = self.left, self.right
        i, j = a.ids[rows], b.ids[cols]
        asks = [a.new[rows] & b.candidate[cols] & (~b.new[cols] | (j < i)) & (i != j),
                b.new[cols] & a.candidate[rows] & (~a.new[rows] | (i < j)) & (i != j)]
        decay = self.decay(rows, cols)
        if bound is not None:
            sizes = a.entities.sizes[rows], b.entities.sizes[cols]
            ratio = np.minimum(*sizes) / np.maximum(1, np.maximum(*sizes))
            top = np.minimum(1.0, bound + self.slack + max(0.0, self.weights[1]) * np.minimum(most, ratio)) * decay
            asks[0] &= top >= a.best[rows] - 1e-8
            asks[1] &= top >= b.best[cols] - 1e-8
        keep = np.flatnonzero(asks[0] | asks[1])
        if not len(keep):
            return
        rows, cols, decay, asks = rows[keep], cols[keep], decay[keep], [x[keep] for x in asks]
        cos = exact_cosines(a.vectors[rows], b.vectors[cols], a.lengths[rows], b.lengths[cols])
        score = self.weights[0] * cos + self.weights[1] * self.entities.jaccards(rows, cols)
        score = np.round(np.minimum(1.0, score + 0.10 * self.links.jaccards(rows, cols)) * decay, SCORE_DIGITS)
        a.offer(rows[asks[0]], score[asks[0]], b.ids[cols[asks[0]]])
        b.offer(cols[asks[1]], score[asks[1]], a.ids[rows[asks[1]]])


_MATCHES = pa.schema([("item_id", pa.int64()), ("score", pa.float64()), ("match_id", pa.int64())])


def best_match(cosine_weight: float, entity_weight: float, window_us: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best match of each new item of two tiles: item_id, score, match_id."""
    schema = _MATCHES

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        one = left.column("tile")[0] == right.column("tile")[0]
        a = _Items(left)
        sides = [a] if one else [a, _Items(right)]
        _Matching(a, sides[-1], cosine_weight, entity_weight, window_us).run(one)
        found = [(x, np.flatnonzero(x.match >= 0)) for x in sides]
        return pa.table([
            pa.array(np.concatenate([values(x)[at] for x, at in found])) for values in
            (lambda x: x.ids.astype(np.int64), lambda x: x.best, lambda x: x.match)
        ], schema=schema)

    return kernel


class _Stories:
    def __init__(self, table: pa.Table):
        ts = table.column("ts").to_numpy()
        order = np.argsort(ts, kind="stable")
        self.ids, self.ts, self.reach = table.column("story_id").to_numpy()[order], ts[order], table.column("reach").to_numpy()[order]
        self.asks = table.column("asks").to_numpy().astype(bool)[order]
        self.vectors = matrix(table.column("vec"))[order]
        self.lengths = squares(self.vectors)
        self.units = singles(self.vectors, self.lengths)
        self.peak = np.full(len(order), -np.inf)


def _raise_peaks(later: _Stories, earlier: _Stories) -> None:
    """Closest of the earlier stories. Rows are in the order of their times, so priors are a range."""
    asks = np.flatnonzero(later.asks)
    for at in range(0, len(asks), BLOCK):
        rows = asks[at:at + BLOCK]
        first = np.searchsorted(earlier.ts, later.ts[rows] - later.reach[rows], "left")
        last = np.searchsorted(earlier.ts, later.ts[rows], "left")
        for start in range(int(first.min()), int(last.max()), CHUNK):
            stop = min(start + CHUNK, int(last.max()))
            cols = np.arange(start, stop)
            if later.units is None or earlier.units is None:
                a, b = (x.astype(np.float64) for x in (later.vectors[rows], earlier.vectors[start:stop]))
                with np.errstate(all="ignore"):
                    cos = (a @ b.T) / np.sqrt(np.outer(later.lengths[rows], earlier.lengths[start:stop]))
                cos, slack = np.where(np.isfinite(cos), np.clip(cos, -1.0, 1.0), 0.0), 0.0
            else:
                cos, slack = later.units[rows] @ earlier.units[start:stop].T, SINGLE
            if first.max() > start or last.min() < stop:
                cos[(cols < first[:, None]) | (cols >= last[:, None])] = -np.inf
            most = cos.max(axis=1)
            if slack == 0.0:
                later.peak[rows] = np.maximum(later.peak[rows], most)
                continue
            open_ = np.flatnonzero(most > later.peak[rows] - slack)
            least = np.maximum(most[open_] - 2 * slack, later.peak[rows[open_]] - slack)
            i, j = np.nonzero((cos[open_] >= least[:, None]) & np.isfinite(cos[open_]))
            for k in range(0, len(i), PAIRS):
                r, c = rows[open_[i[k:k + PAIRS]]], start + j[k:k + PAIRS]
                np.maximum.at(later.peak, r, exact_cosines(later.vectors[r], earlier.vectors[c], later.lengths[r], earlier.lengths[c]))


_PEAKS = pa.schema([("story_id", pa.int64()), ("peak", pa.float64())])


def prior_peak(left: pa.Table, right: pa.Table) -> pa.Table:
    """The highest cosine of each story that asks with an earlier one of the two tiles."""
    if not left.num_rows or not right.num_rows:
        return _PEAKS.empty_table()
    sides = [_Stories(left)]
    if left.column("tile")[0] == right.column("tile")[0]:
        _raise_peaks(sides[0], sides[0])
    else:
        sides.append(_Stories(right))
        _raise_peaks(*sides)
        _raise_peaks(*reversed(sides))
    found = [(x, np.flatnonzero(np.isfinite(x.peak))) for x in sides]
    return pa.table([
        pa.array(np.concatenate([x.ids[at].astype(np.int64) for x, at in found])), pa.array(np.concatenate([x.peak[at] for x, at in found])),
    ], schema=_PEAKS)


_LINKS = pa.schema([("i", pa.int64()), ("j", pa.int64())])


def links(floor: float, label: str = "component") -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Links between rows of two tiles that connect what all their pairs with a cosine of ``floor`` or
    more connect, given what ``label`` says is connected already. Pairs inside one label are not multiplied."""
    schema = _LINKS

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        one = left.column("tile")[0] == right.column("tile")[0]
        tables = [left] if one else [left, right]
        ids = np.concatenate([t.column("row_id").to_numpy() for t in tables])
        labels = np.unique(np.concatenate([t.column(label).to_numpy() for t in tables]), return_inverse=True)[1]
        vectors = np.concatenate([matrix(t.column("vec")) for t in tables])
        lengths = squares(vectors)
        units = singles(vectors, lengths)
        last = left.num_rows
        # columns are the rows of the right tile
        places = np.arange(0 if one else last, len(ids))
        i, j = [], []
        for at in range(0, last, 64):
            rows = np.arange(at, min(at + 64, last))
            # rows of the most frequent label have nothing to ask of the others that have it
            top = np.bincount(labels).argmax()
            outside = labels[rows] != top
            asked = [(rows[outside], places), (rows[~outside], places[labels[places] != top])]
            for rows, part in ((r, c[start:start + (1 << 15)]) for r, c in asked if len(r) for start in range(0, len(c), 1 << 15)):
                if units is None:
                    r, c = (x.ravel() for x in np.meshgrid(rows, part, indexing="ij"))
                else:
                    r, c = np.nonzero(units[rows] @ units[part].T > floor - SINGLE)
                    r, c = rows[r], part[c]
                for k in range(0, len(r), PAIRS):
                    p, q = r[k:k + PAIRS], c[k:k + PAIRS]
                    open_ = labels[p] != labels[q]
                    p, q = p[open_], q[open_]
                    near = np.round(exact_cosines(vectors[p], vectors[q], lengths[p], lengths[q]), SCORE_DIGITS) >= floor
                    for a, b in zip(p[near].tolist(), q[near].tolist(), strict=True):
                        if labels[a] != labels[b]:
                            i.append(a)
                            j.append(b)
                            labels[labels == labels[b]] = labels[a]
        a, b = (ids[np.array(x, np.int64)].astype(np.int64) for x in (i, j))
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    return kernel
