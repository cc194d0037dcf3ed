"""What a task does with some readers and the cards of their bundle: fits and places.

The rows of a feed are readers times cards, so none of them is moved: readers
come in bunches, each with one copy of the cards of its bundle, and a task
answers reader by reader.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: The feed blend.
RESERVED_FRACTION = 0.15
LOW_FIT = 0.4
FIT_WEIGHT = 0.5

#: What a row may hold.
KINDS = {
    "reader_id": pa.int64(), "bundle_id": pa.string(), "story_id": pa.int64(), "score": pa.float64(), "feed_pos": pa.int64(), "fit": pa.float64(),
    "combined": pa.float64(), "reserved": pa.bool_(), "position": pa.int64(),
}

#: Numbers of fits that are held at once, and rows of a batch.
MOST_FITS, BATCH = 1 << 22, 1 << 16


def _values(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Cards:
    """The cards of a bundle in feed order."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("feed_pos")
        self.columns = {c: _values(table.column(c)).fill_null(np.nan if c == "score" else 0).to_numpy(zero_copy_only=False)
                        for c in ("story_id", "score", "feed_pos")}
        ids = self.columns["story_id"]
        self.by_id = np.argsort(ids, kind="stable")
        self.ids = ids[self.by_id]
        sources = _values(table.column("source_ids"))
        owner = np.repeat(np.arange(len(ids)), sources.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        codes = sources.flatten().dictionary_encode()
        of = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.of_source = {name: owner[of == k] for k, name in enumerate(codes.dictionary.to_pylist())}
        self.vectors = _values(table.column("vector"))
        self.units: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.ids)

    def of_length(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of all cards, and which of them have one of that length."""
        if dims not in self.units:
            out, good = np.zeros((len(self), dims)), np.zeros(len(self), bool)
            rows = np.flatnonzero(self.vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims)
            x = self.vectors.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
            finite = np.isfinite(x).all(axis=1)
            x, rows = x[finite], rows[finite]
            lengths = np.sqrt((x * x).sum(axis=1))
            out[rows], good[rows] = x / np.where(lengths > 0, lengths, 1.0)[:, None], True
            self.units[dims] = out, good
        return self.units[dims]

    def visible(self, selected: list | None, hidden: np.ndarray) -> np.ndarray:
        """The places of the cards of some selected source, of all if none is, that are not hidden."""
        shown = np.ones(len(self), bool)
        if selected:
            shown[:] = False
            for name in selected:
                if name in self.of_source and name is not None:
                    shown[self.of_source[name]] = True
        first, last = (np.searchsorted(self.ids, hidden, side) for side in ("left", "right"))
        for a, b in zip(first[first < last].tolist(), last[first < last].tolist(), strict=True):
            shown[self.by_id[a:b]] = False
        return np.flatnonzero(shown)


def rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    """Rounded half away from zero; no zero is negative."""
    if digits is None:
        return values
    scaled = values * 10.0**digits
    whole = np.trunc(scaled)
    return (whole + np.sign(scaled) * (np.abs(scaled - whole) >= 0.5)) / 10.0**digits + 0.0


def scaled(values: np.ndarray) -> np.ndarray:
    """Scaled to [0, 1]; a constant column becomes 0.5."""
    low, high = np.fmin.reduce(values), np.fmax.reduce(values)
    return np.full(len(values), 0.5) if low == high else (values - low) / (high - low)


def _best_first(values: np.ndarray, most: int | None) -> np.ndarray:
    """Places of the values, the largest first, of equal ones the first; the first ``most`` at least."""
    places = np.arange(len(values))
    if most is not None and most < len(values) and not np.isnan(values).any():
        places = np.flatnonzero(values >= np.partition(values, -most)[-most])
        values = values[places]
    order = np.argsort(-values)
    if (values[order][1:] == values[order][:-1]).any() or np.isnan(values).any():
        order = np.argsort(-values, kind="stable")
    return places[order]


def places(fit: np.ndarray, score: np.ndarray, shown: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which cards, in feed order, of one reader come where: (card, combined, reserved, position).
    Importance and fit are blended; 15% of the places are kept for important cards of low
    fit, spread evenly. ``shown`` keeps the first places."""
    n = len(fit)
    norm_fit, importance = scaled(fit), scaled(score)
    combined = (1 - FIT_WEIGHT) * importance + FIT_WEIGHT * norm_fit
    reserve = math.floor(n * RESERVED_FRACTION + 0.5)
    low = np.flatnonzero(norm_fit <= LOW_FIT)
    if len(low) < reserve:
        low = np.arange(n)
    chosen = low[_best_first(importance[low], reserve)[:reserve]]
    reserved = np.zeros(n, bool)
    reserved[chosen] = True
    rest = np.flatnonzero(~reserved)
    main, taken = len(rest), len(chosen)
    rest = rest[_best_first(combined[rest], shown)]
    step = max(1, main // (taken + 1))
    held, others = np.arange(1, taken + 1), np.arange(1, len(rest) + 1)
    at = np.concatenate([np.minimum(held * (step + 1), main + held), others + np.minimum(taken, (others - 1) // step)])
    card = np.concatenate([chosen, rest])
    if shown is not None:
        card, at = card[at <= shown], at[at <= shown]
    return card, combined[card], reserved[card], at


def feed_rows(columns: list[str], shown: int | None, digits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of a bunch of readers: a group holds rows with a ``card`` and rows with a ``reader``."""
    ordered = shown is not None or not {"combined", "reserved", "position"}.isdisjoint(columns)
    schema = pa.schema([(c, KINDS[c]) for c in columns])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        bundle = group.column("bundle_id")[0].as_py()
        cards, readers = (pa.Table.from_struct_array(_values(group.column(c).drop_null())) for c in ("card", "reader"))
        if not len(cards) or not len(readers):
            return
        cards = Cards(cards)
        waiting: list[list[np.ndarray]] = []
        for batch in readers.to_batches(max(1, min(64, MOST_FITS // len(cards)))):
            for made in of_readers(cards, batch, bundle):
                waiting.append(made)
                if sum(len(m[0]) for m in waiting) >= BATCH:
                    yield together(waiting)
                    waiting = []
        if waiting:
            yield together(waiting)

    def together(waiting: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.concatenate(parts), kind.type) for parts, kind in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)

    def of_readers(cards: Cards, batch: pa.RecordBatch, bundle: str) -> Iterator[list[np.ndarray]]:
        tastes, lacks = batch.column("taste"), batch.column("lack").fill_null(0.0).to_numpy(zero_copy_only=False)
        fits = np.zeros((len(batch), len(cards)))
        lengths = tastes.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        for dims in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == dims)
            units, good = cards.of_length(dims)
            taste = tastes.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            fits[own] = np.where(good, taste @ units.T + lacks[own][:, None], 0.0)
        fits = rounded(fits, digits)
        ids, selected, hidden = (batch.column(c) for c in ("reader_id", "selected", "hidden"))
        for k, reader_id in enumerate(ids.to_pylist()):
            seen = cards.visible(selected[k].as_py(), np.array(hidden[k].as_py() or [], np.int64))
            if not len(seen):
                continue
            fit = fits[k][seen]
            made = {}
            if ordered:
                card, *more = places(fit, cards.columns["score"][seen], shown)
                seen, fit = seen[card], fit[card]
                made = dict(zip(("combined", "reserved", "position"), more, strict=True))
            made |= {"fit": fit, "reader_id": np.full(len(seen), reader_id, np.int64)}
            if "bundle_id" in columns:
                made["bundle_id"] = np.full(len(seen), bundle, object)
            yield [made[c] if c in made else cards.columns[c][seen] for c in columns]

    return rows
