"""How far the sources of a language differ in their use of words.

A language keeps the terms that stand in at least ``min_docs`` of its
documents. A group is a (language, source); its share of a term depends only on
how often the term stands there, its count level, and on sums of the group. So
the divergence of two groups needs no pass over their terms, only the joint
table of their levels: how many terms have level a in one and level b in the
other. Tasks get blocks of terms as one-hot columns, one for each (group,
level), and multiply the transposed block by itself: the product holds the joint
tables of all groups at once, in exact whole numbers. Each cell is priced once
and weighed by its number of terms; blocks add up.

A block takes rows as long as its columns stay within a bound, with terms of
like totals side by side, so rare terms, which share few levels, go by the
thousand, and frequent ones by the dozen. Languages of more sources than
``tile`` are cut into tiles of columns, and a task multiplies one pair of tiles.
Terms are counted per task before anything is shuffled; a language of any size
is dealt over many blocks.

Defined cases: a null text, language or source is empty; groups without words
and languages without kept terms are there, with divergences of zero;
each row is a document, also a repeated one; ties go to the smaller item in
UTF-8; no table of documents gives no rows. Extra columns are ignored. A
divergence beyond a long raises an error rather than wrap.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyweave.llm.batches import few, utf8
from storyweave.session import cut_lineage

SCALE = 1_000_000_000
#: Bytes of a term: letters, folded to lower case, and whatever is not ASCII; the rest are blanks.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def term_counts(docs: DataFrame, held: int = 400_000) -> DataFrame:
    """lang, source, term, n occurrences, docs: partial sums of each task, at most
    ``held`` at a time. A row with an empty term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            parts = [
                pa.record_batch(
                    [pa.repeat(pa.scalar(lang, pa.binary()), len(counts)), pa.repeat(pa.scalar(source, pa.binary()), len(counts)),
                     pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64()),
                     pa.array(map(found.__getitem__, counts), pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
                for (lang, source), (counts, found) in sums.items()
            ]
            sums.clear()
            return pa.concat_batches(parts)

        for batch in batches:
            for text, lang, source in zip(*(utf8(batch.column(c)) for c in ("text", "lang", "source")), strict=True):
                counts, found = sums.setdefault((lang, source), (Counter({b"": 0}), Counter({b"": 0})))
                own = text.translate(_FOLD).split()
                before = len(counts)
                counts.update(own)
                found.update(set(own))
                size += len(counts) - before
                if size >= held:
                    yield flush()
                    size = 0
        if sums:
            yield flush()

    blank = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    raw = blank.mapInArrow(run, "lang binary, source binary, term binary, n long, docs long")
    return raw.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")), "n", "docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), whole numbers throughout."""
    whole = "decimal(20,0)"
    return (F.call_function("div", (n + 1).cast(whole) * F.lit(SCALE).cast("decimal(10,0)"), (total + terms).cast(whole)) + 1).cast("long")


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def column_blocks(levels: np.ndarray, most_columns: int, most_rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Consecutive rows whose one-hot columns stay within ``most_columns``; one row at least."""
    start, n = 0, len(levels)
    while start < n:
        rows = min(most_rows, n - start)
        while rows > 1:
            part = levels[start : start + rows]
            wide = sum(len(np.unique(part[:, g])) for g in range(part.shape[1]))
            if wide <= most_columns:
                break
            rows = max(1, min(rows // 2, rows * most_columns // wide))
        yield start, start + rows
        start += rows


def one_hot(levels: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Indicator columns of (group, level), the levels of each group, and where each group's columns start."""
    found = [np.unique(levels[:, g], return_inverse=True) for g in range(levels.shape[1])]
    starts = np.cumsum([0, *(len(values) for values, _ in found)])
    hot = np.zeros((len(levels), starts[-1]), np.float32)
    at = np.arange(len(levels))
    for g, (_, place) in enumerate(found):
        hot[at, starts[g] + place] = 1
    return hot, [values for values, _ in found], starts


def shares(levels: list[np.ndarray], totals: list[int], terms: int) -> np.ndarray:
    """The share of each column; Python's integers, as a count times SCALE may leave 64 bits."""
    return np.array([1 + SCALE * (int(c) + 1) // (n + terms) for values, n in zip(levels, totals, strict=True) for c in values], np.int64)


def priced(joint: np.ndarray, p: np.ndarray, q: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """For each pair of groups, the prices of the cells of its joint table times the terms in them."""
    each = (p[:, None] - q[None, :]) ** 2 // q[None, :]
    if float(each.max(initial=0)) * float(joint.sum(dtype=np.float64)) >= 2.0**62:
        each, joint = each.astype(object), joint.astype(object)
    return np.add.reduceat(np.add.reduceat(each * joint, rows, axis=0), columns, axis=1)


def joint_prices(left: np.ndarray, right: np.ndarray | None, n_left: list[int], n_right: list[int], terms: int, most_columns: int):
    """Sums of prices for all (group of left, group of right), and of (right, left)
    where there are two tiles. Rows of both are the same terms, cells their counts."""
    both = left if right is None else np.hstack([left, right])
    cut = left.shape[1]
    there = np.zeros((cut, both.shape[1] - cut if right is not None else cut), object)
    back = there.T.copy()
    order = np.argsort(both.sum(axis=1, dtype=np.float64), kind="stable")
    both = both[order]
    for start, end in column_blocks(both, most_columns):
        hot, levels, starts = one_hot(both[start:end])
        if right is None:
            joint = (hot.T @ hot).astype(np.int64)
            p = shares(levels, n_left, terms)
            there += priced(joint, p, p, starts[:-1], starts[:-1])
            continue
        edge = starts[cut]
        joint = (hot[:, :edge].T @ hot[:, edge:]).astype(np.int64)
        p, q = shares(levels[:cut], n_left, terms), shares(levels[cut:], n_right, terms)
        there += priced(joint, p, q, starts[:cut], starts[cut:-1] - edge)
        back += priced(joint.T, q, p, starts[cut:-1] - edge, starts[:cut])
    return there, back


def divergences(kept: DataFrame, groups: DataFrame, tile: int, block_rows: int, most_columns: int) -> DataFrame:
    """lang, source, item, value: a row for each ordered pair of a language's groups.

    ``kept`` has lang, term and counts (source, n); ``groups`` lang, source, total, terms."""
    langs = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / tile).cast("int").alias("tiles"), (F.floor(F.first("terms") / block_rows) + 1).cast("int").alias("blocks")
    )

    def tile_of(source: Column) -> Column:
        return F.pmod(F.xxhash64(source), F.col("tiles")).cast("int")

    tiled = groups.join(few(langs), "lang").withColumn("tile", tile_of(F.col("source")))
    heads = tiled.groupBy("lang", "tile", "terms", "blocks").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("members"))
    other = heads.select("lang", F.col("tile").alias("tile2"), F.col("members").alias("members2"))
    # one row for each pair of tiles and block of terms; tiles, not groups, are paired here
    tiles = heads.join(other, "lang").where("tile <= tile2").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    last = F.col("tiles") - 1
    dealt = (
        kept.join(few(langs), "lang")
        .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
        .withColumn("tile", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("tile2", F.explode(F.sequence(F.col("tile"), last)))
        .select("lang", "tile", "tile2", "block", F.filter("counts", lambda c: tile_of(c["source"]).isin(F.col("tile"), F.col("tile2"))).alias("counts"))
    )
    keys = ["lang", "tile", "tile2", "block"]

    def as_table(rows: list[tuple]) -> pa.Table:
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "item", "value"])

    def multiply(head: pa.Table, terms: pa.Table) -> pa.Table:
        if not head.num_rows:  # no group was dealt to one of the tiles
            return as_table([])
        lang, first, second = (head.column(c)[0].as_py() for c in ("lang", "tile", "tile2"))
        members, members2 = (head.column(c)[0].as_py() for c in ("members", "members2"))
        sides = [members] if first == second else [members, members2]
        places = {m["source"]: at for at, m in enumerate(m for side in sides for m in side)}
        levels = np.zeros((terms.num_rows, len(places)), np.int64)
        counts = terms.column("counts").combine_chunks()
        flat = counts.flatten()
        lengths = np.diff(counts.offsets.to_numpy()) if len(counts) else np.zeros(0, np.int64)
        spot = np.array([places[p] for p in flat.field("source").to_pylist()], np.int64)
        levels[np.repeat(np.arange(len(lengths)), lengths), spot] = flat.field("n").to_numpy()
        n = head.column("terms")[0].as_py()
        totals = [[m["total"] for m in side] for side in sides]
        cut = len(members)
        there, back = joint_prices(
            levels[:, :cut], levels[:, cut:] if len(sides) > 1 else None, totals[0], totals[-1], n, most_columns
        )
        out = [
            (lang, a["source"], b["source"], int(there[i, j]))
            for i, a in enumerate(members) for j, b in enumerate(members2) if len(sides) > 1 or i != j
        ]
        if len(sides) > 1:
            out += [(lang, b["source"], a["source"], int(back[j, i])) for i, a in enumerate(members) for j, b in enumerate(members2)]
        return as_table(out)

    # columns of their own: both sides come from the same groups
    tiles, dealt = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (tiles, dealt))
    parts = tiles.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(multiply, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, min_docs: int = 3, top: int = 200, tile: int = 64, block_rows: int = 16384, most_columns: int = 1024
) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows tell how far another
    source is, `term` rows which terms set a source apart from its language."""
    # one exchange by (lang, term) serves both sums
    raw = term_counts(docs).repartition("lang", "term")
    counts = raw.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = cut_lineage(
        counts.groupBy("lang", "term").agg(
            F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("counts")
        ).where((F.col("term") == "") | (F.col("docs") >= min_docs))
    )
    kept = terms.where("term <> ''")
    entries = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("counts").alias("c")).select("lang", "term", "lang_n", "c.source", "c.n")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut_lineage(
        terms.where("term = ''").select("lang", F.explode("counts.source").alias("source"))
        .join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
        .na.fill(0, ["terms", "lang_total", "total"])
    )
    pairs = divergences(kept.select("lang", "term", "counts"), groups, tile, block_rows, most_columns)

    apart = entries.join(few(groups), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    ).where("p > q")

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_pairs = pairs.withColumn("rank", F.row_number().over(order))
    ranked_terms = (
        apart.select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    )
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked_pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(ranked_terms.withColumn("part", F.lit("term")).select(*columns))
