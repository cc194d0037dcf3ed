"""Source divergences against a plain computation."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import DATA, ODD, docs, given
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st

from storyweave.llm import divergence
from storyweave.llm.queries import ORACLES, QUERIES

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def plain(rows, top=200):
    """rows: (text, lang, source)."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, found = defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))
        counts[lang or ""][source or ""].update(words)
        found[lang or ""].update(set(words))
    out = []
    for lang, sources in counts.items():
        kept = sorted(t for t, n in found[lang].items() if n >= 3)
        every = Counter()
        for own in sources.values():
            every.update(own)

        def shares(own, kept=kept):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 1) // (total + len(kept)) for t in kept}

        q = shares(every)
        p = {s: shares(own) for s, own in sources.items()}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r) for r, (v, i) in enumerate(ordered, 1) if part == "pair" or r <= top]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def test_query_equals_sql_and_plain(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = rows_of(QUERIES["op12_source_divergence"](spark, DATA))
    assert got == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_source_divergence']})").fetchall())
    assert got == plain([(t, lang, source) for _, t, lang, source, _ in given("documents")])


@pytest.mark.parametrize("tile, block_rows, most_columns", [(64, 16384, 1024), (2, 3, 4), (1, 5, 1)])
def test_odd_rows_tiles_and_blocks(spark, tile, block_rows, most_columns):
    draw = np.random.default_rng(4)
    words = ["über", "Straße", "a", "B", "c", "naïve", "日本", "zz", "x9y", "rare"]
    rows = [(i, t, None if i == 5 else "en", None if i == 3 else "s") for i, t in ODD]
    rows += [(100 + i, " ".join(draw.choice(words, 12)), ["en", "de", None][i % 3], ["s", "t", "u", "", None][i % 5]) for i in range(60)]
    rows += [(200, None, "fr", "only"), (201, "", "fr", "other"), (202, "un deux", "it", "one")]  # no kept term
    got = rows_of(divergence.audit(docs(spark, rows), 3, 4, tile, block_rows, most_columns))
    assert got == plain([r[1:] for r in rows], 4)
    assert {r[4] for r in got if r[0] == "fr"} == {0}


def test_empty_table(spark):
    assert divergence.audit(docs(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@examples(st.integers(0, 10_000), st.integers(1, 60), st.integers(1, 5), st.integers(1, 40))
def test_joint_tables_price_like_terms(seed, n, groups, most_columns):
    draw = np.random.default_rng(seed)
    levels = draw.poisson(1.5, (n, groups)).astype(np.int64)
    totals = levels.sum(axis=0).tolist()
    p = [[1 + divergence.SCALE * (int(c) + 1) // (t + n) for c in levels[:, g]] for g, t in enumerate(totals)]
    want = [[sum((a - b) ** 2 // b for a, b in zip(p[g], p[h], strict=True)) for h in range(groups)] for g in range(groups)]
    there, _ = divergence.joint_prices(levels, None, totals, totals, n, most_columns)
    assert there.tolist() == want
    cut = groups // 2
    if cut:
        there, back = divergence.joint_prices(levels[:, :cut], levels[:, cut:], totals[:cut], totals[cut:], n, most_columns)
        assert there.tolist() == [row[cut:] for row in want[:cut]] and back.tolist() == [row[:cut] for row in want[cut:]]
