"""Decontamination against plain loops over words."""

import hashlib
import re

import pytest
from helpers import DATA, ODD, docs, given
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st

import corpus_pipeline
from storyweave.llm import decontaminate
from storyweave.llm.queries import QUERIES


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items, n=10):
    words, hit, owners = plain_words(text), set(), set()
    for item, item_text in items:
        own = plain_words(item_text)
        size = min(n, len(own))
        for at in range(len(own) - size + 1 if size else 0):
            for k in range(len(words) - size + 1):
                if words[k : k + size] == own[at : at + size]:
                    hit |= set(range(k, k + size))
                    owners.add(str(item))
    return len(words), hit, sorted(owners)


def test_query_equals_plain_loops(spark):
    items = given("benchmark")
    windows = {tuple(plain_words(t)[k : k + 10]) for _, t in items for k in range(max(1, len(plain_words(t)) - 9))}
    rows = {r.doc_id: r for r in QUERIES["op7_benchmark_decontamination"](spark, DATA).collect()}
    found = 0
    for i, text, *_ in given("documents"):
        words = plain_words(text)
        if not any(tuple(words[k : k + 10]) in windows for k in range(len(words))) and all(len(plain_words(t)) >= 10 for _, t in items):
            n, hit, owners = len(words), set(), []
        else:
            n, hit, owners = plain_hits(text, items)
        found += bool(hit)
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(owners), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(owners).encode()).hexdigest()
    assert found


@settings(max_examples=150, deadline=None)
@examples(st.lists(st.sampled_from("ab"), max_size=14), st.lists(st.lists(st.sampled_from("abc"), max_size=6), max_size=3))
def test_windows_equal_plain_loops(words, items):
    items = [(str(k), " ".join(w)) for k, w in enumerate(items)]
    index = decontaminate.Windows([(k, t.encode()) for k, t in items], 4)
    text = " ".join(words)
    spans, owners = index.hits(decontaminate.words_of(text.encode()))
    _, hit, want = plain_hits(text, items, 4)
    assert {p for a, b in spans for p in range(a, b)} == hit and sorted(owners) == want
    left = index.cut(text.encode()).decode()
    assert not plain_hits(left, items, 4)[1]


def test_odd_rows_and_shards(spark):
    bench = spark.createDataFrame([(1, "One two THREE"), (2, None), (3, ""), (None, "日本語 のテキスト"), (4, " ".join(["word"] * 12)), (1, "One two THREE")], "item_id long, text string")
    for limit in (64_000_000, 20):
        rows = decontaminate.scan(docs(spark, [r for r in ODD if r[0] not in (5, None)] + [(5, "one two three")]), bench, max_bytes=limit).collect()
        got = {r.doc_id: (r.n_words, sum(s.stop - s.start for s in r.spans), r.item_ids) for r in rows}
        assert got[1] == got[2] == got[3] == (0, 0, [])
        assert got[5] == (3, 3, ["1"]) and got[9] == (3, 3, ["1"])
        assert got[4] == (3, 2, [""])
        assert got[6] == (60_000, 60_000, ["4"])
    assert decontaminate.scan(docs(spark, []), bench).count() == 0
    clean = decontaminate.digest(decontaminate.scan(docs(spark, ODD), bench.limit(0))).collect()
    assert len(clean) == len(ODD) and not any(r.contaminated for r in clean)


def test_shards_judge_rows_one_by_one(spark):
    """Rows without an id and rows that share one get the same answers from many shards as from one."""
    bench = spark.createDataFrame([(1, "one two three"), (2, "four five six"), (3, "seven eight nine")], "item_id long, text string")
    table = docs(spark, [(None, "one two three"), (5, "one two three x"), (5, "y four five six"), (None, "clean"), (7, "one two three seven eight nine")])
    whole, cut = (
        sorted(map(str, decontaminate.digest(decontaminate.scan(table, bench, max_bytes=limit)).collect())) for limit in (4_000_000, 12)
    )
    assert whole == cut and sum("contaminated=True" in r for r in cut) == 4


def test_removal_goes_over_all_shards_again(spark):
    """Cutting the passage of one shard joins a passage of another."""
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(["aa bb cc", "dd ee ff", "gg hh ii", "jj kk ll"])], "item_id long, text string")
    inner = ["aa bb cc", "dd ee ff", "gg hh ii", "jj kk ll"]
    rows = [(10 * a + b, f"keep {inner[a][:2]} {inner[b]} {inner[a][3:]} end") for a in range(4) for b in range(4) if a != b]
    for how, want in (("spans", {"keep", "end"}), ("documents", None)):
        for limit in (4_000_000, 10):
            left = decontaminate.remove(docs(spark, rows), bench, how=how, max_bytes=limit).collect()
            assert [set(r.text.split()) for r in left] == ([want] * len(rows) if want else [])


def test_removal(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    table = docs(spark, [(1, "keep this, One two THREE! and that"), (2, "one two three"), (3, "untouched  text\n"), (4, None)])
    cut = decontaminate.remove(table, bench)
    assert cut.columns == table.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {1: ("keep this,\n! and that", 21), 3: ("untouched  text\n", 16), 4: (None, None)}
    assert sorted(r.doc_id for r in decontaminate.remove(table, bench, how="documents").collect()) == [3, 4]
    with pytest.raises(ValueError):
        decontaminate.remove(table, bench, how="lines")


def test_stage_leaves_no_passage(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    left = {r.doc_id: r.text for r in corpus_pipeline.benchmark_decontamination(spark, table, DATA).collect()}
    scanned = QUERIES["op7_benchmark_decontamination"](spark, DATA).collect()
    texts = {r[0]: r[1] for r in given("documents")}
    assert all(left[r.doc_id] == texts[r.doc_id] for r in scanned if not r.contaminated)
    again = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    assert not decontaminate.digest(decontaminate.scan(again, spark.read.parquet(f"{DATA}/benchmark.parquet"))).where("contaminated").count()
