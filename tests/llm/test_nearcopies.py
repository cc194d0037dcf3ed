"""Near copies by exact Jaccard similarity against all pairs."""

import numpy as np
import pytest
import xxhash
from helpers import DATA, ODD, docs, given
from test_copies import reachable

import corpus_pipeline
from storyweave.llm import nearcopies, simhash


def plain(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def least_of_groups(texts, similarity=0.8):
    """Smallest ids of the groups by all pairs; texts by id."""
    ids, sets = sorted(texts), {i: plain(t) for i, t in texts.items()}
    kept, left = [], list(ids)
    while left:
        todo = [left.pop(0)]
        kept.append(todo[0])
        while todo:
            a = sets[todo.pop()]
            near = [j for j in left if a == sets[j] or len(a & sets[j]) >= similarity * len(a | sets[j]) - 1e-9 and a & sets[j]]
            todo += near
            left = [j for j in left if j not in near]
    return kept


def test_stage_groups_by_five_words(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table, DATA).collect())
    assert kept == least_of_groups({i: t for i, t, *_ in given("documents")})


@pytest.mark.parametrize("tile_rows", [3, 512])
def test_planted_copies(spark, tile_rows):
    draw = np.random.default_rng(5)
    texts = {}
    for base in range(12):
        words = [f"w{x}" for x in draw.integers(0, 5000, int(draw.integers(6, 150)))]
        for copy in range(6):
            own = list(words)
            for at in draw.integers(0, len(own), copy):
                own[at] = f"x{draw.integers(0, 5000)}"
            texts[int(base * 10 + copy)] = " ".join(own)
    kept = nearcopies.keep_one(docs(spark, list(texts.items())), tile_rows=tile_rows)
    assert sorted(r.doc_id for r in kept.collect()) == least_of_groups(texts)


def test_odd_rows(spark):
    table = docs(spark, ODD)
    kept = nearcopies.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "7", "8", "None"]
    assert nearcopies.keep_one(docs(spark, [])).count() == 0


def test_texts_under_one_id_are_judged_one_by_one(spark):
    same, other = "a b c d e f g", "h i j k l m n"
    kept = nearcopies.keep_one(docs(spark, [(3, same), (5, same), (5, other), (7, "o p q r s t"), (7, "u v w x y z")]))
    assert sorted((r.doc_id, r.text[0]) for r in kept.collect()) == [(3, "a"), (5, "h"), (7, "o"), (7, "u")]


def test_shared_boilerplate_does_not_clump(spark):
    """Texts that have a third in common are told apart by their sketches, before whole texts meet."""
    draw = np.random.default_rng(7)
    shared = [f"b{k}" for k in range(60)]
    texts = [(i, " ".join([*shared, *(f"w{x}" for x in draw.integers(0, 100_000, 60))])) for i in range(1500)]
    named = nearcopies.sketches(docs(spark, texts)).withColumn("one", nearcopies.F.lit(0))
    sizes = [r["count"] for r in nearcopies.clusters_of(named).groupBy("cluster").count().collect()]
    assert sum(n * (n - 1) for n in sizes) < 0.05 * 1500 * 1499
    assert nearcopies.keep_one(docs(spark, texts)).count() == 1500


def test_sketches_of_near_copies_agree():
    draw = np.random.default_rng(2)
    for _ in range(300):
        own = draw.integers(0, 2**63, 900).astype(np.uint64)
        other = np.concatenate([own[:800], draw.integers(0, 2**63, 100).astype(np.uint64)])  # 800 of 1,000
        a, b = (np.frombuffer(nearcopies.bands(x)[1], np.uint8) for x in (own, other))
        assert (a == b).sum() >= nearcopies.AGREE


def word_print(text):
    words = set((text or "").encode().lower().split())
    votes = [sum(xxhash.xxh64_intdigest(w, 42) >> b & 1 for w in words) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(words))


def altered(copies=40, words=200):
    """Texts by id: pairs of a text and a copy with two of its words changed."""
    draw = np.random.default_rng(11)
    texts = {}
    for base in range(copies):
        own = [f"w{x}" for x in draw.integers(0, 50_000, words)]
        texts[2 * base] = " ".join(own)
        for at in draw.integers(0, words, 2):
            own[at] = f"x{draw.integers(0, 50_000)}"
        texts[2 * base + 1] = " ".join(own)
    return texts


def test_the_ring_groups_like_all_pairs(spark):
    texts = altered() | {k: "the same few words here" + " x" * (k % 3) for k in range(1000, 1006)}
    prints = {i: word_print(t) for i, t in texts.items()}
    named = nearcopies.sketches(docs(spark, list(texts.items()))).select(nearcopies.F.col("doc_id").alias("node"), "fp")
    assert {r.node: r.fp % 2**64 for r in named.collect()} == prints
    groups = {}
    for r in nearcopies.ring_groups(named).collect():
        groups.setdefault(r.ring, []).append(r.node)
    least = {i: min(g) for g in groups.values() for i in g}
    assert least == reachable(prints, nearcopies.MAX_BITS)
    assert sum(len(g) == 2 for g in groups.values()) > 30


def test_near_copies_within_the_ring_need_no_shared_key(spark):
    """What fingerprints tell is found by the ring, whatever the bands of minima say."""
    texts = altered()
    named = nearcopies.sketches(docs(spark, list(texts.items()))).withColumn("keys", nearcopies.F.array("node"))
    found = {r.node: r.cluster for r in nearcopies.clusters_of(named).collect()}
    node = {r.doc_id: r.node for r in named.collect()}
    prints = {i: word_print(t) for i, t in texts.items()}
    near = [i for i in range(0, 80, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= nearcopies.MAX_BITS]
    assert len(near) > 30
    assert all(found[node[i]] == found[node[i + 1]] for i in near)


def test_a_text_of_many_words_has_the_plain_fingerprint():
    text = " ".join(f"w{k}" for k in range(70_000)) + " W1 w1"
    assert simhash.word_fingerprint(text.encode()) == word_print(text)
    assert simhash.word_fingerprint(None) == simhash.word_fingerprint(b" \n") == 0
