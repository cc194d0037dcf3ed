"""Learned operators: held-out accuracy on the given tables, and odd rows."""

import zlib

import pytest
import numpy as np
from helpers import DATA, ODD, docs, given
from pyspark.sql import functions as F

import corpus_pipeline
from storyweave.llm import langid, license, quality, toxicity, urlfilter
from storyweave.llm.quality import fit_logistic
from storyweave.llm.queries import QUERIES

BENCH = "/root/testdata/sf0.1"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def ranked(scores, labels):
    """Chance that a positive outranks a negative one."""
    order = np.argsort(np.argsort(scores))
    n = labels.sum()
    return (order[labels == 1].sum() - n * (n - 1) / 2) / (n * (len(labels) - n))


# -- language ------------------------------------------------------------------------

def test_languages_of_held_out_documents(spark):
    langs = {r[0]: r[2] for r in given("documents")}
    rows = QUERIES["op5_language_id"](spark, DATA).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.97


def test_language_of_odd_rows(spark):
    both = (("the cat and the dog", "en"), ("der hund und die katze", "de"))
    learn = [(100 + k, *both[k % 2], "s") for k in range(24)]
    table = docs(spark, learn + [(*r, "en", "s") for r in ODD] + [(50, "x", None, "s")])
    model = langid.fit(table, F.lit(True))
    assert model.languages == ("de", "en")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(table, model).collect()}
    assert got[1] == got[2] == got[3] == got[7] == ("und", 0.0)
    assert got[100][0] == "en" and got[6][0] in model.languages
    assert {r.doc_id for r in langid.accept(table, model).collect()} >= {100, 101}
    assert not {1, 2, 3, 7} & {r.doc_id for r in langid.accept(table, model).collect()}
    assert [r.lang for r in langid.accept(table, model, 0.0).where("doc_id = 50").collect()][0] in model.languages
    none = langid.fit(docs(spark, []), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs(spark, ODD), none).collect()} == {"und"}


def test_counts_of_a_long_text_equal_one_block():
    text = "Straße und Wald. " * 70_000  # over a block
    features, found = langid.counts(text)
    small, few = langid.counts("Straße und Wald. " * 7)
    assert set(features) == set(small) and found.sum() == 3 * len(text) - 3 and few.sum() == 3 * 17 * 7 - 3


def test_language_stage_keeps_prose(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, table, DATA)
    assert kept.columns == table.columns and kept.count() >= 0.99 * table.count()


# -- quality -------------------------------------------------------------------------

def test_quality_agrees_with_labels(spark):
    labels = {r[0]: r[1] for r in given("labels")}
    rows = [r for r in QUERIES["op4_quality_classifier"](spark, DATA).collect() if r.doc_id in labels]
    assert np.mean([r.accepted == bool(labels[r.doc_id]) for r in rows]) > 0.97


def test_quality_of_unseen_labels(spark):
    docs_, labels = (spark.read.parquet(f"{BENCH}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: bool(r.quality) for r in labels.collect()}
    seen = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    rows = [r for r in quality.score(docs_, seen, *quality.site()).collect() if r.doc_id in truth and fold(r.doc_id, 5) == 0]
    y, accepted = np.array([truth[r.doc_id] for r in rows]), np.array([r.accepted for r in rows])

    assert len(rows) > 500 and accepted[y].mean() > 0.97 and accepted[~y].mean() < 0.1
    assert ranked(np.array([r.score for r in rows]), y.astype(int)) > 0.95


SITES = "doc_id long, host string, path string, evidence double"


def posteriors(rows, spark):
    scored = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SITES)
    sums, strengths = quality.site_sums(scored)
    got = quality.with_posterior(scored, sums, strengths, "evidence", F.col("host"), F.col("path"))
    return {r.row.doc_id: r.posterior for r in got.collect()}, strengths


def logit(p):
    return np.log(p / (1 - p))


def test_sites_are_shrunk(spark):
    # hosts differ; a path with one document stays near its host
    rows = [("good", "good/a", 0.9)] * 40 + [("good", "good/b", 0.1)] + [("bad", "bad/a", 0.1)] * 40 + [(None, None, 0.5)]
    got, strengths = posteriors(rows, spark)
    odds = {r[1]: logit(got[k]) - logit(r[2]) for k, r in enumerate(rows)}
    assert odds["good/a"] > 0 > odds["bad/a"] and odds["good/b"] > 0
    # the only document of its host has nobody to speak for it
    assert abs(odds[None]) < 1e-9 and 0 < strengths.host < 1e9
    # without differences sites say nothing but for the document that is left out
    same = [(f"h{k % 5}", f"h{k % 5}/p", [0.2, 0.8][k // 5 % 2]) for k in range(200)]
    got, _ = posteriors(same, spark)
    assert max(abs(logit(got[k]) - logit(r[2])) for k, r in enumerate(same)) < 1e-6
    assert quality.site_sums(spark.createDataFrame([], SITES))[0].count() == 0


def test_posteriors_equal_a_plain_computation(spark):
    draw = np.random.default_rng(3)
    rows = []
    for h in range(9):
        base = draw.uniform(0.1, 0.9)
        for p in range(1 + h % 3):
            share = np.clip(base + draw.normal() * 0.1, 0.05, 0.95)
            rows += [(f"h{h}", f"h{h}/{p}", float(np.clip(draw.beta(4 * share, 4 * (1 - share)), 0.01, 0.99))) for _ in range(1 + 5 * p + h)]
    got, strengths = posteriors(rows, spark)

    def layout(groups, parents):
        """Variance between groups of a one-way layout under parents, from its definition."""
        values = {g: [r[2] for r in rows if groups(r) == g] for g in {groups(r) for r in rows}}
        above = {g: {parents(r) for r in rows if groups(r) == g}.pop() for g in values}
        pooled = {a: [r[2] for r in rows if parents(r) == a] for a in set(above.values())}
        within = sum(sum((x - np.mean(v)) ** 2 for x in v) for v in values.values()) / (len(rows) - len(values))
        across = sum(len(v) * (np.mean(v) - np.mean(pooled[above[g]])) ** 2 for g, v in values.items())
        room = len(rows) - sum(len(v) ** 2 / len(pooled[above[g]]) for g, v in values.items())
        return (across - (len(values) - len(pooled)) * within) / room

    mean = np.mean([r[2] for r in rows])

    def worth(b):
        return 1e9 if b <= 1e-9 else np.clip(mean * (1 - mean) / b - 1, 1, 1e9)

    a, b = worth(layout(lambda r: r[0], lambda r: 0)), worth(layout(lambda r: r[1], lambda r: r[0]))
    assert np.allclose([strengths.mean, strengths.host, strengths.path], [mean, a, b], rtol=1e-6)
    for k, (host, path, own) in enumerate(rows):
        others = [r for j, r in enumerate(rows) if j != k]
        of_host, of_path = [r[2] for r in others if r[0] == host], [r[2] for r in others if r[1] == path]
        at_host = (a * mean + sum(of_host)) / (a + len(of_host))
        at_path = (b * at_host + sum(of_path)) / (b + len(of_path))
        assert abs(got[k] - 1 / (1 + np.exp(-(logit(own) + logit(at_path) - logit(mean))))) < 1e-6


def test_quality_keeps_clashing_columns(spark):
    table = docs(spark, [(k, f"words number {k} of a plain text.", "en", "s") for k in range(8)])
    for name in ("Evidence", "row", "site", "posterior", "at_host"):
        table = table.withColumn(name, F.lit(name))
    kept = quality.keep(table, spark.createDataFrame([], "doc_id long, quality int, toxic int"), *quality.site())
    assert kept.columns == table.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, table.collect()))


def test_quality_of_odd_rows(spark):
    table = docs(spark, ODD + [(20, "some words", None, None)])
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 0), (6, 0, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(table, labels, *quality.site()).count() == len(ODD) + 1
    kept = quality.keep(table, labels, *quality.site())
    assert kept.columns == table.columns and 5 in {r.doc_id for r in kept.collect()}
    none = quality.score(table, labels.limit(0), *quality.site()).collect()
    assert len(none) == len(ODD) + 1 and all(r.accepted for r in none)
    assert quality.score(docs(spark, []), labels, *quality.site()).count() == 0


def test_quality_stage_drops_junk_only(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, table, DATA).collect()}
    labels = given("labels")
    assert np.mean([i in kept for i, q, _ in labels if q]) > 0.98
    assert np.mean([i in kept for i, q, _ in labels if not q]) < 0.1


def test_logistic_regression_finds_known_odds():
    draw = np.random.default_rng(0)
    x = np.column_stack((draw.normal(size=4000), np.ones(4000)))
    y = (draw.random(4000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.5)))).astype(float)
    assert np.allclose(fit_logistic(x, y), [1.5, -0.5], atol=0.15)


# -- toxicity ------------------------------------------------------------------------

def test_toxicity_of_held_out_documents(spark):
    labels = {r[0]: r[2] for r in given("labels")}
    bench = spark.read.parquet(f"{BENCH}/labels.parquet").collect()
    rows = QUERIES["op6_toxicity"](spark, BENCH).collect()
    assert len(rows) == spark.read.parquet(f"{BENCH}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    truth = {r.doc_id: r.toxic for r in bench}
    held = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    scores, y, predicted = (np.array(c) for c in zip(*held, strict=True))
    assert ranked(scores, y) > 0.85
    assert predicted[y == 0].mean() < 0.04 and predicted[y == 1].mean() > 0.5
    assert labels


def test_windows_cover_every_word():
    text = " ".join(f"w{k}" for k in range(21)).encode()
    size = toxicity.WINDOW
    joined, spans = toxicity.windows(text)
    assert [joined[a : a + n].split() for a, n in spans] == [text.split()[k : k + size] for k in range(0, 21, size)]
    assert toxicity.windows(None)[1].shape == toxicity.windows(b" \n").__getitem__(1).shape == (0, 2)


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30, 60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    learn = [(i, f"the river runs {'vile awful' if i % 2 else 'calm cool'} by stone number{i} and on", "en", "s") for i in range(30, 60)]
    model = toxicity.fit(docs(spark, learn), labels, F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, ODD), model).collect()}
    assert len(got) == len({r[0] for r in ODD}) and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2] == got[3]
    assert toxicity.fit(docs(spark, learn), labels.where("toxic = 1"), F.lit(True)) is None
    assert {r.score for r in toxicity.score(docs(spark, ODD), None).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), model).count() == 0


# -- licences ------------------------------------------------------------------------

def test_licences_of_the_documents(spark):
    marks = {"gpl": "GNU General Public License, version 3", "cc-by-nc": "CC BY-NC 4.0", "mit": "MIT License", "apache-2.0": "Apache License, Version 2.0"}
    rows = {r.doc_id: r for r in QUERIES["op2_license_scan"](spark, DATA).collect()}
    for i, text, *_ in given("documents"):
        assert rows[i].families == ",".join(sorted(f for f, mark in marks.items() if mark in text))


def test_licences_in_other_words(spark):
    cases = [
        (1, "Copyright 2020 A. Person\nReleased under the terms of the MIT license, see the file"),
        (2, "intro\n\nThis program is licensed under the Apache License Version 2.0 by its authors"),
        (3, "His driving license was version 2 of a public document."), (4, None), (5, ""),
        (6, ("lorem ipsum dolor " * 200) + "Licensed under the Mozilla Public License, Version 2.0." + (" dolor sit amet" * 200)),
        (6, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ]
    table = docs(spark, cases)
    rows = license.digest(license.scan(table, license.fit(table))).collect()
    got = sorted((r.doc_id, r.families) for r in rows)
    assert got == [(1, "mit"), (2, "apache-2.0"), (3, ""), (4, ""), (5, ""), (6, "bsd"), (6, "mpl-2.0")]
    assert license.scan(docs(spark, []), license.fit(docs(spark, []))).count() == 0


# -- URLs ----------------------------------------------------------------------------

def plain_rule(host, path):
    best = None
    for verdict, rule in urlfilter.RULES:
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def test_rules_decide_and_trees_follow_them(spark):
    rows = {r.page_id: r for r in QUERIES["op9_url_filter"](spark, BENCH).collect()}
    pages = spark.read.parquet(f"{BENCH}/pages.parquet").select("page_id", "url").collect()
    assert len(rows) == len(pages)
    for p in pages:
        rest = p.url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:end].lower(), rest[end:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
        r, rule = rows[p.page_id], plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")


def test_trees_learn_what_rules_decide(spark):
    pages = spark.read.parquet(f"{BENCH}/pages.parquet").where(F.pmod(F.xxhash64("url"), F.lit(5)) > 0)
    model = urlfilter.fit(pages)
    held = spark.read.parquet(f"{BENCH}/pages.parquet").where(F.pmod(F.xxhash64("url"), F.lit(5)) == 0).collect()
    rows = [(r.url, *urlfilter.parts(r.url)) for r in held]
    known = [(v, plain_rule(h, p)) for v, (_, h, p) in zip(model.verdicts(rows), rows, strict=True)]
    hit = np.mean([v == rule[1] for v, rule in known if rule])
    assert hit > 0.95


def test_no_label_is_inside_its_own_features(spark, monkeypatch):
    # the last of a URL's features is its three-label suffix with the head of the path: these occur once
    urls = [f"http://w.a{i}.com/x{i}" for i in range(80)] + [f"http://w.b{i}.net/es/{i}" for i in range(80)] + ["http://w.c.net/fr/k"] * 50
    table = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    seen = []
    plain = urlfilter.grow
    monkeypatch.setattr(urlfilter, "grow", lambda x, y, w, **k: (seen.append(x), plain(x, y, w, **k))[1])
    model = urlfilter.fit(table)
    later = np.array([model.features(u, *urlfilter.parts(u)) for u in urls])
    assert seen[0].shape == (161, later.shape[1]) and np.abs(seen[0][:, -1]).max() < 1e-12 < np.abs(later[:, -1]).min()
    # what is said of all URLs, over the folds, is their plain count
    n, blocked = len(urls), 130
    p = (80 + 50 + 20 * blocked / n) / (130 + 20)  # suffix "net"
    assert abs(later[-1][-6] - (np.log(p / (1 - p)) - np.log(blocked / (n - blocked)))) < 1e-9


def test_odd_urls(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://A.COM", "http://a.com/", "x://Y.net/es/1?q#f", "http://www.example.com/en/x", "http://example.com/en/x", "http://é.org/日本"]
    pages = spark.createDataFrame([(k, u, "h", "clash") for k, u in enumerate(urls)] + [(None, "http://a.com/", "h", "c")], "page_id long, url string, html string, rule string")
    model = urlfilter.fit(pages)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, model).collect()}
    assert [got[k][:2] for k in range(4)] == [("", "")] * 4
    assert got[4][:3] == ("a.com", "", None) and got[5] == ("a.com", "/", "com/", "allow")
    assert got[6] == ("y.net", "/es/1", "net/es/", "block") and got[7][2:] == ("www.example.com/en/", "allow") and got[8][3] == "block"
    assert got[9][:2] == ("é.org", "/日本") and got[None][3] == "allow"
    assert urlfilter.judge(pages.limit(0), urlfilter.fit(pages.limit(0))).count() == 0


def test_one_url_everywhere_is_one_row_of_the_sample(spark, monkeypatch):
    urls = ["http://com/hot"] * 3000 + [f"http://a{i}.com/x{i}" for i in range(60)] + [f"http://b{i}.net/es/{i}" for i in range(60)]
    table = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    seen = []
    plain = urlfilter.grow
    monkeypatch.setattr(urlfilter, "grow", lambda x, y, w, **k: (seen.append((len(x), w)), plain(x, y, w, **k))[1])
    urlfilter.fit(table, max_rows=100)
    assert seen[0][0] == 100
    urlfilter.fit(table)
    assert seen[1][0] == 121 and round(seen[1][1].max() / seen[1][1].min()) == 3000


@pytest.mark.parametrize("text, letter", [("½ ² ① 12", False), ("", False), (None, False), ("ⅷ", False), ("é", True), ("日", True), ("1a", True)])
def test_numeric_signs_are_no_letters(text, letter):
    assert langid.has_letter(text) is letter
