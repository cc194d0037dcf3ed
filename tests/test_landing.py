import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweave.functions import vectors
from storyweave.operators import calibrate, gate, pairs
from storyweave.operators.dedup import first_by_content, first_by_url, first_keys_by_url
from storyweave.plans import jobs
from storyweave.sources import embedding, registry, scans
from storyweave.sources.embedding import hashing_encoder
from storyweave.streaming import ingest

RSS = """<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>Feed</title>
<item><title> One </title><link>https://www.a.com/1/?utm_source=f</link><description>&lt;p&gt;Body&lt;/p&gt;</description>
<pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><media:content url="https://i.com/m.png" medium="image"/></item>
<item><title>Undated</title><link>https://a.com/2</link><enclosure url="https://i.com/a.mp3" type="audio/mpeg"/></item>
<item><title>Linkless</title><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>
<item><title>Old</title><link>https://a.com/3</link><pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate><description></description></item>
<item><title>Thumb</title><link>https://a.com/4</link><pubDate>Wed, 03 Jan 2024 00:00:00 +0100</pubDate>
<media:content url="https://i.com/v.mp4" type="video/mp4"/><media:thumbnail url="https://i.com/t.png"/></item></channel></rss>"""

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom">
<entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A
  paper</title><link href="https://g.com/r/1" rel="alternate"/><published>2024-01-02T00:00:00Z</published><updated>2024-01-05T00:00:00Z</updated><summary> Two
 lines </summary></entry>
<entry><id>http://arxiv.org/abs/2401.00001v1</id><title>A paper</title><link href="https://g.com/r/1"/><updated>2024-01-03T00:00:00Z</updated></entry>
<entry><id>tag:other</id><title>Other</title><published>2024-01-02T00:00:00Z</published></entry></feed>"""

POSTS = json.dumps([
    {"id": 1, "type": "story", "url": "https://p.com/1", "title": " Post ", "score": 100, "time": 1704164645},
    {"id": 2, "type": "story", "url": "https://p.com/2", "title": "Low", "score": 99, "time": 1704164645},
    {"id": 3, "type": "job", "url": "https://p.com/3", "title": "Job", "score": 900, "time": 1704164645},
    {"id": 4, "type": "story", "title": "Ask", "score": 900, "time": 1704164645},
    {"id": 5, "type": "story", "url": "https://p.com/5", "title": "Timeless", "score": 900}])

LISTING = """<div><article class="card"><a class="card-link" href="/news/1?a=1&amp;b=2"><h3>First <b>card</b></h3></a><time datetime="2024-01-02">Jan 2</time><p>Dek</p></article>
<article class="card"><a class="card-link" href="https://other.org/x"><h3>Second</h3></a><time datetime="soon">soon</time></article>
<article class="card"><h3>No link</h3></article></div>"""


def landed(spark, *rows):
    return spark.createDataFrame(rows, "source_id string, payload string, since timestamp")


def test_rss(spark):
    got = {r.title: r for r in scans.scan_rss(landed(spark, ("s", RSS, datetime(2024, 1, 1)))).collect()}
    assert set(got) == {"One", "Undated", "Thumb"}
    one = got["One"]
    assert (one.url, one.summary, one.published_at, one.image_url) == ("https://a.com/1", "<p>Body</p>", datetime(2024, 1, 2, 3, 4, 5), "https://i.com/m.png")
    assert got["Undated"].published_at is None and got["Undated"].image_url is None and got["Undated"].outbound_links == []
    assert got["Thumb"].image_url == "https://i.com/t.png" and got["Thumb"].published_at == datetime(2024, 1, 2, 23)
    assert scans.scan_rss(landed(spark, ("s", RSS, None))).count() == 4
    assert scans.scan_rss(landed(spark, ("s", "<rss><channel></channel></rss>", None), ("t", "not xml", None))).count() == 0


def test_atom(spark):
    papers = scans.scan_paper_feed(landed(spark, ("s", ATOM, None))).orderBy("entry_no").collect()
    assert [(r.url, r.title, r.summary, r.published_at) for r in papers] == [
        ("https://arxiv.org/abs/2401.00001", "A paper", "Two lines", datetime(2024, 1, 2)), ("https://arxiv.org/abs/2401.00001", "A paper", None, datetime(2024, 1, 3))]
    releases = scans.scan_release_feed(landed(spark, ("s", ATOM, None)).withColumn("repo", F.lit("o/r"))).orderBy("entry_no").collect()
    assert [(r.url, r.published_at) for r in releases] == [("https://g.com/r/1", datetime(2024, 1, 5)), ("https://g.com/r/1", datetime(2024, 1, 3))]
    assert releases[1].title == "o/r: A paper"


def test_posts_and_listing(spark):
    got = scans.scan_scored_json(landed(spark, ("s", POSTS, None))).orderBy("entry_no").collect()
    assert [(r.title, r.published_at) for r in got] == [("Post", datetime(2024, 1, 2, 3, 4, 5)), ("Timeless", None)]
    page = spark.createDataFrame([("s", "https://www.site.com/list", LISTING)], "source_id string, url string, html string")
    cards = scans.scan_html_listing(
        page, card=r"<article\b.*?</article>", title=r"<h3>(.*?)</h3>", date=r'datetime="([^"]*)"', summary=r"<p>(.*?)</p>").orderBy("entry_no").collect()
    assert [(r.url, r.title, r.published_at, r.summary) for r in cards] == [
        ("https://site.com/news/1?a=1&b=2", "First card", datetime(2024, 1, 2), "Dek"), ("https://other.org/x", "Second", None, None)]


def test_registry(spark):
    with pytest.raises(KeyError, match="rss"):
        registry.reader_for("nope")
    assert registry.known_plugins() == ["arxiv", "github_releases", "hackernews", "rss", "scraper"]


SOURCES = "source_id string, plugin string, enabled boolean, cadence_minutes int, max_backfill_days int, last_run_at timestamp, consecutive_failures int, last_error string, coverage_warning string"


def test_collect(spark):
    now = datetime(2024, 1, 3)
    sources = spark.createDataFrame([
        ("feed", "rss", True, 30, 5, None, 2, "old", None), ("posts", "hackernews", True, 30, None, datetime(2024, 1, 1), 0, None, None),
        ("down", "rss", True, 30, None, datetime(2024, 1, 2), 1, None, None), ("fresh", "rss", True, 30, None, datetime(2024, 1, 2, 23, 45), 0, None, None),
        ("off", "rss", False, 30, None, None, 0, None, None)], SOURCES)
    land = spark.createDataFrame([
        ("rss", "feed", RSS, None), ("hackernews", "posts", POSTS.replace("https://p.com/5", "http://www.a.com/2/?utm_x=1"), None),
        ("rss", "down", None, "HTTPError: 500"), ("rss", "fresh", RSS, None), ("rss", "off", RSS, None)], "plugin string, source_id string, payload string, error string")
    from storyweave.functions import urls

    known = spark.createDataFrame([(41, "https://a.com/4")], "item_id long, u string").select("item_id", urls.url_hash(F.col("u")).alias("url_hash"))
    done = jobs.collect(land, sources, known, now, ["rss", "hackernews"])
    items = done.items.orderBy("item_id").collect()
    # a.com/4 is stored already; a.com/2 arrives twice and the first source keeps it
    assert [(r.item_id, r.source_id, r.url) for r in items] == [
        (42, "feed", "https://a.com/1"), (43, "feed", "https://a.com/2"), (44, "feed", "https://a.com/3"), (45, "posts", "https://p.com/1")]
    counters = {r.source_id: (r.new_items, r.skipped_duplicates, r.error) for r in done.counters.collect()}
    assert counters == {"feed": (3, 1, None), "posts": (1, 1, None), "down": (0, 0, "HTTPError: 500")}
    after = {r.source_id: r for r in done.sources.collect()}
    assert after["feed"].last_run_at == now and after["feed"].consecutive_failures == 0 and after["feed"].last_error is None
    assert "first run, backfill bounded to 5d" in after["feed"].coverage_warning and "all 3 dated" in after["feed"].coverage_warning
    assert after["down"].last_run_at == datetime(2024, 1, 2) and after["down"].consecutive_failures == 2 and after["down"].last_error == "HTTPError: 500"
    assert after["fresh"].last_run_at == datetime(2024, 1, 2, 23, 45) and after["posts"].coverage_warning is None
    repair = jobs.collect(land, sources, known, now, ["rss"], backfill_days=1, ignore_cadence=True, only_source_ids=["fresh"])
    assert [r.url for r in repair.items.orderBy("item_id").collect()] == ["https://a.com/1", "https://a.com/2"]


def test_collect_judges_coverage_before_the_cut(spark):
    def feed(*dates):
        items = "".join(f"<item><title>t</title><link>https://f.com/{d}</link>" + (f"<pubDate>{d} Jan 2024 00:00:00 GMT</pubDate>" if d < 90 else "") + "</item>" for d in dates)
        return f"<rss version='2.0'><channel>{items}</channel></rss>"

    sources = spark.createDataFrame(
        [(s, "hackernews" if s == "broken" else "rss", True, 30, None, datetime(2024, 1, 5), 0, None, None) for s in ("mixed", "new", "undated", "broken")], SOURCES)
    land = spark.createDataFrame(
        [("rss", "mixed", feed(4, 6)), ("rss", "new", feed(6, 7)), ("rss", "undated", feed(98, 99)), ("hackernews", "broken", "[{")],
        "plugin string, source_id string, payload string")
    known = spark.createDataFrame([], "item_id long, url_hash string")
    done = jobs.collect(land, sources, known, datetime(2024, 1, 7, 12), ["rss", "hackernews"])
    after = {r.source_id: r for r in done.sources.collect()}
    assert "all 2 dated" in after["new"].coverage_warning
    assert "all" not in (after["mixed"].coverage_warning or "") and "all" not in (after["undated"].coverage_warning or "")
    assert after["broken"].consecutive_failures == 1 and after["broken"].last_run_at == datetime(2024, 1, 5) and "JSON" in after["broken"].last_error
    assert {r.source_id: r.new_items for r in done.counters.collect()} == {"mixed": 1, "new": 1, "undated": 2, "broken": 0}


def test_collect_takes_a_payload_that_landed_twice_once(spark):
    sources = spark.createDataFrame([("feed", "rss", True, 30, 5, None, 0, None, None)], SOURCES)
    land = spark.createDataFrame([("rss", "feed", RSS)] * 3, "plugin string, source_id string, payload string")
    known = spark.createDataFrame([], "item_id long, url_hash string")
    once = jobs.collect(land.limit(1), sources, known, datetime(2024, 1, 3), ["rss"])
    done = jobs.collect(land, sources, known, datetime(2024, 1, 3), ["rss"])
    assert done.items.columns == once.items.columns
    assert sorted(map(str, done.items.collect())) == sorted(map(str, once.items.collect()))
    count = once.counters.first()
    assert done.counters.first().skipped_duplicates == 3 * (count.new_items + count.skipped_duplicates) - count.new_items
    none = jobs.collect(land.limit(0), sources, known, datetime(2024, 1, 3), ["rss"])
    assert none.items.count() == 0 and none.items.columns == once.items.columns


def test_first_keys_are_those_of_first_by_url(spark):
    rows = spark.createDataFrame(
        [(k, k * 7 % 10, f"https://a.com/{k % 4}" + ("?utm_source=x" if k % 2 else ""), "text") for k in range(12)] + [(12, 0, None, "t")],
        "id long, at long, url string, text string")
    slim = first_keys_by_url(rows, "at", "id").join(rows.select("id", "text"), "id")
    whole = first_by_url(rows.withColumn("order", F.struct("at", "id")), "order")
    columns = ["url_hash", "id", "duplicates", "text"]
    assert sorted(map(str, slim.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))


def test_pages_nobody_reads_do_not_count(spark):
    items = spark.createDataFrame([(1, "https://a.com/1", None, None), (2, "https://a.com/2", "<p>a summary long enough to be used</p>" * 20, None)],
                                  "item_id long, url string, summary string, image_url string")
    pages = spark.createDataFrame(
        [("https://www.a.com/1", "<p>the page of the first item, as it was fetched</p>"), ("https://a.com/1", "<p>another copy of this page of the first</p>"),
         ("https://a.com/2", "<p>the page of the second, which nobody reads</p>"), ("https://b.com/9", None), (None, "x")], "url string, html string")
    kept = {r.item_id: r.text for r in jobs.normalize(items, pages).kept.collect()}
    assert kept[1] == "another copy of this page of the first" and kept[2].startswith("a summary long") and len(kept) == 2


def test_stage_stream_knows_earlier_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([(1, "same text"), (2, "other")], [(3, "same text"), (4, "Same  text"), (5, "third")]):
        spark.createDataFrame(part, "item_id long, text string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("item_id long, text string").parquet(folder)
        ingest.stage_stream(stream, lambda batch, known: first_by_content(batch, "text", known), out, out + "-log").awaitTermination()
    kept = sorted(r.item_id for r in spark.read.parquet(f"{out}/kept").collect())
    failed = {r.item_id: r.error for r in spark.read.parquet(f"{out}/failed").collect()}
    assert 3 not in kept and failed[3] == "duplicate content of item 1" and {1, 2, 5} <= set(kept)


def test_ingest_stream_dedups_across_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("s", "https://a.com/1"), ("s", "http://www.a.com/1/"), ("t", "https://a.com/2")], [("t", "https://A.com/1?utm_source=x"), ("t", "https://a.com/3")]
    out = str(tmp_path / "out")
    for part in rows:
        spark.createDataFrame([(s, i, u) for i, (s, u) in enumerate(part)], "source_id string, entry_no int, url string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("source_id string, entry_no int, url string").parquet(folder)
        ingest.ingest_stream(stream, lambda b: b, out, out + "-log").awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r.batch, r.url) for r in got.collect()) == [(0, "https://a.com/1"), (0, "https://a.com/2"), (1, "https://a.com/3")]


def test_xml_files_stream(spark, tmp_path):
    folder = tmp_path / "xml"
    folder.mkdir()
    (folder / "a.xml").write_text(RSS)
    entries = spark.readStream.format("xml").option("rowTag", "item").schema(
        "title string, link string, description string, pubDate string, updated string, `media:content` array<struct<_url:string,_medium:string,_type:string>>, "
        "`media:thumbnail` array<struct<_url:string>>, enclosure array<struct<_url:string,_type:string>>").load(str(folder))

    def parse(batch):
        return scans.rss_items(batch.select(F.lit("s").alias("source_id"), F.lit(0).alias("entry_no"), F.lit(None).cast("timestamp").alias("since"), F.struct("*").alias("e")))

    out = str(tmp_path / "out")
    ingest.ingest_stream(entries, parse, out, out + "-log").awaitTermination()
    assert {r.url for r in spark.read.parquet(out).collect()} == {"https://a.com/1", "https://a.com/2", "https://a.com/3", "https://a.com/4"}


def test_embedding_isolates_bad_rows(spark):
    def load():
        inner = hashing_encoder(16)()

        def encode(texts):
            if any("boom" in t for t in texts):
                raise ValueError("cannot encode")
            out = inner(texts)
            for i, t in enumerate(texts):
                if "nan" in t:
                    out[i, 0] = np.nan
            return out

        return encode

    items = spark.createDataFrame([(1, "Good", "text"), (2, "boom", "text"), (3, "nan", "text"), (4, "Good", "text")], "item_id long, title string, text string")
    done, failed = embedding.embed_items(items.coalesce(1), load, "toy")
    rows = {r.item_id: r for r in done.collect()}
    assert set(rows) == {1, 4} and rows[1].embedding == rows[4].embedding and rows[1].model_id == "toy"
    assert {r.item_id: r.error.split(":")[0] for r in failed.collect()} == {2: "embedding failed", 3: "embedding for item 3 contains non-finite values"}


def test_gate_needs_both_signals_to_reject(spark):
    items = spark.createDataFrame([
        (1, "plain", "x", "m", [1.0, 0.0]), (2, "plain", "x", "m", [0.0, 1.0]), (3, "An AI story", "x", "m", [0.0, 1.0]), (4, "plain", "x", "m", [float("nan"), 1.0]),
        (5, "plain", "x", "loose", [0.1, 1.0])], "item_id long, title string, text string, model_id string, embedding array<float>")
    topic = spark.createDataFrame([([2.0, 0.0],), ([5.0, 0.0],)], "embedding array<float>")
    kept, rejected = jobs.relevance(items, topic, cosine_thresholds={"loose": 0.05})
    assert {r.item_id for r in kept.collect()} == {1, 3, 5}
    assert {r.item_id: r.reject_reason for r in rejected.collect()} == {
        2: "off-topic: cosine=0.000 (threshold 0.120), keyword_hits=0", 4: "off-topic: cosine=0.000 (threshold 0.120), keyword_hits=0"}
    for off in (jobs.relevance(items, None), jobs.relevance(items, topic, enabled=False)):
        assert off[0].count() == 5 and off[1].count() == 0


def test_sweep(spark):
    members = spark.createDataFrame([
        (1, 1, "a", "off", "x", "m", [0.0, 1.0], datetime(2024, 1, 5)), (2, 1, "b", "AI on", "x", "m", [0.0, 1.0], datetime(2024, 1, 2)),
        (3, 2, "a", "off", "x", "m", [0.0, 1.0], None), (4, 3, "a", "on", "x", "m", [1.0, 0.0], None)],
        "item_id long, story_id long, source_id string, title string, text string, model_id string, embedding array<float>, published_at timestamp")
    stories = spark.createDataFrame([(i, f"s{i}", None, 0.5, 2, 2, datetime(2024, 1, 9), [0.0, 1.0]) for i in (1, 2, 3)],
                                    "story_id long, title string, category string, score double, item_count long, outlet_count long, updated_at timestamp, centroid array<float>")
    topic = vectors.unit_mean_centroid(spark.createDataFrame([([1.0, 0.0],)], "embedding array<float>"), "embedding")
    found = gate.sweep_findings(members, stories, topic)
    assert {(r.item_id, r.story_title) for r in found.collect()} == {(1, "s1"), (3, "s2")}
    assert gate.sweep_findings(members, stories, topic, source_ids=["b"]).count() == 0
    left, deleted = gate.sweep_apply(members, stories, found)
    rows = {r.story_id: r for r in left.collect()}
    assert [r.story_id for r in deleted.collect()] == [2] and set(rows) == {1, 3}
    assert (rows[1].item_count, rows[1].outlet_count, rows[1].updated_at) == (1, 1, datetime(2024, 1, 2))
    assert rows[3].item_count == 2  # untouched


def reach(links, nodes):
    """Least node that links lead to, by breadth-first search."""
    beside = {n: set() for n in nodes}
    for i, j in links:
        beside[i].add(j)
        beside[j].add(i)
    out = {}
    for n in sorted(nodes):
        ring = {n} - set(out)
        while ring:
            out.update(dict.fromkeys(ring, n))
            ring = set().union(*(beside[m] for m in ring)) - set(out)
    return out


def cosines(rows):
    at = {i: np.array(v) for i, *_, v in rows}
    return {(i, j): round(float(at[i] @ at[j] / np.sqrt((at[i] @ at[i]) * (at[j] @ at[j]))), 9) for i in at for j in at if i < j}


def test_forest_connects_like_all_pairs(spark):
    from storyweave.operators.stories import connected_components

    gen = np.random.default_rng(8)
    rows = [(i, [float(x) for x in gen.normal(size=3)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "row_id long, vector array<double>")
    strong = [p for p, s in cosines(rows).items() if s >= 0.9]
    linked = {n for p in strong for n in p}
    for tile in (7, 1024):
        forest = pairs.similarity_forest(frame, "row_id", "vector", 0.9, tile_rows=tile)
        if tile == 1024:
            assert forest.count() < 60
        assert {r.node: r.component for r in connected_components(forest).collect()} == reach(strong, linked)


def bands(spark, rows, tile_rows, signals=None, entities=None):
    """The sweep as the library gives it: passing thresholds by signal."""
    schema = "row_id long, label int, " + ("names array<string>, " if entities else "") + "vector array<double>"
    frame = spark.createDataFrame(rows, schema)
    inside = pairs.similarity_forest(frame, "row_id", "vector", 0.20, "label", tile_rows, entities, signals)
    ends = pairs.cosine_extremes(frame, "row_id", "vector", "label", tile_rows, entities, signals)
    sweep = calibrate.threshold_sweep(inside, ends, frame)
    return inside, ends, sweep, {(r.signal, round(r.threshold, 2)): r.passes for r in sweep.collect()}


@pytest.mark.parametrize("tile_rows", [4, 10, 1024])
def test_sweep_of_thresholds_equals_brute_force(spark, tile_rows):
    gen = np.random.default_rng(3)
    centres = gen.normal(size=(6, 8)) * 2
    rows = [(i, i % 6, [float(x) for x in centres[i % 6] + gen.normal(size=8) * 0.45]) for i in range(36)]
    score = cosines(rows)
    inside, ends, sweep, got = bands(spark, rows, tile_rows)
    assert all(score[r.i, r.j] == r.score and r.i % 6 == r.j % 6 for r in inside.collect())
    want = {("cosine", t / 100): reach([p for p, s in score.items() if s >= t / 100], range(36)) == {i: i % 6 for i in range(36)} for t in range(20, 95)}
    assert got == want and any(want.values())
    band = calibrate.safe_band(sweep).first()
    good = [t for (_, t), ok in want.items() if ok]
    assert (band.low, band.high) == (min(good), max(good))
    margin = calibrate.separation_margin(ends).first()
    assert margin.lowest_same == min(s for (i, j), s in score.items() if i % 6 == j % 6)
    assert margin.highest_different == max(s for (i, j), s in score.items() if i % 6 != j % 6)
    none = calibrate.safe_band(sweep.withColumn("passes", F.lit(False))).first()
    assert (none.low, none.high, none.width) == (0.0, 0.0, 0.0)


def test_blend_is_safe_over_a_wider_band(spark):
    # the vectors of different stories come close; their entities tell them apart
    gen = np.random.default_rng(4)
    base = gen.normal(size=12)
    rows = [(i, i % 4, [f"s{i % 4}", f"t{i % 4}", f"x{i}"], [float(x) for x in base + (i % 4) * gen.normal(size=12) * 0 + np.eye(12)[i % 4] * 2.6 + gen.normal(size=12) * 0.12]) for i in range(24)]
    _, _, sweep, got = bands(spark, rows, 1024, pairs.SIGNALS, "names")
    width = {r.signal: r.width for r in calibrate.safe_band(sweep).collect()}
    assert set(width) == {"cosine", "entities", "blend"} and width["blend"] > width["cosine"] > 0
    jaccard = {(i, j): len(set(rows[i][2]) & set(rows[j][2])) / len(set(rows[i][2]) | set(rows[j][2])) for i in range(24) for j in range(i)}
    for name, (a, b) in pairs.SIGNALS.items():
        score = {p: round(a * s + b * jaccard[p[1], p[0]], 9) for p, s in cosines([(r[0], r[3]) for r in rows]).items()}
        for t in (20, 35, 50, 75, 90):
            links = [p for p, s in score.items() if s >= t / 100]
            assert got[name, t / 100] == (reach(links, range(24)) == {i: i % 4 for i in range(24)})


FEEDS = {
    "bare": '<rss><channel><item><title>A & B</title><link>http://x.org/1</link></item><item><title>C</title><link>http://x.org/2</link></item></channel></rss>',
    "cut": '<rss><channel><item><title>A</title><link>http://x.org/1</link></item><item><title>B</title><link>http://x.org/2</link><description>half',
    "cdata": '<rss><channel><item><title><![CDATA[A & <b>B</b> </item>]]></title><link>http://x.org/1</link></item></channel></rss>',
    "prefix": '<rss><channel><item><title>A</title><link>http://x.org/1</link><media:thumbnail url="http://i.org/a.png"/></item></channel></rss>',
    "stray": '<rss><channel><item><title>A</title><link>http://x.org/1</link><description>a <b</description></item><item><title>B</title><link>http://x.org/2</link></item></channel></rss>',
    "unclosed": '<rss><channel><item><title>A</title><link>http://x.org/1</link><item><title>B</title><link>http://x.org/2</link></item></channel></rss>',
    "lost": '<rss><channel><item><title>x</item><item><title>B</title><link>http://x.org/2</link></item></channel></rss>',
    "page": "<html><body>503 & down</body></html>",
    "empty": '<rss><channel></channel></rss>',
}


def test_broken_feeds_keep_what_can_be_read(spark):
    landed = spark.createDataFrame([(k, v, "rss") for k, v in FEEDS.items()] + [("none", None, "rss")], "source_id string, payload string, plugin string")
    got = {}
    for r in scans.scan_rss(landed).orderBy("entry_no").collect():
        got.setdefault(r.source_id, []).append((r.entry_no, r.title, r.url[-1], r.image_url))
    assert got == {
        "bare": [(0, "A & B", "1", None), (1, "C", "2", None)],
        "cut": [(0, "A", "1", None), (1, "B", "2", None)],
        "cdata": [(0, "A & <b>B</b> </item>", "1", None)],
        "prefix": [(0, "A", "1", "http://i.org/a.png")],
        "stray": [(0, "A", "1", None), (1, "B", "2", None)],
        "unclosed": [(0, "A", "1", None), (1, "B", "2", None)],
        "lost": [(1, "B", "2", None)],
    }
    failed = [(r.source_id, r.entry_no, r.error) for r in registry.failed_entries(landed).collect()]
    assert failed == [("lost", 0, "entry is not valid XML")]
    assert [tuple(r) for r in registry.unreadable(landed).collect()] == [("page", "payload is not a feed")]


def test_broken_atom_feeds(spark):
    entry = "<entry><id>http://arxiv.org/abs/2401.0000{0}v1</id><title>T{0} {1}</title><link href='http://x.org/{0}'/><summary>s</summary></entry>"
    whole = f"<feed xmlns='http://www.w3.org/2005/Atom'>{entry.format(1, '&')}{entry.format(2, '')}"
    landed = spark.createDataFrame([("a", whole, "org/r"), ("b", f"{whole}</feed>", "org/r")], "source_id string, payload string, repo string")
    papers = sorted((r.source_id, r.title) for r in scans.scan_paper_feed(landed).collect())
    assert papers == [("a", "T1 &"), ("a", "T2"), ("b", "T1 &"), ("b", "T2")]
    assert sorted(r.title for r in scans.scan_release_feed(landed).collect()) == ["org/r: T1 &"] * 2 + ["org/r: T2"] * 2
