import math

import pytest
from pyspark.sql import functions as F

from storyweave.functions import labels, text, urls, vectors


def one(spark, expression, **values):
    frame = spark.range(1)
    for name, value in values.items():
        frame = frame.withColumn(name, F.lit(value))
    return frame.select(expression.alias("x")).first().x


URLS = [
    ("HTTP://WWW.Example.com/a/b/?utm_source=x&b=2&a=1#frag", "https://example.com/a/b?a=1&b=2"),
    ("https://example.com", "https://example.com/"),
    ("  https://example.com///  ", "https://example.com/"),
    ("https://example.com:8443/x?UTM_Medium=1&fbclid=3&FBCLID=4", "https://example.com:8443/x"),
    ("https://example.com/x?b=&a", "https://example.com/x?a=&b="),
    ("https://example.com/x?q=a%20b&q=A+B", "https://example.com/x?q=A+B&q=a+b"),
    ("https://example.com/x?k=~t*&k=%zz", "https://example.com/x?k=%25zz&k=~t%2A"),
    ("https://www.www.example.com/", "https://www.example.com/"),
    ("//example.com/p", "https://example.com/p"),
    ("https://example.com/x?a=1=2&ref_src=tw&ref=keep", "https://example.com/x?a=1%3D2&ref=keep"),
]


@pytest.mark.parametrize("raw,want", URLS)
def test_canonical_url(spark, raw, want):
    assert one(spark, urls.canonical_url(F.col("u")), u=raw) == want


def test_url_hash_ignores_spelling(spark):
    rows = spark.createDataFrame([("http://www.a.com/x/?b=1&a=2",), ("https://A.com/x?a=2&b=1&gclid=9",)], "u string")
    assert rows.select(urls.url_hash(F.col("u")).alias("h")).distinct().count() == 1


def test_link_keys_drop_query_and_repeat(spark):
    got = one(spark, urls.link_keys(F.array(F.lit("https://A.com/p/?x=1"), F.lit("http://a.com/p#z"), F.lit("https://a.com/"))))
    assert got == ["a.com/p", "a.com"]


def test_resolve_url(spark):
    base = F.lit("https://s.example.com/news/list?page=1")
    for link, want in [("/a", "https://s.example.com/a"), ("b", "https://s.example.com/news/b"), ("//c.org/x", "https://c.org/x"),
                       ("https://d.org/", "https://d.org/")]:
        assert one(spark, urls.resolve_url(base, F.lit(link))) == want


def test_denied_hosts(spark):
    for url, want in [("https://fbcdn.net/a", True), ("https://x.y.fbcdn.net/a", True), ("https://notfbcdn.net/a", False),
                      ("https://research.facebook.com/file", True), ("https://facebook.com/f", False)]:
        assert one(spark, urls.is_denied_host(F.lit(url))) is want
    assert one(spark, urls.is_denied_host(F.lit(None).cast("string"))) is False


def test_entities(spark):
    got = one(spark, text.extract_entities(F.lit("The OpenAI GPT-5 model beat éAcme and AI. We saw V4, x2.5 In Paris-based labs.")))
    # 'Acme' hangs on a letter, so no word starts there
    assert set(got) == {"openai", "gpt-5", "gpt", "ai", "v4", "x2.5", "paris-based"}
    assert one(spark, text.extract_entities(F.lit(None).cast("string"))) == []
    assert one(spark, text.extract_entities(F.lit(""))) == []


def test_keyword_hits(spark):
    for body, want in [("An AI chip", 2), ("ai chips", 0), ("again detail", 0), ("Deep Learning and LLM", 2), ("", 0), ("AI-driven AI", 3)]:
        assert one(spark, text.keyword_hits(F.lit(body))) == want, body


def test_content_hash_folds_space_and_case(spark):
    rows = spark.createDataFrame([("Hello  World",), (" hello world\n",), ("HELLO\tWORLD",)], "t string")
    assert rows.select(text.content_hash(F.col("t")).alias("h")).distinct().count() == 1


def test_html_to_text(spark):
    page = "<p>Fish &amp; <b>chips</b>&nbsp;&eacute;</p><!-- no --><script>var x='<p>';</script><nav>menu</nav>"
    assert one(spark, text.html_to_text(F.lit(page))) == "Fish & chips é"
    assert one(spark, text.html_to_text(F.lit("a &amp;lt; b"))) == "a &lt; b"
    assert one(spark, text.html_to_text(F.lit("<br>  "))) == "<br>"
    assert one(spark, text.html_to_text(F.lit("2 < 3 and 5 > 4"))) == "2 < 3 and 5 > 4"


def test_choose_text(spark):
    long = "A summary that is long enough"
    assert one(spark, text.choose_text(F.lit(long), F.lit("https://a.com"), F.lit("page"))) == long
    assert one(spark, text.choose_text(F.lit("short"), F.lit("https://arxiv.org/abs/1"), F.lit("page"))) == ""
    assert one(spark, text.choose_text(F.lit(None).cast("string"), F.lit("https://a.com"), F.lit(" the\n page "))) == "the page"


def test_meta_image_falls_through(spark):
    html = ("<meta content='//x.fbcdn.net/a.png' property='og:image'><meta name=\"twitter:image\" content=\" \">"
            "<meta name='twitter:image:src' content='/b.png?x=1&amp;y=2'>")
    assert one(spark, text.meta_image(F.lit(html), F.lit("https://s.com/p"))) == "https://s.com/b.png?x=1&y=2"
    assert one(spark, text.meta_image(F.lit("<p>none</p>"), F.lit("https://s.com/p"))) is None


def test_dates(spark):
    for raw, want in [("Tue, 02 Jan 2024 03:04:05 GMT", 1704164645), ("2024-01-02T03:04:05+02:00", 1704157445), ("2024-01-02", 1704153600),
                      ("January 2, 2024", 1704153600), ("Jan 2, 2024", 1704153600), ("2 January 2024", 1704153600),
                      ("2024-01-02T03:04:05.123Z", 1704164645), ("yesterday", None), ("", None)]:
        assert one(spark, F.unix_seconds(text.parse_loose_date(F.lit(raw)))) == want, raw


def test_strip_reasoning(spark):
    for raw, want in [("<think>a\nb</think> x", "x"), ("x <THINK>cut", "x"), ("<think>a</reasoning>b", ""), ("plain", "plain"),
                      ("<reasoning>a</reasoning>x<reflection>b</reflection>y", "xy")]:
        assert one(spark, text.strip_reasoning(F.lit(raw))) == want


def test_model_object(spark):
    schema = "headline string"
    for raw, want in [('{"headline": "h"}', "h"), ('```json\n{"headline": "h"}\n```', "h"), ('["x"]', None), ("prose", None)]:
        got = one(spark, text.parse_model_object(F.lit(raw), schema))
        assert (got.headline if got else None) == want


def test_labels(spark):
    assert one(spark, text.label_words(F.lit("github-releases v2_beta"))) == "Github Releases V2 Beta"
    assert one(spark, text.label_words(F.lit("openAI"))) == "OpenAI"
    assert one(spark, text.label_words(F.lit(""))) == "Uncategorized"
    assert one(spark, labels.display_score(F.lit(0.625))) == 63
    assert one(spark, labels.lit_ticks(F.lit(0.0))) == 1
    assert one(spark, text.clip(F.lit("x" * 301), 300)) == "x" * 300 + "..."


def test_cosine_is_safe(spark):
    def cos(a, b):
        return one(spark, vectors.cosine(F.lit(a), F.lit(b)))

    assert cos([1.0, 2.0], [1.0, 2.0]) == 1.0
    assert cos([0.0, 0.0], [1.0, 2.0]) == 0.0
    assert cos([math.nan, 1.0], [1.0, 2.0]) == 0.0
    assert cos([math.inf, 1.0], [1.0, 2.0]) == 0.0
    assert cos([1.0, 0.0], [-1.0, 0.0]) == -1.0


def test_undated_pairs_are_not_penalised(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    args = (F.lit(1.0), F.lit(0.5), F.lit(0.0))
    assert one(spark, vectors.pair_score(*args, now, none)) == pytest.approx(0.8)
    assert one(spark, vectors.pair_score(*args, now, now)) == pytest.approx(0.8)
    later = F.lit("2024-01-03").cast("timestamp")
    assert one(spark, vectors.pair_score(*args, now, later)) == 0.0
    with pytest.raises(ValueError):
        vectors.pair_score(*args, now, now, cosine_weight=0.7)


def test_verdict_band(spark):
    for score, want in [(0.53, "same"), (0.529, "ambiguous"), (0.471, "ambiguous"), (0.47, "different")]:
        assert one(spark, vectors.adjudicate(F.lit(score), F.lit(0.5))) == want


def test_jaccard_of_nothing_is_zero(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, vectors.jaccard(empty, empty)) == 0.0
    assert one(spark, vectors.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


def test_effective_since(spark):
    now = F.lit("2024-01-10").cast("timestamp")
    last = F.lit("2024-01-01").cast("timestamp")
    since, capped = labels.effective_since(last, F.lit(None).cast("int"), now)
    assert one(spark, since.cast("string")) == "2024-01-08 00:00:00" and one(spark, capped) is True
    since, capped = labels.effective_since(last, F.lit(30), now)
    assert one(spark, since.cast("string")) == "2024-01-01 00:00:00" and one(spark, capped) is False
    since, _ = labels.effective_since(last, F.lit(30), now, override_days=90)
    assert one(spark, since.cast("string")) == "2023-10-12 00:00:00"
    since, capped = labels.effective_since(F.lit(None).cast("timestamp"), F.lit(None).cast("int"), now)
    assert one(spark, since.cast("string")) == "2024-01-08 00:00:00" and one(spark, capped) is True


def test_phrases_are_plain_text(spark):
    def hits(value, phrases):
        return spark.range(1).select(text.keyword_hits(F.lit(value), phrases).alias("x")).first().x

    assert hits("node.js and nodexjs", ["node.js"]) == 1
    assert hits("three plain words", []) == 0
    assert hits("c++ or C++, not c+", ["c++"]) == 2


def test_meta_image_quotes_references_and_dots(spark):
    def image(tag, page="https://x.com/a/b/c.html"):
        return spark.range(1).select(text.meta_image(F.lit(tag), F.lit(page)).alias("x")).first().x

    assert image("<meta property=\"og:image\" content=\"https://x.com/o'brien.png\">") == "https://x.com/o'brien.png"
    assert image("<meta property='og:image' content='/i.png?a=1&amp;b=2&#x26;c'>") == "https://x.com/i.png?a=1&b=2&c"
    assert image('<meta name="og:image" content="../img/./i.png">') == "https://x.com/a/img/i.png"
    assert image('<meta name="og:image" content="../../../../i.png?q=../x">') == "https://x.com/i.png?q=../x"
