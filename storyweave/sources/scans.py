"""Landed payloads to raw items.

Each reader takes a DataFrame of landed payloads (source_id, payload, ...) and
returns the common raw-item columns. Fetching happens elsewhere.

A feed that is no valid XML as a whole is cut into its entries, and each is read
alone: as it stands, then with bare ampersands escaped, then from those of its
elements that are whole. So one bad entry, or an end that is missing, costs no
other entry; what can't be read at all is a failed entry with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweave.functions import labels, text, urls
from storyweave.functions.binding import let

# Fixed value: the id of a paper in a feed, without its version.
PAPER_ID = r"arxiv\.org/abs/([\d.]+?)(?:v\d+)?$"

RAW_COLUMNS = ["source_id", "entry_no", "url", "title", "summary", "published_at", "outbound_links", "image_url"]

_LINK = "struct<_VALUE:string,_href:string,_rel:string>"
_MEDIA = "array<struct<_url:string,_medium:string,_type:string>>"
_ITEM = (
    "struct<title:string,link:string,description:string,pubDate:string,updated:string,"
    f"`media:content`:{_MEDIA},`media:thumbnail`:array<struct<_url:string>>,"
    "enclosure:array<struct<_url:string,_type:string>>>"
)
RSS_SCHEMA = f"channel struct<item:array<{_ITEM}>>"
_ENTRY = (
    f"struct<id:string,title:string,link:array<{_LINK}>,published:string,updated:string,summary:string,content:string,"
    f"`media:content`:{_MEDIA},`media:thumbnail`:array<struct<_url:string>>>"
)
ATOM_SCHEMA = f"entry array<{_ENTRY}>"
POSTS_SCHEMA = "array<struct<id:bigint,title:string,url:string,score:bigint,time:bigint,type:string>>"


def _optional_since(landed: DataFrame) -> Column:
    return F.col("since") if "since" in landed.columns else F.lit(None).cast("timestamp")


def _finish(rows: DataFrame) -> DataFrame:
    """Common tail: canonical URL, since cut, common columns."""
    return (
        rows.where(labels.since_filter(F.col("published_at"), F.col("since")))
        .withColumn("outbound_links", F.array().cast("array<string>"))
        .select(*RAW_COLUMNS)
    )


def _media(items: Column, has_enclosure: bool) -> Column:
    none = F.array().cast("array<struct<url:string,type:string>>")
    media = F.transform(
        F.coalesce(items["media:content"], F.array().cast(_MEDIA)),
        lambda m: F.struct(m["_url"].alias("url"), m["_medium"].alias("medium"), m["_type"].alias("type")),
    )
    thumbs = F.transform(
        F.coalesce(items["media:thumbnail"], F.array().cast("array<struct<_url:string>>")),
        lambda m: F.struct(m["_url"].alias("url")),
    )
    enclosures = F.transform(
        F.coalesce(items["enclosure"], F.array().cast("array<struct<_url:string,_type:string>>")),
        lambda m: F.struct(m["_url"].alias("url"), m["_type"].alias("type")),
    ) if has_enclosure else none
    return urls.first_feed_image(media, thumbs, enclosures)


def _blank_to_null(column: Column) -> Column:
    return text.none_if_blank(column)


#: Prefixes that feeds use and often forget to declare.
_PREFIXES = ("media", "dc", "content", "atom", "itunes")
#: An ampersand that starts none of the references XML knows.
_BARE = "&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)"
#: An element with its end, wherever it stands.
_ELEMENT = r"(?s)<([A-Za-z][\w:.-]*)(?:\s[^<>]*)?(?:/>|>.*?</\1\s*>)"


def _cut_entries(payload: Column, tag: str, entry: str) -> Column:
    """The entries of a payload that is no valid document, each read alone; null where one can't be."""
    pieces = F.regexp_extract_all(payload, F.lit(rf"(?s)<{tag}[\s>].*?(?:</{tag}\s*>|(?=<{tag}[\s>])|\z)"), F.lit(0))
    found = F.array_join(F.array_distinct(F.regexp_extract_all(
        payload, F.lit(r"xmlns:[\w.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*')"), F.lit(0))), " ")
    missing = [(F.lit(f"xmlns:{prefix}"), F.lit(f' xmlns:{prefix}="{prefix}"')) for prefix in _PREFIXES]
    # a payload is searched for its prefixes once, not for each of its entries
    declared = let(found, lambda d: F.concat(d, *(F.when(d.contains(name), "").otherwise(text_) for name, text_ in missing)))
    return let(declared, lambda d: F.transform(pieces, lambda p: _read_entry(p, d, tag, entry)))


def _read_entry(entry_text: Column, declared: Column, tag: str, entry: str) -> Column:
    """An entry as it stands, then with bare ampersands escaped, then from its whole elements; else null."""
    def alone(piece: Column) -> Column:
        return F.from_xml(F.concat(F.lit("<x "), declared, F.lit(">"), piece, F.lit("</x>")), f"{tag} {entry}")[tag]

    def whole_elements(piece: Column) -> Column:
        inside = F.regexp_replace(piece, rf"^<{tag}[^>]*>|</{tag}\s*>$", "")
        escaped = F.regexp_replace(inside, _BARE, "&amp;")
        elements = F.filter(
            F.regexp_extract_all(escaped, F.lit(_ELEMENT), F.lit(0)),
            lambda e: alone(F.concat(F.lit(f"<{tag}>"), e, F.lit(f"</{tag}>"))).isNotNull(),
        )
        return F.when(F.size(elements) > 0, alone(F.concat(F.lit(f"<{tag}>"), F.array_join(elements, ""), F.lit(f"</{tag}>"))))

    return F.coalesce(alone(entry_text), alone(F.regexp_replace(entry_text, _BARE, "&amp;")), whole_elements(entry_text))


def _entries(landed: DataFrame, schema: str, entries: str, tag: str, entry: str, *extra: str) -> DataFrame:
    """source_id, ``extra``, since, entry_no and e, null for an entry that can't be read."""
    documents = landed.select(
        "source_id", *extra, "payload", _optional_since(landed).alias("since"), F.from_xml("payload", schema).alias("doc"))
    # the cut runs only for payloads that are no document
    found = F.coalesce(F.col(f"doc.{entries}"), _cut_entries(F.col("payload"), tag, entry))
    return documents.select("source_id", *extra, "since", F.posexplode(found).alias("entry_no", "e"))


def is_feed(payload: Column) -> Column:
    """Whether a payload has an element that feeds start with; an error page has none."""
    return payload.rlike(r"(?i)<(?:[\w.-]+:)?(?:rss|rdf|channel|feed)[\s>]")


def failed_entries(landed: DataFrame, form: str) -> DataFrame:
    """(source_id, entry_no, error) of entries of `rss` or `atom` payloads that can't be read."""
    entries = _rss_entries(landed) if form == "rss" else _atom_entries(landed)
    return entries.where(F.col("e").isNull()).select("source_id", "entry_no", F.lit("entry is not valid XML").alias("error"))


def _rss_entries(landed: DataFrame) -> DataFrame:
    return _entries(landed, RSS_SCHEMA, "channel.item", "item", _ITEM)


def scan_rss(landed: DataFrame) -> DataFrame:
    """RSS documents, one per row."""
    return rss_items(_rss_entries(landed))


def rss_items(entries: DataFrame) -> DataFrame:
    """entries (source_id, entry_no, since, e) with one RSS item per row."""
    e = F.col("e")
    return _finish(
        entries.where(F.coalesce(e["link"], F.lit("")) != "").select(
            "source_id", "entry_no", "since", urls.canonical_url(e["link"]).alias("url"),
            text.strip(F.coalesce(e["title"], F.lit(""))).alias("title"),
            _blank_to_null(e["description"]).alias("summary"),
            text.parse_loose_date(F.coalesce(e["pubDate"], e["updated"])).alias("published_at"),
            _media(e, True).alias("image_url"),
        )
    )


def _entry_link(e: Column) -> Column:
    """The alternate link of an Atom entry, else the first."""
    wanted = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.get(wanted, F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"])


def _atom_entries(landed: DataFrame) -> DataFrame:
    return _entries(landed, ATOM_SCHEMA, "entry", "entry", _ENTRY, *(c for c in ("repo",) if c in landed.columns))


def scan_release_feed(landed: DataFrame) -> DataFrame:
    """Atom release feeds; ``landed`` also carries repo."""
    e = F.col("e")
    link = _entry_link(e)
    return _finish(
        _atom_entries(landed).where(F.coalesce(link, F.lit("")) != "").select(
            "source_id", "entry_no", "since", urls.canonical_url(link).alias("url"),
            F.concat("repo", F.lit(": "), text.strip(F.coalesce(e["title"], F.lit("")))).alias("title"),
            _blank_to_null(F.coalesce(e["summary"], e["content"])).alias("summary"),
            text.parse_loose_date(F.coalesce(e["updated"], e["published"])).alias("published_at"),
            _media(e, False).alias("image_url"),
        )
    )


def scan_paper_feed(landed: DataFrame) -> DataFrame:
    """Atom paper feeds; versions of one paper share a URL, ids of another
    shape are dropped."""
    e = F.col("e")
    paper = F.regexp_extract(e["id"], PAPER_ID, 1)
    return _finish(
        _atom_entries(landed).where(F.coalesce(paper, F.lit("")) != "").select(
            "source_id", "entry_no", "since", F.concat(F.lit(urls.PAPER_ABSTRACT_PREFIX), paper).alias("url"),
            text.collapse_whitespace(F.coalesce(e["title"], F.lit(""))).alias("title"),
            _blank_to_null(text.collapse_whitespace(F.coalesce(e["summary"], F.lit("")))).alias("summary"),
            text.parse_loose_date(F.coalesce(e["published"], e["updated"])).alias("published_at"),
            F.lit(None).cast("string").alias("image_url"),
        )
    )


def scan_scored_json(landed: DataFrame, min_score: int = 100) -> DataFrame:
    """JSON lists of scored posts."""
    posts = (
        landed.select("source_id", _optional_since(landed).alias("since"), F.from_json("payload", POSTS_SCHEMA).alias("posts"))
        .select("source_id", "since", F.posexplode("posts").alias("entry_no", "p"))
    )
    p = F.col("p")
    wanted = (
        (p["type"] == "story") & (F.coalesce(p["url"], F.lit("")) != "")
        & (F.coalesce(p["score"], F.lit(0)) >= min_score)
    )
    return _finish(
        posts.where(wanted).select(
            "source_id", "entry_no", "since", urls.canonical_url(p["url"]).alias("url"),
            text.strip(F.coalesce(p["title"], F.lit(""))).alias("title"), F.lit(None).cast("string").alias("summary"),
            F.timestamp_seconds(p["time"]).alias("published_at"), F.lit(None).cast("string").alias("image_url"),
        )
    )


def scan_html_listing(
    pages: DataFrame, *, card: str, link: str = r"<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']", title: str | None = None,
    date: str | None = None, summary: str | None = None,
) -> DataFrame:
    """Listing pages (source_id, url, html) to one row per card. Every
    selector is a pattern whose first group holds the value; ``card`` cuts the
    page into cards, the others look inside one. Cards without a link drop."""
    def inside(pattern: str | None, fallback: Column) -> Column:
        return F.regexp_extract("card", pattern, 1) if pattern else fallback

    cards = pages.select(
        "source_id", _optional_since(pages).alias("since"), F.col("url").alias("page_url"),
        F.posexplode(F.regexp_extract_all("html", F.lit(f"(?is){card}"), F.lit(0))).alias("entry_no", "card"),
    )
    href = F.replace(F.regexp_extract("card", f"(?is){link}", 1), F.lit("&amp;"), F.lit("&"))
    whole = F.col("card")
    flag = "(?is)"
    date_text = inside(flag + date if date else None, F.lit(None).cast("string"))
    summary_text = inside(flag + summary if summary else None, F.lit(None).cast("string"))
    return _finish(
        cards.where(href != "").select(
            "source_id", "entry_no", "since", urls.canonical_url(urls.resolve_url(F.col("page_url"), href)).alias("url"),
            text.html_to_text(inside(flag + title if title else None, whole)).alias("title"),
            _blank_to_null(text.html_to_text(summary_text)).alias("summary"),
            text.parse_loose_date(text.html_to_text(date_text)).alias("published_at"),
            F.lit(None).cast("string").alias("image_url"),
        )
    )
