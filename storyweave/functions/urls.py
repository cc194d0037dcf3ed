"""URL expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyweave.functions.binding import let

# Query parameters that only track the reader.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref_src"]

# Image hosts whose links do not stay usable.
UNRELIABLE_IMAGE_HOSTS = ["research.facebook.com", "fbcdn.net"]

PAPER_ABSTRACT_PREFIX = "https://arxiv.org/abs/"

_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def netloc(url: Column) -> Column:
    """Host with any port, lower case; '' when the text has none."""
    return F.lower(F.regexp_extract(url, _NETLOC, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def _decode(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def _encode(part: Column) -> Column:
    # url_encode keeps '*' and escapes '~'; form encoding wants the opposite.
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(url: Column) -> Column:
    pieces = F.filter(F.split(F.regexp_extract(url, _QUERY, 1), "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~F.lower(p["k"]).startswith(TRACKING_PREFIX)
        & ~F.lower(p["k"]).isin(TRACKING_KEYS),
    )
    return F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))),
        "&",
    )


def canonical_url(url: Column) -> Column:
    """One spelling per article: https, bare lower-case host, no trailing
    slash, no tracking parameters, the rest sorted, no fragment."""
    cleaned = F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), r"[\t\r\n]", "")

    def build(u: Column) -> Column:
        host = F.regexp_replace(netloc(u), r"^www\.", "")
        rooted = let(
            F.regexp_replace(url_path(u), "/+$", ""),
            lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)),
        )
        tail = let(canonical_query(u), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
        return F.concat(F.lit("https://"), host, rooted, tail)

    return let(cleaned, build)


def url_hash(url: Column) -> Column:
    return F.sha2(canonical_url(url), 256)


def link_key(url: Column) -> Column:
    """Host and path only, so that query strings never hide a shared citation."""
    return F.concat(netloc(url), F.regexp_replace(url_path(url), "/+$", ""))


def link_keys(urls: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(urls, F.array().cast("array<string>")), link_key))


def hostname_of(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), url)


def is_denied_host(url: Column, denied: list[str] | None = None) -> Column:
    def check(host: Column) -> Column:
        result = F.lit(False)
        for name in denied if denied is not None else UNRELIABLE_IMAGE_HOSTS:
            result = result | (host == name) | host.endswith("." + name)
        return result

    return F.coalesce(let(netloc(url), check), F.lit(False))


def fold_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", done)
            .when(segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
            .otherwise(F.array_append(done, segment))
        )

    folded = let(F.split(path, "/"), lambda parts: F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array(F.get(parts, F.lit(0))), step))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), let(folded, lambda f: F.when(F.size(f) == 1, F.lit("/")).otherwise(F.array_join(f, "/")))).otherwise(path)


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    scheme = F.coalesce(F.nullif(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit("")), F.lit("https"))
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(base, _NETLOC, 1))
    folder = let(F.regexp_replace(url_path(base), "[^/]*$", ""), lambda f: F.when(f == "", F.lit("/")).otherwise(f))
    return let(
        link,
        lambda x: F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), x)
        .when(x.startswith("//"), F.concat(scheme, F.lit(":"), x))
        .when(x.startswith("/"), F.concat(origin, _folded(x)))
        .when(x.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), x))
        .otherwise(F.concat(origin, _folded(F.concat(folder, x)))),
    )


def _folded(reference: Column) -> Column:
    """Dot segments are folded in the path, not in a query or fragment."""
    return F.concat(fold_dots(F.regexp_extract(reference, r"^([^?#]*)", 1)), F.regexp_extract(reference, r"^[^?#]*(.*)$", 1))


def is_paper_abstract(url: Column) -> Column:
    return url.startswith(PAPER_ABSTRACT_PREFIX)


def needs_image_fetch(image_url: Column, checked_at: Column, url: Column) -> Column:
    return (
        (F.coalesce(image_url, F.lit("")) == "")
        & checked_at.isNull()
        & ~is_paper_abstract(url)
    )


def first_feed_image(media: Column, thumbnails: Column, enclosures: Column) -> Column:
    """First usable lead image of a feed entry. ``media`` holds structs
    (url, medium, type), ``thumbnails`` (url), ``enclosures`` (url, type)."""
    def kind(m: Column) -> Column:
        return F.lower(F.coalesce(m["type"], F.lit("")))

    def given(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    usable_media = F.filter(
        media,
        lambda m: given(m["url"])
        & (
            (F.coalesce(m["medium"], F.lit("")) == "image")
            | kind(m).startswith("image/")
            | (~given(m["medium"]) & ~given(m["type"]))
        ),
    )
    usable_enclosures = F.filter(enclosures, lambda e: given(e["url"]) & kind(e).startswith("image/"))
    return F.coalesce(
        F.get(usable_media, F.lit(0))["url"],
        F.get(F.filter(thumbnails, lambda t: given(t["url"])), F.lit(0))["url"],
        F.get(usable_enclosures, F.lit(0))["url"],
    )
