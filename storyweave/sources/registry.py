"""Source plugins: name -> reader of landed payloads."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweave.sources import scans

Reader = Callable[..., DataFrame]
_READERS: dict[str, Reader] = {}


def register(name: str) -> Callable[[Reader], Reader]:
    def add(reader: Reader) -> Reader:
        _READERS[name] = reader
        return reader

    return add


def known_plugins() -> list[str]:
    return sorted(_READERS)


def reader_for(name: str) -> Reader:
    if name not in _READERS:
        raise KeyError(f"unknown source plugin {name!r}; known: {', '.join(known_plugins())}")
    return _READERS[name]


for _name, _reader in {
    "rss": scans.scan_rss,
    "github_releases": scans.scan_release_feed,
    "arxiv": scans.scan_paper_feed,
    "hackernews": scans.scan_scored_json,
    "scraper": scans.scan_html_listing,
}.items():
    register(_name)(_reader)


#: Plugins whose payloads are JSON of this form, and those whose payloads are feeds.
_JSON = {"hackernews": scans.POSTS_SCHEMA}
_FEEDS = {"rss": "rss", "github_releases": "atom", "arxiv": "atom"}


def unreadable(landed: DataFrame) -> DataFrame:
    """(source_id, error) of landed payloads that can't be read at all: JSON
    that does not parse, and what is no feed where one is expected, such as an
    error page. Of a feed that is broken in places the rest is read."""
    error = F.lit(None).cast("string")
    for name, schema in _JSON.items():
        error = F.when((F.col("plugin") == name) & F.from_json("payload", schema).isNull(), "payload is not valid JSON").otherwise(error)
    error = F.when(F.col("plugin").isin(*_FEEDS) & ~scans.is_feed(F.col("payload")), "payload is not a feed").otherwise(error)
    return landed.where(F.col("payload").isNotNull()).select("source_id", error.alias("error")).where(F.col("error").isNotNull())


def failed_entries(landed: DataFrame) -> DataFrame:
    """(source_id, entry_no, error) of the entries that can't be read inside feeds that can."""
    parts = [scans.failed_entries(landed.where(F.col("plugin") == name), form) for name, form in _FEEDS.items()]
    return reduce(DataFrame.unionByName, parts)


def read_landed(landed: DataFrame, plugins: list[str], options: dict[str, dict] | None = None) -> DataFrame:
    """All raw items of a landed table (plugin, source_id, payload, ...)."""
    parts = [
        reader_for(name)(landed.where(F.col("plugin") == name), **(options or {}).get(name, {})) for name in plugins
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
