"""The published bundle: validated, paged, content-addressed."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from storyweave import schemas
from storyweave.functions import text
from storyweave.operators.ordering import ordinal, ordinal_within

VERSION = 1


class ContractError(ValueError):
    """A payload does not fit its contract; nothing was written."""


def iso(column: str) -> Column:
    """ISO text; a fraction appears only when there is one."""
    whole = F.unix_micros(column) % 1_000_000 == 0
    return F.when(whole, F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss+00:00")).otherwise(
        F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00")
    )


def publishable(stories: DataFrame, members: DataFrame, as_of: datetime, retention_days: int = 2) -> DataFrame:
    """Scored stories inside the window with at least one dated member."""
    return in_window(stories.where(F.col("score").isNotNull()), members, as_of, retention_days)


def in_window(stories: DataFrame, members: DataFrame, as_of: datetime, retention_days: int = 2) -> DataFrame:
    """Stories (story_id, updated_at) inside the window with at least one dated member."""
    cutoff = F.unix_micros(F.lit(as_of).cast("timestamp")) - retention_days * 86_400_000_000
    dated = members.where(F.col("published_at").isNotNull()).select("story_id")
    return stories.where(F.unix_micros("updated_at") >= cutoff).join(
        dated, "story_id", "left_semi"
    )


def lead_images(members: DataFrame, sources: DataFrame) -> DataFrame:
    """(story_id, lead_image_url) of the member with the highest source
    authority, then the lowest id."""
    return (
        members.where(F.coalesce("image_url", F.lit("")) != "")
        .join(sources.select("source_id", "authority"), "source_id")
        .groupBy("story_id")
        .agg(F.max_by("image_url", F.struct(F.col("authority"), -F.col("item_id"))).alias("lead_image_url"))
    )


def story_source_ids(members: DataFrame) -> DataFrame:
    return members.select("story_id", "source_id").distinct().groupBy("story_id").agg(
        F.array_sort(F.collect_list("source_id")).alias("source_ids")
    )


def story_evidence(members: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """(story_id, part, part_count, evidence[]) with evidence by item id. A story of any
    size is cut into parts of bounded length; nearly all have one."""
    slim = members.select(
        "story_id", F.col("item_id").alias("id"), "title", "url", "source_id", iso("published_at").alias("published_at")
    )
    placed = ordinal_within(slim, "story_id", F.col("id").asc())
    return (
        placed.withColumn("part", F.floor((F.col("position") - 1) / part_rows).cast("long"))
        .groupBy("story_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("id", "title", "url", "source_id", "published_at"))).alias("evidence"))
        .withColumn("part_count", F.count("*").over(W.partitionBy("story_id")).cast("long"))
    )


def _optional(df: DataFrame, name: str, kind: T.DataType) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def story_details(stories: DataFrame, members: DataFrame, sources: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """One row per story and evidence part: id, part, path, hash and the
    serialised document."""
    inside = members.join(stories.select("story_id"), "story_id", "left_semi")
    full = stories.join(story_evidence(inside, part_rows), "story_id")
    if "image_url" in members.columns:
        full = full.join(lead_images(inside, sources), "story_id", "left")
    document = full.select(
        F.col("story_id").cast("long").alias("id"), "part", "part_count", "title", _optional(full, "kind", schemas.S).alias("kind"),
        *[_optional(full, c, schemas.S).alias(c)
          for c in ("category", "summary", "summary_provider", "analysis", "analysis_provider")],
        "score", _optional(full, "score_breakdown", schemas.BREAKDOWN).alias("score_breakdown"),
        iso("first_seen").alias("first_seen"), iso("updated_at").alias("updated_at"),
        F.col("item_count").cast("long").alias("item_count"), F.col("outlet_count").cast("long").alias("outlet_count"),
        _optional(full, "lead_image_url", schemas.S).alias("lead_image_url"), "evidence",
    )
    return document


def serialise(document: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """keep + payload (key-sorted JSON) and its hash."""
    payload = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return document.select(*keep, payload.alias("payload")).withColumn("hash", text.payload_hash(F.col("payload")))


def detail_files(documents: DataFrame) -> DataFrame:
    columns = [f.name for f in schemas.STORY_DETAIL]
    files = serialise(documents, columns, ["id", "part", "part_count"])
    suffix = F.when(F.col("part") > 0, F.format_string("-%d", "part")).otherwise(F.lit(""))
    return files.withColumn("path", F.concat(F.format_string("story/%d", "id"), suffix, F.lit("-"), F.col("hash"), F.lit(".json")))


def feed_rows(stories: DataFrame, members: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """Feed cards in importance order with their position (1-based)."""
    inside = members.join(stories.select("story_id"), "story_id", "left_semi")
    heads = files.where(F.col("part") == 0).select(
        F.col("id").alias("story_id"), F.col("path").alias("detail_path"), F.col("hash").alias("detail_hash")
    )
    full = stories.join(heads, "story_id").join(story_source_ids(inside), "story_id")
    if "image_url" in members.columns:
        full = full.join(lead_images(inside, sources), "story_id", "left")
    cards = full.select(
        F.col("story_id").cast("long").alias("id"), "title", _optional(full, "kind", schemas.S).alias("kind"),
        _optional(full, "category", schemas.S).alias("category"), _optional(full, "summary", schemas.S).alias("summary"),
        "score", F.col("item_count").cast("long").alias("item_count"),
        F.col("outlet_count").cast("long").alias("outlet_count"), iso("updated_at").alias("updated_at"),
        "detail_path", "detail_hash", _optional(full, "lead_image_url", schemas.S).alias("lead_image_url"), "source_ids",
        _optional(full, "importance_rank", T.IntegerType()).alias("importance_rank"),
        _optional(full, "importance_band", schemas.S).alias("importance_band"),
        _optional(full, "importance_reason", schemas.S).alias("importance_reason"),
    )
    return ordinal(cards, F.col("score").desc(), F.col("id").asc(), out="feed_pos")


def page_of(position: Column, page_size: int) -> Column:
    return F.floor((position - 1) / page_size).cast("long")


def feed_pages(cards: DataFrame, page_size: int = 50) -> DataFrame:
    """(page, page_count, stories[]); an empty feed still has one empty page."""
    row = F.struct(*[f.name for f in schemas.FEED_ROW])
    filled = cards.groupBy(page_of(F.col("feed_pos"), page_size).alias("page")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("feed_pos", row.alias("row")))), lambda r: r["row"]
        ).alias("stories")
    )
    count = cards.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / page_size)).cast("long").alias("page_count"))
    skeleton = count.select("page_count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("page_count") - 1)).alias("page"))
    return skeleton.join(filled, "page", "left").select(
        "page", "page_count",
        F.coalesce("stories", F.array().cast(filled.schema["stories"].dataType)).alias("stories"),
    )


def page_files(pages: DataFrame) -> DataFrame:
    counted = pages.withColumn("count", F.size("stories").cast("long"))
    files = serialise(counted, ["page", "page_count", "stories"], ["page", "count"])
    return files.withColumn("path", F.concat(F.format_string("feed/page-%d-", "page"), F.col("hash"), F.lit(".json")))


def bundle_embeddings(cards: DataFrame, stories: DataFrame) -> DataFrame:
    """(position, id, vector) in feed order. Vectors unlike the first one in
    length are left out."""
    vectors = cards.select("feed_pos", "id").join(
        stories.where(F.col("centroid").isNotNull()).select(F.col("story_id").alias("id"), "centroid"), "id"
    )
    dims = vectors.agg(F.min_by(F.size("centroid"), "feed_pos").alias("d"))
    fitting = vectors.where(F.size("centroid") == dims.select("d").scalar())
    return ordinal(
        fitting.select("feed_pos", "id", F.col("centroid").cast("array<float>").alias("vector")),
        F.col("feed_pos").asc(), out="position",
    ).select((F.col("position") - 1).alias("position"), "id", "vector")


def dominant_model(stories: DataFrame, members: DataFrame) -> DataFrame:
    """One row: the most frequent model over the members of the stories, the
    first by name on a tie."""
    counts = (
        members.where(F.col("model_id").isNotNull()).join(stories.select("story_id"), "story_id", "left_semi")
        .groupBy("model_id").agg(F.count("*").alias("n"))
    )
    return counts.orderBy(F.desc("n"), "model_id").limit(1).select("model_id")


def sources_report(sources: DataFrame) -> DataFrame:
    return (
        sources.where("enabled")
        .select(
            F.col("source_id").alias("id"), "plugin", "enabled", "cadence_minutes", iso("last_run_at").alias("last_run_at"),
            "consecutive_failures", text.clip(F.col("last_error"), 300).alias("last_error"),
            _optional(sources, "coverage_warning", schemas.S).alias("coverage_warning"), "territory",
        )
        .orderBy("id")
    )


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, ``hash``: the same for the same rows in any order, NULL for none."""
    row = F.xxhash64(*columns)
    parts = df.agg(
        F.count("*").alias("n"), F.bit_xor(row).alias("x"),
        F.sum(F.xxhash64(F.lit("digest"), *columns).cast("decimal(20,0)")).alias("s"),
    )
    return parts.select(F.when(F.col("n") > 0, F.sha2(F.concat_ws("|", "n", "x", "s"), 256)).alias("hash"))


def pages_digest(files: DataFrame) -> DataFrame:
    return digest(files, ["page", "path", "hash", "count"])


def embeddings_digest(embeddings: DataFrame) -> DataFrame:
    return digest(embeddings, ["position", "id", "vector"])


def manifest(
    stories: DataFrame, members: DataFrame, pages: DataFrame, embeddings: DataFrame, as_of: datetime, retention_days: int
) -> DataFrame:
    """The one-row head of the bundle. The page map and the embedding order
    are tables beside it, so that this row stays small at any size; it carries
    a hash of each, the one of the page map over the hashes of all pages."""
    totals = pages.agg(
        F.count("*").alias("page_count"), F.coalesce(F.sum("count"), F.lit(0)).alias("story_count")
    )
    shape = embeddings.agg(F.max(F.size("vector")).alias("dims"), F.count("*").alias("n"))
    model = dominant_model(stories, members).select("model_id").scalar()
    return totals.select(
        F.lit(VERSION).alias("version"),
        F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss+00:00").alias("generated_at"),
        model.alias("embedding_model_id"), shape.select("dims").scalar().alias("embedding_dimensions"),
        "story_count", "page_count", shape.select("n").scalar().alias("embedding_count"),
        F.lit("pages").alias("pages_path"), pages_digest(pages).scalar().alias("pages_hash"),
        F.lit("embeddings").alias("embeddings_path"), embeddings_digest(embeddings).scalar().alias("embeddings_hash"),
        F.lit("sources").alias("sources_path"), F.lit(retention_days).alias("retention_days"),
    )


def contract_violations(df: DataFrame, contract: T.StructType, name: str) -> list[str]:
    """Schema faults of a payload table, found without reading data."""
    faults = []
    wanted = {f.name: f for f in contract}
    for field in df.schema:
        if field.name not in wanted:
            faults.append(f"{name}: unknown field {field.name}")
        elif not _fits(field.dataType, wanted[field.name].dataType):
            faults.append(f"{name}: {field.name} is {field.dataType.simpleString()}")
    faults += [f"{name}: missing field {n}" for n, f in wanted.items() if n not in df.columns and not f.nullable]
    return faults


def _fits(actual: T.DataType, wanted: T.DataType) -> bool:
    if isinstance(wanted, T.StructType):
        if not isinstance(actual, T.StructType):
            return False
        known = {f.name: f for f in wanted}
        required = {f.name for f in wanted if not f.nullable}
        names = set(actual.fieldNames())
        return names <= set(known) and required <= names and all(_fits(f.dataType, known[f.name].dataType) for f in actual)
    if isinstance(wanted, T.ArrayType):
        return isinstance(actual, T.ArrayType) and _fits(actual.elementType, wanted.elementType)
    return type(actual) is type(wanted)


def _missing(contract: T.StructType, at: str = "") -> Column:
    """True where a required value, nested ones included, is NULL."""
    out = F.lit(False)
    for field in contract:
        value = F.col(at + field.name)
        if not field.nullable:
            out = out | value.isNull()
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            required = [f.name for f in field.dataType.elementType if not f.nullable]
            if required:
                out = out | F.coalesce(
                    F.exists(value, lambda e: F.array_contains(F.array(*[e[n].isNull() for n in required]), True)),
                    F.lit(False),
                )
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.FloatType):
            out = out | F.coalesce(F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return out


def check_contract(df: DataFrame, contract: T.StructType, name: str) -> None:
    """Raise before anything is written when a payload does not fit."""
    faults = contract_violations(df, contract, name)
    if faults:
        raise ContractError("; ".join(faults))
    bad = df.where(_missing(contract)).count()
    if bad:
        raise ContractError(f"{name}: {bad} rows lack a required value")


def stale_paths(listing: DataFrame, kept: DataFrame) -> DataFrame:
    """Files on storage that this run did not write."""
    return listing.select("path").join(kept.select("path"), "path", "left_anti")


@dataclass
class Bundle:
    details: DataFrame
    cards: DataFrame
    pages: DataFrame
    page_files: DataFrame
    embeddings: DataFrame
    sources: DataFrame
    manifest: DataFrame


def build_bundle(
    stories: DataFrame, members: DataFrame, sources: DataFrame, as_of: datetime, *, retention_days: int = 2,
    page_size: int = 50, part_rows: int = 10_000, materialise=lambda df: df,
) -> Bundle:
    """Assemble and check every payload. ``materialise`` cuts lineage where a
    table feeds several outputs."""
    chosen = materialise(publishable(stories, members, as_of, retention_days))
    documents = materialise(story_details(chosen, members, sources, part_rows))
    check_contract(documents.drop("part", "part_count"), schemas.STORY_DETAIL, "story detail")
    details = detail_files(documents)
    cards = materialise(feed_rows(chosen, members, details, sources))
    check_contract(cards.drop("feed_pos"), schemas.FEED_ROW, "feed row")
    report = sources_report(sources)
    check_contract(report, schemas.SOURCE_HEALTH, "source health")
    pages = materialise(feed_pages(cards, page_size))
    check_contract(pages, schemas.FEED_PAGE, "feed page")
    files = page_files(pages)
    embeddings = materialise(bundle_embeddings(cards, chosen))
    check_contract(embeddings, schemas.EMBEDDING, "embedding")
    head = materialise(manifest(chosen, members, files, embeddings, as_of, retention_days))
    check_contract(head, schemas.MANIFEST, "manifest")
    return Bundle(details, cards, pages, files, embeddings, report, head)
