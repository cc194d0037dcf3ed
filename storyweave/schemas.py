"""Contracts of the published bundle. Article bodies and publisher summaries
have no field here, so they can never be published."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(required: dict[str, T.DataType], optional: dict[str, T.DataType]) -> T.StructType:
    fields = [T.StructField(n, t, False) for n, t in required.items()]
    fields += [T.StructField(n, t, True) for n, t in optional.items()]
    return T.StructType(fields)


S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()

BREAKDOWN = _struct({}, {"authority": D, "velocity": D, "novelty": D, "entity": D})

EVIDENCE = _struct({"id": L, "title": S, "url": S, "source_id": S}, {"published_at": S})

STORY_DETAIL = _struct(
    {"id": L, "title": S, "first_seen": S, "updated_at": S, "item_count": L, "outlet_count": L,
     "evidence": T.ArrayType(EVIDENCE)},
    {"kind": S, "category": S, "summary": S, "summary_provider": S, "analysis": S, "analysis_provider": S,
     "score": D, "score_breakdown": BREAKDOWN, "lead_image_url": S},
)

FEED_ROW = _struct(
    {"id": L, "title": S, "item_count": L, "outlet_count": L, "updated_at": S, "detail_path": S, "detail_hash": S,
     "source_ids": T.ArrayType(S)},
    {"kind": S, "category": S, "summary": S, "score": D, "lead_image_url": S, "importance_rank": T.IntegerType(),
     "importance_band": S, "importance_reason": S},
)

FEED_PAGE = _struct({"page": L, "page_count": L, "stories": T.ArrayType(FEED_ROW)}, {})

SOURCE_HEALTH = _struct(
    {"id": S, "plugin": S, "enabled": B, "cadence_minutes": T.IntegerType(), "consecutive_failures": T.IntegerType()},
    {"last_run_at": S, "last_error": S, "coverage_warning": S, "territory": S},
)

EMBEDDING = _struct({"position": L, "id": L, "vector": T.ArrayType(T.FloatType())}, {})

MANIFEST = _struct(
    {"version": T.IntegerType(), "generated_at": S, "story_count": L, "page_count": L, "embedding_count": L, "pages_path": S,
     "pages_hash": S, "embeddings_path": S, "sources_path": S, "retention_days": T.IntegerType()},
    {"embedding_model_id": S, "embedding_dimensions": T.IntegerType(), "embeddings_hash": S},
)

RAW_ITEM = _struct(
    {"url": S, "title": S},
    {"summary": S, "published_at": T.TimestampType(), "outbound_links": T.ArrayType(S), "image_url": S},
)
