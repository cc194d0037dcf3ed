"""Requests to and answers from the summary and analysis models, as tables.

The model call itself happens between the two jobs; both sides are data.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyweave.functions import text
from storyweave.operators.health import budget_used


def story_headlines(members: DataFrame, limit: int = 8) -> DataFrame:
    """(story_id, headlines): the first titles of each story as a list. Rows
    beyond the limit are cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("story_id").orderBy("item_id"))
    first = members.select("story_id", "item_id", "title").withColumn("_rn", rank).where(F.col("_rn") <= limit)
    return first.groupBy("story_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("item_id", "title"))),
                lambda t: F.concat(F.lit("- "), t["title"]),
            ),
            "\n",
        ).alias("headlines")
    )


def tier1_backlog(stories: DataFrame, limit: int = 100) -> DataFrame:
    """Scored stories without a summary yet, newest first."""
    return (
        stories.where((F.col("status") == "new") & F.col("score").isNotNull())
        .orderBy(F.desc("updated_at"), F.desc("story_id")).limit(limit)
    )


def tier2_candidates(stories: DataFrame, as_of: datetime, *, score_cut: float = 0.6, daily_budget: int = 20) -> DataFrame:
    """Best summarised stories, as many as today's budget still allows."""
    best = (
        stories.where(F.col("status").isin("enriched", "retry") & (F.col("score") >= score_cut))
        .orderBy(F.desc("score"), "story_id").limit(daily_budget)
    )
    # at most daily_budget rows reach this window
    ranked = best.withColumn("_rn", F.row_number().over(Window.orderBy(F.desc("score"), "story_id")))
    left = budget_used(stories, as_of, daily_budget).select("remaining").scalar()
    return ranked.where(F.col("_rn") <= left).drop("_rn")


# The prompts.
TIER1_PROMPT = (
    "You are a news editor. Below are headlines from multiple outlets covering the same underlying AI news event. "
    "Produce a single canonical headline, a two-sentence summary, and a short category label (one of: research, "
    "product, industry, policy, infrastructure, other).\n\nHeadlines:\n%s\n\nRespond with ONLY a JSON object of the "
    'form {"headline": "...", "summary": "...", "category": "..."}. No markdown, no code fence, no extra text.'
)
TIER2_PROMPT = (
    "You are a senior AI industry analyst. A story has cleared this outlet's importance bar. Given its canonical "
    'headline and summary below, write a short "why this matters" analysis: what is genuinely new versus prior art, '
    "what it affects, and any connections to earlier developments you can infer.\n\nHeadline: %s\nSummary: %s\n"
    "Category: %s\n\nRespond with plain text, a few sentences. No markdown headers."
)
TIER2_FALLBACK_PROMPT = "In one short paragraph, explain why this AI news story matters: %s. %s"


def _fill(template: str, *values: Column) -> Column:
    pieces = template.split("%s")
    out = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        out += [value, F.lit(piece)]
    return F.concat(*out)


def tier1_requests(stories: DataFrame, members: DataFrame, limit: int = 100) -> DataFrame:
    backlog = tier1_backlog(stories, limit)
    lines = story_headlines(members.join(backlog.select("story_id"), "story_id", "left_semi"))
    return backlog.select("story_id").join(lines, "story_id").select(
        "story_id", _fill(TIER1_PROMPT, F.col("headlines")).alias("prompt")
    )


def tier2_requests(stories: DataFrame, as_of: datetime, **settings) -> DataFrame:
    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("None"))

    return tier2_candidates(stories, as_of, **settings).select(
        "story_id", _fill(TIER2_PROMPT, F.col("title"), known("summary"), known("category")).alias("prompt"),
        _fill(TIER2_FALLBACK_PROMPT, F.col("title"), F.coalesce("summary", F.lit(""))).alias("fallback_prompt"),
    )


def _trimmed(column: str) -> Column:
    return text.none_if_blank(text.strip(F.coalesce(F.col(column), F.lit(""))))


def parse_tier1(responses: DataFrame) -> DataFrame:
    """responses (story_id, text, provider, model) -> parsed columns and an
    error for texts that are not one JSON object."""
    answer = text.parse_model_object(
        text.strip_reasoning(F.col("text")), "headline string, summary string, category string"
    )
    return responses.withColumn("_a", answer).select(
        "story_id", _answered_at(responses), F.concat_ws(":", "provider", "model").alias("summary_provider"),
        _trimmed("_a.headline").alias("headline"), _trimmed("_a.summary").alias("summary"),
        _trimmed("_a.category").alias("category"),
        F.when(F.col("_a").isNull(), F.lit("expected a JSON object")).alias("error"),
    )


def _one_answer(answers: DataFrame) -> DataFrame:
    """One answer (_r) per story: the latest by ``answered_at``, and of equals,
    or without that column, the greatest."""
    return answers.groupBy("story_id").agg(F.max_by("_r", F.struct("_at", "_r")).alias("_r"))


def _answered_at(responses: DataFrame) -> Column:
    at = F.col("answered_at") if "answered_at" in responses.columns else F.lit(None)
    return at.cast("timestamp").alias("_at")


def apply_tier1(stories: DataFrame, responses: DataFrame) -> DataFrame:
    """Stories with the accepted answers applied, one per story; a failed
    answer leaves its story as it was."""
    good = _one_answer(parse_tier1(responses).where(F.col("error").isNull()).select(
        "story_id", "_at", F.struct("headline", "summary", "category", "summary_provider").alias("_r")
    ))
    hit = F.col("_r").isNotNull()
    return (
        stories.join(good, "story_id", "left")
        .withColumn("title", F.coalesce("_r.headline", "title"))
        .withColumn("summary", F.when(hit, F.col("_r.summary")).otherwise(F.col("summary")))
        .withColumn("category", F.when(hit, F.col("_r.category")).otherwise(F.col("category")))
        .withColumn("summary_provider", F.when(hit, F.col("_r.summary_provider")).otherwise(F.col("summary_provider")))
        .withColumn("status", F.when(hit, F.lit("enriched")).otherwise(F.col("status")))
        .drop("_r")
    )


def apply_tier2(stories: DataFrame, responses: DataFrame, as_of: datetime) -> DataFrame:
    """responses (story_id, text, provider, model, degraded). A degraded
    answer is kept but queued for another try. One answer counts per story."""
    answers = _one_answer(responses.where(F.col("text").isNotNull()).select(
        "story_id", _answered_at(responses),
        F.struct(
            text.strip_reasoning(F.col("text")).alias("analysis"),
            F.concat_ws(":", "provider", "model").alias("by"), "degraded",
        ).alias("_r"),
    ))
    hit = F.col("_r").isNotNull()
    return (
        stories.join(answers, "story_id", "left")
        .withColumn("analysis", F.when(hit, F.col("_r.analysis")).otherwise(F.col("analysis")))
        .withColumn("analysis_provider", F.when(hit, F.col("_r.by")).otherwise(F.col("analysis_provider")))
        .withColumn("analyzed_at", F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("analyzed_at")))
        .withColumn(
            "status",
            F.when(hit & F.col("_r.degraded"), F.lit("retry")).when(hit, F.lit("analyzed")).otherwise(F.col("status")),
        )
        .drop("_r")
    )
