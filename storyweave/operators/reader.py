"""Per-reader state and feeds, for all readers in one job."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from storyweave.functions import labels, vectors
from storyweave.operators import personal
from storyweave.operators.catalogue import TERRITORIES
from storyweave.operators.ordering import ordinal_within
from storyweave.operators.personal import FIT_WEIGHT, LOW_FIT, RESERVED_FRACTION
from storyweave.session import cut_lineage, shuffle_partitions

# Weight of each signal.
SIGNAL_WEIGHTS = {"open": 1.0, "save": 2.5, "dismiss": 1.0}
POSITIVE = ["open", "save"]


def signal_weight(signal: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, weight in SIGNAL_WEIGHTS.items():
        out = F.when(signal == name, F.lit(weight)).otherwise(out)
    return out


def current_signals(signals: DataFrame) -> DataFrame:
    """Signals after each reader's last change of model: vectors of different
    models do not add up. Aggregates only, so a very active reader is merged
    from partial results."""
    latest = signals.groupBy("reader_id").agg(F.max_by("model_id", "seq").alias("current_model"))
    tagged = signals.join(latest, "reader_id")
    reset = tagged.groupBy("reader_id").agg(
        F.max(F.when(F.col("model_id") != F.col("current_model"), F.col("seq"))).alias("reset_at")
    )
    return tagged.join(reset, "reader_id").where(
        F.col("reset_at").isNull() | (F.col("seq") > F.col("reset_at"))
    ).drop("reset_at", "current_model")


def signal_sums(signals: DataFrame, story_vectors: DataFrame) -> DataFrame:
    """(reader_id, positive, vector_sum, weight): weighted sums per reader and
    polarity. Signals on stories without a vector count for nothing."""
    weighted = signals.join(story_vectors.select("story_id", "vector"), "story_id").select(
        "reader_id", F.col("signal").isin(POSITIVE).alias("positive"),
        array_to_vector(F.col("vector").cast("array<double>")).alias("v"), signal_weight(F.col("signal")).alias("w"),
    )
    return weighted.groupBy("reader_id", "positive").agg(
        Summarizer.sum(F.col("v"), F.col("w")).alias("s"), F.sum("w").alias("weight")
    ).select("reader_id", "positive", vector_to_array("s").alias("vector_sum"), "weight")


def centroids_from_sums(sums: DataFrame) -> DataFrame:
    """(reader_id, positive_centroid, negative_centroid), unit length or NULL."""
    def pick(flag: bool) -> Column:
        return F.max(F.when((F.col("positive") == flag) & (F.col("weight") > 0), vectors.unit(F.col("vector_sum"))))

    return sums.groupBy("reader_id").agg(
        pick(True).alias("positive_centroid"), pick(False).alias("negative_centroid")
    )


def reader_centroids(signals: DataFrame, story_vectors: DataFrame) -> DataFrame:
    # a signal is only recorded for a story that has a vector
    recorded = signals.join(story_vectors.select("story_id"), "story_id", "left_semi")
    return centroids_from_sums(signal_sums(current_signals(recorded), story_vectors))


def source_filter(source_ids: Column, selected: Column) -> Column:
    """No selection shows everything; else any shared source is enough."""
    return selected.isNull() | (F.size(selected) == 0) | F.arrays_overlap(source_ids, selected)


def reader_feed_rows(requests: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards each reader may see: ``requests`` (reader_id, bundle_id,
    selected) meet the cards of the bundle they hold. Most readers hold the
    same bundle, so readers are spread by a salt and each salt gets its own
    copy of the cards."""
    salts = shuffle_partitions(cards.sparkSession)
    # few bytes of either side become many rows of feed: a fixed number of
    # partitions keeps the runtime from doing all of it in one task
    spread = requests.withColumn("_salt", F.pmod(F.xxhash64("reader_id"), F.lit(salts))).repartition(salts, "_salt")
    copies = cards.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    copies = copies.repartition(salts, "_salt")
    return spread.join(copies, ["bundle_id", "_salt"]).where(
        source_filter(F.col("source_ids"), F.col("selected"))
    ).drop("selected", "_salt")


def _bunched(rows: DataFrame, keys: list[str], by: str, most: int) -> DataFrame:
    """Add ``_bunch``, which cuts the rows of each of ``keys`` into bunches of about ``most``."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("_n"))
    return rows.join(sizes, keys).withColumn("_bunch", F.pmod(F.xxhash64(by), F.col("_n"))).drop("_n")


def eligible_rows(requests: DataFrame, cards: DataFrame, block_rows: int = 1024, readers: int = 512) -> DataFrame:
    """(reader_id, bundle_id, story_id) of the cards each reader may see, as in
    ``reader_feed_rows``."""
    return _served(requests, _hashed_blocks(cards, block_rows), readers).select("reader_id", "bundle_id", F.explode("ids").alias("story_id"))


def visible_rows(
    requests: DataFrame, cards: DataFrame, read: DataFrame, dismissed: DataFrame, block_rows: int = 4096, readers: int = 512
) -> DataFrame:
    """``eligible_rows`` without what a reader has read or dismissed."""
    blocks = _hashed_blocks(cards, block_rows)
    hidden = _hidden(requests, blocks, read, dismissed)
    return _served(requests, blocks, readers, hidden).select("reader_id", "bundle_id", F.explode("ids").alias("story_id"))


def _hashed_blocks(cards: DataFrame, block_rows: int) -> DataFrame:
    """(bundle_id, block, cards): the cards of a bundle in arrays of about ``block_rows``."""
    slim = _bunched(cards.select("bundle_id", "story_id", "source_ids"), ["bundle_id"], "story_id", block_rows)
    return cut_lineage(slim.groupBy("bundle_id", F.col("_bunch").cast("int").alias("block")).agg(
        F.collect_list(F.struct("story_id", "source_ids")).alias("cards")))


def _served(requests: DataFrame, blocks: DataFrame, readers: int, hidden: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """(reader_id, bundle_id, ids): what each reader sees of each block of their
    bundle, but for ``hidden`` (as of ``_hidden``), and, if ``counted``, ``at``, the cards they see of earlier blocks.

    Readers of one selection meet the blocks together, so that a block is filtered
    once for up to ``readers`` of them, and what they see leaves the task that makes it."""
    none = F.array().cast("array<string>")
    wanted = requests.select("reader_id", "bundle_id", F.array_sort(F.array_distinct(F.coalesce("selected", none))).alias("selected"))
    if hidden is None:
        wanted = wanted.withColumns({"hidden": F.lit(None).cast("array<long>"), "gone": F.lit(None).cast("array<int>")})
    else:
        own = hidden.groupBy("reader_id", "bundle_id").agg(F.collect_list("story_id").alias("hidden"), F.collect_list("block").alias("gone"))
        wanted = wanted.join(own, ["reader_id", "bundle_id"], "left")
    together = ["bundle_id", "selected", "_bunch"]
    asking = _bunched(wanted, together[:2], "reader_id", readers).groupBy(*together).agg(
        F.collect_list(F.struct("reader_id", "hidden", "gone")).alias("readers"))
    if counted:
        rows = asking.join(_selected_counts(wanted, blocks), together[:2])
    else:
        listed = blocks.groupBy("bundle_id").agg(F.collect_list("block").alias("block"))
        rows = asking.join(listed, "bundle_id").withColumn("block", F.explode("block")).withColumn("before", F.lit(0).cast("long"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("selected", "_bunch"), F.lit(_copies(blocks))).cast("int"))
    # a step of its own, so that the filter runs before there is a row for each reader
    met = _meet_cards(rows, blocks).select("bundle_id", "block", "before", "readers", _seen()["story_id"].alias("ids"))
    met = met.select("bundle_id", "block", "before", "ids", F.explode("readers").alias("r"))
    ids, here = F.col("ids"), F.array_contains("r.gone", F.col("block"))
    return met.select("r.reader_id", "bundle_id", F.when(here, F.array_except(ids, "r.hidden")).otherwise(ids).alias("ids"), *([
        (F.col("before") - F.coalesce(F.size(F.filter("r.gone", lambda g: g < F.col("block"))), F.lit(0))).alias("at")] if counted else []))


def _seen() -> Column:
    """The cards of a block that a selection shows."""
    return F.filter("cards", lambda c: source_filter(c["source_ids"], F.col("selected")))


def _selected_counts(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """(bundle_id, selected, block, before): how many cards each selection shows of earlier blocks."""
    listed = blocks.groupBy("bundle_id").agg(F.collect_list("block").alias("block"))
    rows = wanted.select("bundle_id", "selected").distinct().join(listed, "bundle_id").withColumn("block", F.explode("block")).withColumn(
        "_salt", F.pmod(F.xxhash64("selected"), F.lit(_copies(blocks))).cast("int"))
    counts = _meet_cards(rows, blocks).select("bundle_id", "selected", "block", F.size(_seen()).cast("long").alias("n"))
    earlier = Window.partitionBy("bundle_id", "selected").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(counts.select("bundle_id", "selected", "block", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))


def _hidden(requests: DataFrame, blocks: DataFrame, read: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(reader_id, bundle_id, story_id, block, place, dismissed) of the cards that a
    reader's selection shows and that they have read or dismissed."""
    pairs = read.select("reader_id", "story_id", F.lit(False).alias("dismissed")).unionByName(
        dismissed.select("reader_id", "story_id", F.lit(True).alias("dismissed"))
    ).groupBy("reader_id", "story_id").agg(F.bool_or("dismissed").alias("dismissed"))
    placed = blocks.select("bundle_id", "block", F.posexplode("cards").alias("place", "c")).select(
        "bundle_id", "block", "place", "c.story_id", "c.source_ids")
    return pairs.join(requests.select("reader_id", "bundle_id", "selected"), "reader_id").join(placed, ["bundle_id", "story_id"]).where(
        source_filter(F.col("source_ids"), F.col("selected"))).drop("source_ids", "selected")


def _keys(mode: str) -> list[Column]:
    """Literal order of the cards; ties keep feed order. What is read goes last in `unread`, which is up to the reader."""
    return {
        "importance": [F.asc("feed_pos")],
        "recency": [F.desc("updated_at"), F.asc("feed_pos")],
        "outlets": [F.desc("outlet_count"), F.desc("updated_at"), F.asc("feed_pos")],
        "unread": [F.desc("updated_at"), F.asc("feed_pos")],
    }[mode]


def card_blocks(cards: DataFrame, mode: str, block_rows: int) -> DataFrame:
    """(bundle_id, block, cards): the cards of a bundle in order, an array of ``block_rows`` a row."""
    placed = ordinal_within(cards, "bundle_id", *_keys(mode), out="_place")
    card = F.struct("story_id", "source_ids")
    blocks = placed.groupBy("bundle_id", F.floor((F.col("_place") - 1) / block_rows).cast("int").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("_place", card.alias("card")))).alias("c"))
    return cut_lineage(blocks.select("bundle_id", "block", F.col("c.card").alias("cards")))


def _copies(blocks: DataFrame) -> int:
    """Copies of each block, so that there are more of them than partitions."""
    return -(-4 * shuffle_partitions(blocks.sparkSession) // max(1, blocks.count()))


def _meet_cards(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Join readers' blocks to their cards. A fixed number of partitions, kept by the hint: few bytes become many rows."""
    parts, on = shuffle_partitions(blocks.sparkSession), ["bundle_id", "block", "_salt"]
    copies = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_copies(blocks) - 1))))
    # a bundle that is one literal is no key of the join, and would have both sides dealt anew
    return rows.repartition(parts, *on[1:]).hint("merge").join(copies.repartition(parts, *on[1:]), on)


def ordered_feed(
    requests: DataFrame, cards: DataFrame, read: DataFrame, dismissed: DataFrame, mode: str, block_rows: int = 4096, readers: int = 512
) -> DataFrame:
    """(reader_id, bundle_id, story_id, position): each reader's visible cards in a
    literal order; `unread` adds is_read, and what is read comes last. All readers
    share the order of the cards, so a place is that in the selection less the cards
    before it that the reader hides, and no row is counted. A reader holds one bundle."""
    blocks = card_blocks(cards, mode, block_rows)
    hidden = _hidden(requests, blocks, read, dismissed)
    if mode == "unread":
        hidden = cut_lineage(hidden)
    shown = _served(requests, blocks, readers, hidden, counted=True).select(
        "reader_id", "bundle_id", "at", F.posexplode("ids").alias("_k", "story_id"))
    position = (F.col("at") + F.col("_k") + 1).cast("long").alias("position")
    if mode != "unread":
        return shown.select("reader_id", "bundle_id", "story_id", position)
    return shown.select("reader_id", "bundle_id", "story_id", F.lit(False).alias("is_read"), position).unionByName(
        _read_last(requests, blocks, hidden))


def _read_last(requests: DataFrame, blocks: DataFrame, hidden: DataFrame) -> DataFrame:
    """The rows of what readers have read and not dismissed, after all others."""
    none = F.array().cast("array<string>")
    wanted = requests.select("reader_id", "bundle_id", F.array_sort(F.array_distinct(F.coalesce("selected", none))).alias("selected"))
    totals = _selected_counts(wanted, blocks).groupBy("bundle_id", "selected").agg(F.sum("n").alias("n"))
    own = hidden.groupBy("reader_id", "bundle_id").agg(F.count("*").alias("less"))
    main = wanted.join(totals, ["bundle_id", "selected"]).join(own, ["reader_id", "bundle_id"]).select("reader_id", "bundle_id", (F.col("n") - F.col("less")).alias("main"))
    rank = F.row_number().over(Window.partitionBy("reader_id", "bundle_id").orderBy("block", "place"))
    return hidden.where(~F.col("dismissed")).withColumn("_rank", rank).join(main, ["reader_id", "bundle_id"]).select(
        "reader_id", "bundle_id", "story_id", F.lit(True).alias("is_read"), (F.col("main") + F.col("_rank")).cast("long").alias("position"))


def reader_tastes(centroids: DataFrame, missing: float = 0.0) -> DataFrame:
    """(reader_id, taste, lack): the direction whose product with a unit vector is the
    fit, and what the centroids that a reader lacks add to it."""
    lacks = [F.when(F.col(c).isNull(), F.lit(float(missing))).otherwise(0.0) for c in ("positive_centroid", "negative_centroid")]
    return centroids.select(
        "reader_id", vectors.taste_direction(F.col("positive_centroid"), F.col("negative_centroid")).cast("array<double>").alias("taste"),
        (lacks[0] - lacks[1]).alias("lack"))


def personal_rows(
    requests: DataFrame, cards: DataFrame, read: DataFrame, dismissed: DataFrame, centroids: DataFrame, story_vectors: DataFrame, *,
    columns: list[str] | None = None, shown: int | None = None, fit_digits: int | None = None, missing: float = 0.0, readers: int = 2048,
) -> DataFrame:
    """The visible cards of each reader with their fit, cos(story, positive) -
    cos(story, negative), and, where ``columns`` asks for it, their place as of
    ``rerank``. A missing story vector is neutral; a missing centroid counts as
    the cosine ``missing``, neutral by default.

    A feed row is never moved: a bunch of at most about ``readers`` readers gets
    a copy of the cards of its bundle, and rows leave the task that makes them.
    So that all cores have some, there are more bunches than cores."""
    columns = columns or list(personal.KINDS)
    spark = cards.sparkSession
    hidden = read.select("reader_id", "story_id").unionByName(dismissed.select("reader_id", "story_id")).groupBy("reader_id").agg(
        F.collect_set("story_id").alias("hidden"))
    asking = requests.join(reader_tastes(centroids, missing), "reader_id", "left").join(hidden, "reader_id", "left")
    bunches = max(4 * spark.sparkContext.defaultParallelism, -(-requests.count() // readers))
    reader = F.struct("reader_id", "selected", "taste", "lack", "hidden")
    card = F.struct("story_id", "score", F.col("feed_pos").cast("long").alias("feed_pos"), "source_ids", "vector")
    left = asking.select("bundle_id", F.pmod(F.xxhash64("reader_id"), F.lit(bunches)).cast("int").alias("_bunch"), reader.alias("reader"))
    right = cards.join(story_vectors.select("story_id", "vector"), "story_id", "left").select(
        "bundle_id", F.explode(F.sequence(F.lit(0), F.lit(bunches - 1))).alias("_bunch"), card.alias("card"))
    # a fixed number of partitions: few bytes become many rows
    both = left.unionByName(right, allowMissingColumns=True).repartition(bunches, "_bunch")
    kinds = ", ".join(f"{c} {from_arrow_type(personal.KINDS[c]).simpleString()}" for c in columns)
    return both.groupBy("bundle_id", "_bunch").applyInArrow(personal.feed_rows(columns, shown, fit_digits), kinds)


def min_max(value: str, group: str = "reader_id") -> Column:
    """Scaled to [0, 1] within the group; a constant column becomes 0.5."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(low == high, F.lit(0.5)).otherwise((F.col(value) - low) / F.nullif(high - low, F.lit(0.0)))


def rerank(rows: DataFrame, fit_digits: int | None = None) -> DataFrame:
    """Personal order of each reader's visible cards (reader_id, story_id,
    score, fit, feed_pos): importance and fit blended, with 15% of the places
    kept for important stories of low fit, spread evenly. Adds combined,
    reserved and position."""
    reader = Window.partitionBy("reader_id")
    fit = F.round("fit", fit_digits) if fit_digits is not None else F.col("fit")
    scaled = (
        rows.withColumn("fit", fit)
        .withColumn("norm_fit", min_max("fit")).withColumn("norm_importance", min_max("score"))
        .withColumn("combined", (1 - FIT_WEIGHT) * F.col("norm_importance") + FIT_WEIGHT * F.col("norm_fit"))
        .withColumn("_low", F.col("norm_fit") <= LOW_FIT)
        .withColumn("_total", F.count("*").over(reader))
        .withColumn("_pool", F.count_if("_low").over(reader))
    )
    reserve = labels.round_half_up(F.col("_total") * RESERVED_FRACTION)
    by_importance = reader.orderBy(F.desc("norm_importance"), "feed_pos")
    pooled = (
        scaled.withColumn("_reserve", reserve)
        .withColumn("_eligible", F.col("_low") | (F.col("_pool") < F.col("_reserve")))
        .withColumn("_seen", F.count_if("_eligible").over(by_importance.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("reserved", F.col("_eligible") & (F.col("_seen") <= F.col("_reserve")))
    )
    block = Window.partitionBy("reader_id", "reserved")
    ordered = (
        pooled.withColumn("_taken", F.count_if("reserved").over(reader))
        .withColumn("_rank", F.row_number().over(block.orderBy(
            F.when(F.col("reserved"), F.col("norm_importance")).otherwise(F.col("combined")).desc(),
            F.when(F.col("reserved"), F.col("norm_importance")).desc(), "feed_pos",
        )))
    )
    main = F.col("_total") - F.col("_taken")
    return ordered.withColumn(
        "position", interleave_position(F.col("reserved"), F.col("_rank"), main, F.col("_taken")).cast("long")
    ).drop("_low", "_total", "_pool", "_reserve", "_eligible", "_seen", "_taken", "_rank")


def interleave_position(reserved: Column, rank: Column, main: Column, taken: Column) -> Column:
    """Place of the rank-th main or reserved card when ``taken`` reserved
    cards are spread through ``main`` others."""
    step = F.greatest(F.lit(1), F.floor(main / (taken + 1)))
    return F.when(reserved, F.least(rank * (step + 1), main + rank)).otherwise(
        rank + F.least(taken, F.floor((rank - 1) / step))
    )


def reader_feed(
    requests: DataFrame, cards: DataFrame, read: DataFrame, dismissed: DataFrame, *, mode: str = "importance",
    personalise: bool = True, centroids: DataFrame | None = None, story_vectors: DataFrame | None = None,
    shown: int | None = None, fit_digits: int | None = None, missing: float = 0.0, columns: list[str] | None = None,
) -> DataFrame:
    """The whole client query: source filter first, then visibility, then the
    order. ``shown`` keeps the first places only, as on screen, ``columns``
    names what a personal row holds."""
    if mode == "importance" and personalise:
        return personal_rows(requests, cards, read, dismissed, centroids, story_vectors, columns=columns, shown=shown,
                             fit_digits=fit_digits, missing=missing)
    ranked = ordered_feed(requests, cards, read, dismissed, mode)
    return ranked.where(F.col("position") <= shown) if shown is not None else ranked


def id_list(signals: DataFrame, signal: str) -> DataFrame:
    """(reader_id, story_id, position), most recent first. Adding an id again
    keeps its first place."""
    first = signals.where(F.col("signal") == signal).groupBy("reader_id", "story_id").agg(F.min("seq").alias("added"))
    order = Window.partitionBy("reader_id").orderBy(F.desc("added"))
    return first.withColumn("position", F.row_number().over(order).cast("long"))


def saved_with_fallback(saved: DataFrame, cards: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Saved list with the card from the bundle, else the copy kept at save
    time, else NULL (placeholder). ``cards`` (story_id, card), ``snapshots``
    (reader_id, story_id, card)."""
    return (
        saved.join(cards.select("story_id", F.col("card").alias("_live")), "story_id", "left")
        .join(snapshots.select("reader_id", "story_id", F.col("card").alias("_kept")), ["reader_id", "story_id"], "left")
        .withColumn("card", F.coalesce("_live", "_kept"))
        .withColumn(
            "origin",
            F.when(F.col("_live").isNotNull(), F.lit("bundle")).when(F.col("_kept").isNotNull(), F.lit("snapshot"))
            .otherwise(F.lit("placeholder")),
        )
        .drop("_live", "_kept")
    )


def snapshot_refresh(saved: DataFrame, cards: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Copies to rewrite: saved stories the bundle still carries, changed
    since they were copied."""
    kept = snapshots.select("reader_id", "story_id", F.col("card").alias("_kept"))
    return (
        saved.select("reader_id", "story_id").join(cards.select("story_id", "card"), "story_id")
        .join(kept, ["reader_id", "story_id"], "left")
        .where(~F.col("card").eqNullSafe(F.col("_kept")))
        .select("reader_id", "story_id", "card")
    )


def story_territories(cards: DataFrame, sources: DataFrame) -> DataFrame:
    """(story_id, source_id, territory) through the story's sources."""
    return (
        cards.select("story_id", F.explode("source_ids").alias("source_id"))
        .join(sources.select("source_id", F.coalesce("territory", F.lit("other")).alias("territory")), "source_id")
    )


def stories_per_source(cards: DataFrame, sources: DataFrame) -> DataFrame:
    counts = cards.select(F.explode("source_ids").alias("source_id")).groupBy("source_id").agg(F.count("*").alias("n"))
    return sources.select("source_id").join(counts, "source_id", "left").select(
        "source_id", F.coalesce("n", F.lit(0)).alias("stories")
    )


def stories_per_territory(cards: DataFrame, sources: DataFrame) -> DataFrame:
    touched = story_territories(cards, sources).select("story_id", "territory").distinct()
    counts = touched.groupBy("territory").agg(F.count("*").alias("n"))
    return sources.select(F.coalesce("territory", F.lit("other")).alias("territory")).distinct().join(
        counts, "territory", "left"
    ).select("territory", F.coalesce("n", F.lit(0)).alias("stories"))


def territory_order(sources: DataFrame) -> DataFrame:
    """Sources in display order: the fixed territories, then others by name,
    ids inside."""
    territory = F.coalesce("territory", F.lit("other"))
    at = F.array_position(F.array(*[F.lit(t) for t in TERRITORIES]), territory)
    place = F.when(at == 0, F.lit(len(TERRITORIES) + 1)).otherwise(at).cast("int")
    return sources.select("source_id", territory.alias("territory"), place.alias("place")).orderBy(
        "place", "territory", "source_id"
    )


def story_lookup(cards: DataFrame, details: DataFrame, wanted: DataFrame) -> DataFrame:
    """Details of the requested stories, a row for every part of a story's
    document; ``found`` is false for ids without a card. ``wanted``
    (reader_id, story_id), ``details`` (id, part, part_count, path, payload)."""
    carded = details.join(cards.select("story_id"), details["id"] == cards["story_id"], "left_semi")
    parts = carded.select(F.col("id").alias("story_id"), "part", "part_count", F.col("path").alias("detail_path"), "payload")
    return wanted.join(parts, "story_id", "left").withColumn("found", F.col("payload").isNotNull())


def open_signals(lookups: DataFrame) -> DataFrame:
    """Opening a story marks it read and counts as an 'open' signal."""
    return lookups.where("found").select("reader_id", "story_id").distinct().select(
        "reader_id", "story_id", F.explode(F.array(F.lit("read"), F.lit("open"))).alias("signal")
    )
