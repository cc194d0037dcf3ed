"""Incremental reader, source and provider state.

State is a table with one row per key and a version per micro-batch. A batch
is first summarised with the same aggregates as the batch operators, so a key
with most of the events is merged from partial results, then merged into the
previous version by an equi-join. Versions are overwritten on replay.

Events may arrive in any order. A summary says which stretch of its key's
events it covers; an event that comes late either adds to it, or lies before
what counts, or would split it. Keys with a split summary are computed anew
from the log of earlier batches, of which only their parts are read. So every
order of arrival ends in the state of one pass over the sorted events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from storyweave.functions import vectors
from storyweave.operators.health import provider_days, provider_minutes
from storyweave.operators.reader import POSITIVE, signal_weight
from storyweave.session import cut_lineage
from storyweave.streaming.ingest import _exists

Fold = Callable[[DataFrame, DataFrame], DataFrame]
Merge = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]

READER_STATE = T.StructType([
    T.StructField("reader_id", T.LongType()), T.StructField("model_id", T.StringType()),
    T.StructField("first_seq", T.LongType()), T.StructField("last_seq", T.LongType()), T.StructField("reset_at", T.LongType()),
    T.StructField("positive_sum", T.ArrayType(T.DoubleType())), T.StructField("positive_weight", T.DoubleType()),
    T.StructField("negative_sum", T.ArrayType(T.DoubleType())), T.StructField("negative_weight", T.DoubleType()),
])

_RUN = T.StructType([T.StructField("run_ts", T.TimestampType()), T.StructField("run_id", T.LongType())])

SOURCE_STATE = T.StructType([
    T.StructField("source_id", T.StringType()), T.StructField("consecutive_failures", T.LongType()),
    T.StructField("last_run_at", T.TimestampType()), T.StructField("last_error", T.StringType()),
    T.StructField("last_ok", _RUN), T.StructField("last_at", _RUN),
])

_ATTEMPT = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("attempt_id", T.LongType())])

PROVIDER_STATE = T.StructType([
    T.StructField("provider", T.StringType()), T.StructField("minute", T.TimestampType()),
    *[T.StructField(c, T.LongType()) for c in ("requests", "successes", "failures")], T.StructField("payment", T.BooleanType()),
    T.StructField("first_at", _ATTEMPT), T.StructField("last_at", _ATTEMPT),
    *[T.StructField(c, T.LongType()) for c in ("breaks", "longest", "head", "tail")],
])

PARTS = 64


def _version(folder: str, batch_id: int) -> str:
    return f"{folder}/version={batch_id}"


def latest_state(spark: SparkSession, folder: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Newest version of a state table, or of those before a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    versions = sorted(
        int(n[8:]) for n in names if n.startswith("version=") and _exists(spark, f"{folder}/{n}/_SUCCESS")
    )
    usable = [v for v in versions if before is None or v < before]
    if not usable:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_version(folder, usable[-1]))


def by_key(key: str) -> Column:
    """Part of the log that holds a key's events."""
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("string")


def by_day(ts: str) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def state_stream(
    events: DataFrame, merge: Merge, schema: T.StructType, part: Column, folder: str, checkpoint: str
) -> StreamingQuery:
    """Fold a stream of events into a state. Events are logged by batch and
    ``part``, in which ``merge`` finds those of a key again."""
    logged = T.StructType([*events.schema.fields, T.StructField("batch", T.LongType()), T.StructField("log_part", T.StringType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, log = batch.sparkSession, f"{folder}/log"
        batch.withColumn("log_part", part).hint("rebalance", "log_part").write.mode("overwrite").partitionBy("log_part").parquet(
            f"{log}/batch={batch_id}")
        kept = spark.read.option("basePath", log).schema(logged).parquet(log)
        own, earlier = (kept.where(c).drop("batch") for c in (F.col("batch") == batch_id, F.col("batch") < batch_id))
        merged = merge(latest_state(spark, folder, schema, batch_id), own, earlier)
        merged.write.mode("overwrite").parquet(_version(folder, batch_id))

    return (
        events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def with_history(fold: Fold, schema: T.StructType, keys: dict[str, Column], part: Column) -> Merge:
    """``fold(state, events)`` gives the new state and ``_split``, true where
    late events fall inside what the state has summed up. Those keys are folded
    anew over all their events; a batch without any reads no history."""
    def merge(state: DataFrame, batch: DataFrame, history: DataFrame) -> DataFrame:
        once = cut_lineage(fold(state, batch))
        split = once.where("_split").select(*keys, part.alias("log_part"))
        if split.isEmpty():
            return once.drop("_split")
        on = [*keys, "log_part"]
        events = history.unionByName(batch).withColumns(keys).join(split, on, "left_semi")
        return once.where(~F.col("_split")).unionByName(fold(state.limit(0), events)).select(schema.names)

    return merge


def _add(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))


def merge_reader_state(story_vectors: DataFrame) -> Merge:
    """Batch of signals (reader_id, seq, story_id, signal, model_id) into the
    running sums. The signal of the greatest seq names the model; what came
    before the last signal of another model doesn't count, whenever it arrives."""
    def fold(state: DataFrame, batch: DataFrame) -> DataFrame:
        vectored = batch.join(story_vectors.select("story_id", "vector"), "story_id")
        # the newest signal of each model in the batch, and of the state's, decide on model and reset
        known = state.select("reader_id", "model_id", F.col("last_seq").alias("seq"), "reset_at")
        newest = vectored.groupBy("reader_id", "model_id").agg(F.max("seq").alias("seq")).withColumn("reset_at", F.lit(None).cast("long"))
        marks = known.unionByName(newest).groupBy("reader_id").agg(
            F.max_by("model_id", "seq").alias("model"), F.max("reset_at").alias("_reset"),
            F.collect_list(F.struct("model_id", "seq")).alias("_models"),
        )
        others = F.filter("_models", lambda m: m["model_id"] != F.col("model"))
        marks = marks.select("reader_id", "model", F.greatest("_reset", F.array_max(F.transform(others, lambda m: m["seq"]))).alias("cut"))
        live = vectored.join(marks, "reader_id").where(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
        v = array_to_vector(F.col("vector").cast("array<double>"))
        sums = live.groupBy("reader_id", F.col("signal").isin(POSITIVE).alias("positive")).agg(
            vector_to_array(Summarizer.sum(v, signal_weight(F.col("signal")))).alias("s"),
            F.sum(signal_weight(F.col("signal"))).alias("w"), F.min("seq").alias("lo"), F.max("seq").alias("hi"),
        )
        fresh = sums.groupBy("reader_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[
            F.max(F.when(F.col("positive") == flag, F.col(c))).alias(name)
            for flag, side in ((True, "p"), (False, "n")) for c, name in (("s", side + "s"), ("w", side + "w"))
        ])
        both = marks.join(state, "reader_id", "left").join(fresh, "reader_id", "left")
        same = F.col("model") == F.col("model_id")
        keep = same & (F.col("cut").isNull() | (F.col("cut") < F.col("first_seq")))
        split = same & (F.col("cut") >= F.col("first_seq")) & (F.col("cut") < F.col("last_seq"))

        def old(name: str) -> Column:
            return F.when(keep, F.col(name))

        def total(name: str, new: str) -> Column:
            return (F.coalesce(old(name), F.lit(0.0)) + F.coalesce(new, F.lit(0.0))).alias(name)

        return both.select(
            "reader_id", F.col("model").alias("model_id"), F.least(old("first_seq"), "lo").alias("first_seq"),
            F.greatest(old("last_seq"), "hi").alias("last_seq"), F.col("cut").alias("reset_at"),
            _add(old("positive_sum"), F.col("ps")).alias("positive_sum"), total("positive_weight", "pw"),
            _add(old("negative_sum"), F.col("ns")).alias("negative_sum"), total("negative_weight", "nw"),
            F.coalesce(split, F.lit(False)).alias("_split"),
        )

    return with_history(fold, READER_STATE, {"reader_id": F.col("reader_id")}, by_key("reader_id"))


def reader_state_centroids(state: DataFrame) -> DataFrame:
    def side(name: str) -> Column:
        return F.when(F.col(f"{name}_weight") > 0, vectors.unit(F.col(f"{name}_sum"))).alias(f"{name}_centroid")

    return state.select("reader_id", side("positive"), side("negative"))


def _fold_runs(state: DataFrame, batch: DataFrame) -> DataFrame:
    at = F.struct("run_ts", "run_id")
    ok = batch.where("ok").groupBy("source_id").agg(F.max(at).alias("_new_ok"))
    seen = state.select("source_id", "last_ok").join(ok, "source_id", "full_outer").select(
        "source_id", "_new_ok", F.greatest("last_ok", "_new_ok").alias("_ok"))
    fresh = batch.join(seen, "source_id", "left").groupBy("source_id").agg(
        F.count_if(~F.col("ok") & (F.col("_ok").isNull() | (at > F.col("_ok")))).alias("_failed"),
        F.max("_new_ok").alias("_new_ok"), F.max_by("error", at).alias("_error"), F.max(at).alias("_last"),
    )
    held = F.coalesce("consecutive_failures", F.lit(0))
    newer = F.col("_new_ok").isNotNull() & (F.col("last_ok").isNull() | (F.col("_new_ok") > F.col("last_ok")))
    ahead = F.col("last_at").isNotNull() & (F.col("_last").isNull() | (F.col("last_at") > F.col("_last")))
    done = F.greatest("last_ok", "_new_ok")
    return state.join(fresh, "source_id", "full_outer").select(
        "source_id", (F.coalesce("_failed", F.lit(0)) + F.when(newer, F.lit(0)).otherwise(held)).alias("consecutive_failures"),
        done["run_ts"].alias("last_run_at"), F.when(ahead, F.col("last_error")).otherwise(F.col("_error")).alias("last_error"),
        done.alias("last_ok"), F.greatest("last_at", "_last").alias("last_at"),
        F.coalesce(newer & (held > 0) & (F.col("_new_ok") < F.col("last_at")), F.lit(False)).alias("_split"),
    )


def merge_source_state(state: DataFrame, batch: DataFrame, history: DataFrame) -> DataFrame:
    """Batch of runs (run_id, source_id, run_ts, ok, error) into the failure
    counters; a success that arrives late ends the failures before it only."""
    return with_history(_fold_runs, SOURCE_STATE, {"source_id": F.col("source_id")}, by_key("source_id"))(state, batch, history)


def _fold_attempts(state: DataFrame, batch: DataFrame) -> DataFrame:
    """A minute's attempts before or after those of the state are put together
    with them; only those between them split a minute."""
    keys, rest = PROVIDER_STATE.names[:2], PROVIDER_STATE.names[2:]
    old, new = (frame.select(*keys, F.struct(*rest).alias(name)) for frame, name in ((state, "o"), (provider_minutes(batch), "n")))
    both = old.join(new, keys, "full_outer")
    first = F.col("o").isNotNull() & (F.col("n").isNull() | (F.col("o.first_at") < F.col("n.first_at")))
    both = both.select(
        "provider", "minute", F.when(first, F.col("o")).otherwise(F.col("n")).alias("a"),
        F.when(first, F.col("n")).otherwise(F.col("o")).alias("b"))

    def count(c: str) -> Column:
        return F.coalesce(F.col(f"b.{c}"), F.lit(0))

    return both.select(
        "provider", "minute", *[(F.col(f"a.{c}") + count(c)).alias(c) for c in ("requests", "successes", "failures")],
        (F.col("a.payment") | F.coalesce("b.payment", F.lit(False))).alias("payment"),
        F.col("a.first_at").alias("first_at"), F.greatest("a.last_at", "b.last_at").alias("last_at"),
        (F.col("a.breaks") + count("breaks")).alias("breaks"),
        F.greatest("a.longest", count("longest"), F.col("a.tail") + count("head")).alias("longest"),
        (F.col("a.head") + F.when(F.col("a.breaks") == 0, count("head")).otherwise(0)).alias("head"),
        (count("tail") + F.when(count("breaks") == 0, F.col("a.tail")).otherwise(0)).alias("tail"),
        F.coalesce(F.col("a.last_at") > F.col("b.first_at"), F.lit(False)).alias("_split"),
    )


def merge_provider_state(state: DataFrame, batch: DataFrame, history: DataFrame) -> DataFrame:
    """Batch of attempts (attempt_id, provider, ts, status) into the minutes."""
    keys = {"provider": F.col("provider"), "minute": F.date_trunc("minute", "ts")}
    return with_history(_fold_attempts, PROVIDER_STATE, keys, by_day("minute"))(state, batch, history)


def provider_status(state: DataFrame, disable_after: int = 3) -> DataFrame:
    """Counters, streak of 429s and ``disabled`` per provider and day."""
    return provider_days(state, disable_after)
