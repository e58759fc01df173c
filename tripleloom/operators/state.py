"""Channel state as a fold over an append-only log of events.

Log columns: channel_id, seq (unique per channel), action, is_stopped, monitor_in_enabled,
monitor_out_enabled, error_enabled, error. Actions: add, update, restart, completed, failed, remove.
A null field means no change. The empty error text means "cleared".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# --- fixed values: report texts of a status update -------------------------------------------------
NO_CHANNEL = "No channel with ID: "
EMPTY_STATUS = "ChannelStatus object was empty, so no updates were made."
NO_UPDATES = "No updates were made to channel status for channel with ID: "
UPDATED = "Updated settings for channel with ID: "
UPDATED_AND_STOPPED = "Updated settings and stopped channel with ID: "
UPDATED_AND_STARTED = "Updated settings and started channel with ID: "
# ----------------------------------------------------------------------------------------------

FLAGS = ("is_stopped", "monitor_in_enabled", "monitor_out_enabled", "error_enabled")
TOPIC_FLAGS = FLAGS[1:]
DEFAULT_FLAGS = {"is_stopped": False, "monitor_in_enabled": True, "monitor_out_enabled": True, "error_enabled": True}


def effects(events: DataFrame) -> DataFrame:
    """What each event sets: flags, `present` (does the channel exist after it) and error text."""
    action = F.col("action")
    set_flags = {}
    for name in FLAGS:
        given = F.when(action.isin("add", "update"), F.col(name))
        value = F.when(action == "add", F.coalesce(given, F.lit(DEFAULT_FLAGS[name]))).otherwise(given)
        if name == "is_stopped":
            value = F.when(action == "restart", F.lit(False)).when(action.isin("completed", "failed"), F.lit(True)).otherwise(value)
        set_flags[name] = value
    starts = (action == "restart") | ((action == "update") & ~F.col("is_stopped"))
    error = F.when((action == "add") | starts, F.lit("")).when(action == "failed", F.coalesce("error", F.lit("unknown")))
    present = F.when(action == "add", F.lit(True)).when(action == "remove", F.lit(False))
    return events.withColumns({**set_flags, "error": error, "present": present})


def _latest(value: Column, seq: Column) -> Column:
    """Last value that is not null, in log order."""
    return F.max_by(value, F.when(value.isNotNull(), seq))


def current_state(events: DataFrame) -> DataFrame:
    """One row per existing channel: flags and error after all its events.

    Folded with map-side partial aggregates over fixed-width fields, so a channel that owns a third of
    the log costs no more than any other; no window sorts a whole channel in one task. Error texts do
    not enter the aggregate: only the place of the last one does, and that text is looked up.
    """
    log = effects(events)
    seq = F.col("seq")
    folded = log.groupBy("channel_id").agg(
        *[_latest(F.col(name), seq).alias(name) for name in FLAGS],
        _latest(F.col("present"), seq).alias("present"),
        F.max(F.when(F.col("error").isNotNull(), seq)).alias("error_seq"),
        F.max(seq).alias("last_seq"),
    )
    texts = log.where("error != ''").select("channel_id", F.col("seq").alias("error_seq"), "error")
    return folded.where("present").join(texts, ["channel_id", "error_seq"], "left").select("channel_id", *FLAGS, "error", "last_seq")


def follow(
    log_stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, snapshot_every: int = 100, query_name: str | None = None
) -> StreamingQuery:
    """Start a streaming query that keeps the state of all channels up to date with a growing log.

    What each field was last set to, and where in the log, is kept in Spark's state store, so a run reads new events only, and
    events that come late or in any order don't matter. Each micro-batch writes the channels that it changed into a folder of its own, which a
    repeated batch overwrites; every `snapshot_every` batches the whole state is written once, so a reader has few folders to read.
    """
    log, seq = effects(log_stream), F.col("seq")
    folded = log.groupBy("channel_id").agg(
        *[_latest(F.col(name), seq).alias(name) for name in (*FLAGS, "present", "error")], F.max(seq).alias("last_seq")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/kind=delta/batch_id={batch_id}")
        if batch_id % snapshot_every == snapshot_every - 1:
            _followed(spark, path).write.mode("overwrite").parquet(f"{path}/kind=snapshot/batch_id={batch_id}")

    writer = folded.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


_FOLLOWED = f"channel_id string, {', '.join(f'{f} boolean' for f in FLAGS)}, present boolean, error string, last_seq bigint"


def _followed(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every channel: of the last snapshot and the batches after it."""
    rows = spark.read.schema(f"{_FOLLOWED}, kind string, batch_id bigint").parquet(path)
    newest = rows.where("kind = 'snapshot'").agg(F.max("batch_id")).first()[0]
    since = -1 if newest is None else newest
    kept = rows.where(((F.col("kind") == "delta") & (F.col("batch_id") > since)) | ((F.col("kind") == "snapshot") & (F.col("batch_id") == since)))
    columns = [c.strip().split(" ")[0] for c in _FOLLOWED.split(",")][1:]
    # a snapshot's batch comes before those that follow it, so one number orders them all
    last = kept.groupBy("channel_id").agg(*[F.max_by(F.struct(c), "batch_id")[c].alias(c) for c in columns])
    return last


def followed_state(spark: SparkSession, path: str) -> DataFrame:
    """What current_state() gives for the whole log, out of what follow() has written."""
    rows = _followed(spark, path).where("present")
    return rows.select("channel_id", *FLAGS, F.nullif("error", F.lit("")).alias("error"), "last_seq")


# Stretches of one channel that are looked at together.
STRETCHES = 1 << 14


def last_before(log: DataFrame, columns: list[str], span: int, stretches: int = STRETCHES) -> DataFrame:
    """Add `before_<column>`: the last value that is not null among a channel's earlier events.

    The log is cut into stretches of `span` sequence numbers. A window runs inside one stretch of one
    channel, and what enters a stretch is carried over from one summary row per stretch; those rows are cut into longer
    stretches in the same way. So one task sorts `span` or `stretches` rows of a channel at most, and one row for every
    span * stretches sequence numbers, not the busiest channel's log.
    """
    log = log.withColumn("_stretch", F.floor(F.col("seq") / F.lit(span)))
    inside = Window.partitionBy("channel_id", "_stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    near = log.withColumns({f"_near_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns})
    summary = log.groupBy("channel_id", "_stretch").agg(*[_latest(F.col(c), F.col("seq")).alias(c) for c in columns])
    summary = summary.withColumn("_long", F.floor(F.col("_stretch") / F.lit(stretches)))
    whole = summary.groupBy("channel_id", "_long").agg(*[_latest(F.col(c), F.col("_stretch")).alias(c) for c in columns])
    among = Window.partitionBy("channel_id", "_long").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("channel_id").orderBy("_long").rowsBetween(Window.unboundedPreceding, -1)
    mid = summary.select("channel_id", "_stretch", "_long", *[F.last(c, ignorenulls=True).over(among).alias(f"_mid_{c}") for c in columns])
    far = whole.select("channel_id", "_long", *[F.last(c, ignorenulls=True).over(over).alias(f"_far_{c}") for c in columns])
    carried = mid.join(far, ["channel_id", "_long"]).select(
        "channel_id", "_stretch", *[F.coalesce(f"_mid_{c}", f"_far_{c}").alias(f"_far_{c}") for c in columns]
    )
    return (
        near.join(carried, ["channel_id", "_stretch"])
        .withColumns({f"before_{c}": F.coalesce(f"_near_{c}", f"_far_{c}") for c in columns})
        .drop("_stretch", *[f"_near_{c}" for c in columns], *[f"_far_{c}" for c in columns])
    )


def status_changes(events: DataFrame, channels: DataFrame, span: int = 1_000_000, stretches: int = STRETCHES) -> DataFrame:
    """What each update really changed, judged against the state just before it.

    `running`, `monitor_in`, `monitor_out` and `error_topic` hold the new value where it changed and
    null elsewhere. A flag of a topic the channel lacks never changes. `report` says what happened;
    updates of unknown channels and empty updates are errors, and reported as such.
    """
    asked = {f"asked_{f}": F.when(F.col("action") == "update", F.col(f)) for f in FLAGS}
    log = effects(events.withColumns(asked))
    seen = last_before(log, [*FLAGS, "present"], span, stretches).where("action = 'update'")
    topics = channels.select(
        "channel_id",
        F.col("monitor_in_topic").isNotNull().alias("has_monitor_in"),
        F.col("monitor_out_topic").isNotNull().alias("has_monitor_out"),
        F.col("error_topic").isNotNull().alias("has_error"),
    )
    rows = seen.join(topics, "channel_id", "left")
    known = F.coalesce("before_present", F.lit(False))

    def change(flag: str, may: Column) -> Column:
        wanted = F.col(f"asked_{flag}")
        return F.when(known & may & (wanted != F.col(f"before_{flag}")), wanted)

    rows = rows.select(
        "channel_id",
        "seq",
        known.alias("known"),
        F.coalesce(*[F.col(f"asked_{f}") for f in FLAGS]).isNull().alias("empty"),
        (~change("is_stopped", F.lit(True))).alias("running"),
        change("monitor_in_enabled", F.col("has_monitor_in")).alias("monitor_in"),
        change("monitor_out_enabled", F.col("has_monitor_out")).alias("monitor_out"),
        change("error_enabled", F.col("has_error")).alias("error_topic"),
    )
    any_topic = F.coalesce("monitor_in", "monitor_out", "error_topic").isNotNull()
    report = (
        F.when(~F.col("known"), F.concat(F.lit(NO_CHANNEL), "channel_id"))
        .when(F.col("empty"), F.lit(EMPTY_STATUS))
        .when(F.col("running").isNull() & ~any_topic, F.concat(F.lit(NO_UPDATES), "channel_id"))
        .when(F.col("running").isNull(), F.concat(F.lit(UPDATED), "channel_id"))
        .when(~F.col("running"), F.concat(F.lit(UPDATED_AND_STOPPED), "channel_id"))
        .otherwise(F.concat(F.lit(UPDATED_AND_STARTED), "channel_id"))
    )
    return rows.withColumn("report", report).drop("known", "empty")


def status_report(state: DataFrame, channels: DataFrame) -> DataFrame:
    """Status of each channel; a flag is null where the channel has no such topic to switch."""
    topics = channels.select("channel_id", "monitor_in_topic", "monitor_out_topic", "error_topic")
    return state.join(topics, "channel_id").select(
        "channel_id",
        "is_stopped",
        F.when(F.col("monitor_in_topic").isNotNull(), F.col("monitor_in_enabled")).alias("monitor_in_enabled"),
        F.when(F.col("monitor_out_topic").isNotNull(), F.col("monitor_out_enabled")).alias("monitor_out_enabled"),
        F.when(F.col("error_topic").isNotNull(), F.col("error_enabled")).alias("error_enabled"),
        "error",
    )


def to_restore(state: DataFrame, restore_stopped: bool = False) -> DataFrame:
    """Every channel comes back stopped; `start` marks those that ran and are started again."""
    return state.select(
        "channel_id",
        F.lit(True).alias("is_stopped"),
        *TOPIC_FLAGS,
        "error",
        (F.lit(not restore_stopped) & ~F.col("is_stopped")).alias("start"),
    )


def apply_state(channels: DataFrame, state: DataFrame) -> DataFrame:
    """Channel rows with the flags of the folded log, for the next micro-batch."""
    return channels.drop(*FLAGS).join(state.select("channel_id", *FLAGS), "channel_id")


def completion_events(channels: DataFrame, seq: int, error: str | None) -> DataFrame:
    """Log rows for the channels of a stream that ended: finished without an error, failed with one."""
    return channels.select(
        "channel_id",
        F.lit(seq).cast("bigint").alias("seq"),
        F.lit("completed" if error is None else "failed").alias("action"),
        *[F.lit(None).cast("boolean").alias(f) for f in FLAGS],
        F.lit(error).cast("string").alias("error"),
    )
