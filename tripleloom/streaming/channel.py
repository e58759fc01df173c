"""Channels: messages in, documents, monitor markers and failures out.

One projection computes every record a message gives; there is no state, so the same plan runs in
batch and in Structured Streaming. Many channels share one job through a join with the channel table.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from tripleloom.model import Mapping
from tripleloom.operators.dryrun import apply_by_id
from tripleloom.operators.state import completion_events
from tripleloom.session import prepare
from tripleloom.sources.messages import record_key, send_to_kafka, to_kafka

# What a channel row must hold. A null topic switches its stage off for good.
CHANNEL_SCHEMA = (
    "channel_id string, input_topic string, output_topic string, output_broker string, "
    "monitor_in_topic string, monitor_in_broker string, monitor_out_topic string, monitor_out_broker string, "
    "error_topic string, error_broker string, mapping_id string, is_stopped boolean, "
    "monitor_in_enabled boolean, monitor_out_enabled boolean, error_enabled boolean"
)

Transformation = Callable[[Column], Column]


@dataclass(frozen=True)
class PythonTransformation:
    """Any text-to-text Python function as a transformation; what it raises becomes the error."""

    function: Callable[[str], str]


def python_transformation(function: Callable[[str], str]) -> PythonTransformation:
    """Any text-to-text Python function as a transformation; what it raises becomes the error.

    Runs in Arrow batches beside the JVM, all such functions of a job in one pass. Use Column functions where they can say the same.
    """
    return PythonTransformation(function)


def _in_python(functions: dict[str, Callable[[str], str]]) -> Callable[[Column, Column], Column]:
    """One function of (name, payload) that runs the one of that name; a null name is another channel's row."""

    @F.pandas_udf(T.StructType([T.StructField("doc", T.StringType()), T.StructField("error", T.StringType())]))
    def run(names: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        docs, errors = [None] * len(names), [None] * len(names)
        for i, (name, payload) in enumerate(zip(names, payloads, strict=True)):
            if name is None or payload is None:
                continue
            try:
                docs[i] = functions[name](payload)
            except Exception as e:  # the failure of one message must not stop the others
                errors[i] = f"{type(e).__name__}: {e}"
        return pd.DataFrame({"doc": pd.Series(docs, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run


def route(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Each message once per running channel that reads its topic.

    No broadcast hint: the channel table grows with the number of channels, so Catalyst decides by its
    size, and the adaptive skew join splits a hot topic when it is too big to broadcast.
    """
    running = channels.where(~F.col("is_stopped")).withColumnRenamed("input_topic", "topic")
    return messages.join(running, "topic")


def transform(
    routed: DataFrame,
    mappings: dict[str, Mapping],
    transformations: dict[str, Transformation | PythonTransformation] | None = None,
    payload: str = "payload",
    key: str = "msg_id",
) -> DataFrame:
    """Add `doc` and `error`: the mapping or transformation named by mapping_id, failures captured.

    mappings: Mapping by id, or a table of rules as sources.rules.load_catalog() makes.
    """
    given = transformations or {}
    python = {name: t.function for name, t in given.items() if isinstance(t, PythonTransformation)}
    df = apply_by_id(routed, mappings, "mapping_id", payload, key)
    doc, error, name = F.col("doc"), F.col("error"), F.col("mapping_id")
    for own, function in given.items():
        if own not in python:
            doc = F.when(name == own, function(F.when(name == own, F.col(payload)))).otherwise(doc)
            error = F.when(name == own, F.lit(None).cast("string")).otherwise(error)
    if python:  # one pass over the rows however many functions there are; rows of others go without their payload
        mine = name.isin(*python)
        df = df.withColumn("_r", _in_python(python)(F.when(mine, name), F.when(mine, F.col(payload))))
        none = F.when(F.col(payload).isNull(), F.lit("NullMessage: there is no payload"))
        doc, error = F.when(mine, F.col("_r.doc")).otherwise(doc), F.when(mine, F.coalesce("_r.error", none)).otherwise(error)
    return df.withColumns({"doc": doc, "error": error}).drop("_r")


def annotate(messages: DataFrame, channels: DataFrame, mappings, transformations=None) -> DataFrame:
    """Route and transform; one row per message and channel, with `doc` or `error`."""
    prepare(messages.sparkSession)
    return transform(route(messages, channels), mappings, transformations)


def marker(topic: Column, ts: Column) -> Column:
    """Monitor text: the channel's input topic and a time in epoch milliseconds."""
    return F.concat(F.lit("@"), topic, F.lit(":"), F.unix_millis(ts).cast("string"))


def failure(error: Column) -> Column:
    return F.concat(F.lit("Failure("), error, F.lit(")"))


RECORD_COLUMNS = ("msg_id", "channel_id", "sink", "broker", "address", "topic", "key", "value", "payload", "part", "position")


def records(annotated: DataFrame, at: Column | None = None) -> DataFrame:
    """Everything the channels send: output, monitor_in, monitor_out and error records.

    All records of a message come from one row, so the input is read and mapped once. `at` is the
    time in the markers: the message time by default, which makes a repeated run equal. `address` is where the channel's own
    settings have the record's topic, from the columns <sink>_address of settings.channel_table(); null without them.
    """
    ok = F.col("error").isNull()
    time = F.col("ts") if at is None else at

    def record(sink: str, value: Column, when: Column, payload: Column | None = None) -> Column:
        broker = F.col(f"{sink}_broker")
        return F.when(
            when & F.col(f"{sink}_topic").isNotNull(),
            F.struct(
                F.lit(sink).alias("sink"),
                broker.alias("broker"),
                (F.col(f"{sink}_address") if f"{sink}_address" in annotated.columns else F.lit(None).cast("string")).alias("address"),
                F.col(f"{sink}_topic").alias("topic"),
                record_key(broker, F.col("channel_id")).alias("key"),
                value.alias("value"),
                (F.lit(None).cast("string") if payload is None else payload).alias("payload"),
            ),
        )

    mark, nothing = marker(F.col("topic"), time), F.lit(None).cast("string")
    sent = F.array(
        record("monitor_in", mark, F.col("monitor_in_enabled")),
        record("output", F.col("doc"), ok),
        record("error", failure(F.col("error")), ~ok & F.col("error_enabled"), F.col("payload")),
        record("monitor_out", mark, ok & F.col("monitor_out_enabled")),
        # a failure that no topic takes is logged beside the other records
        F.when(
            ~ok & (F.col("error_topic").isNull() | ~F.col("error_enabled")),
            F.struct(
                F.lit("log").alias("sink"), nothing.alias("broker"), nothing.alias("address"), nothing.alias("topic"), nothing.alias("key"),
                failure(F.col("error")).alias("value"), F.col("payload").alias("payload"),
            ),
        ),
    )
    place = [
        F.col(c) if c in annotated.columns else F.lit(None).cast(t).alias(c) for c, t in (("part", "string"), ("position", "bigint"))
    ]
    rows = annotated.select("msg_id", "channel_id", *place, F.explode_outer(sent).alias("r")).where("r is not null")
    return rows.select("msg_id", "channel_id", "part", "position", "r.*").select(*RECORD_COLUMNS)


# Positions of one part and channel that are numbered in one task.
STRETCH = 1 << 16


def ranked(sent: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Add `rank`: the place of each record among those of its channel and sink, by part and then position, from 1.

    Records are numbered within stretches of positions, which bounds what one task sorts however busy a channel is; the
    counts of the stretches, one row each, are then added up.
    """
    group = ["channel_id", "sink", "part", "_stretch"]
    rows = sent.withColumn("_stretch", F.floor(F.col("position") / stretch))
    counts = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("channel_id", "sink").orderBy("part", "_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in group], "_before")
    own = F.row_number().over(Window.partitionBy(*group).orderBy("position", "msg_id"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    placed = rows.withColumn("_own", own).join(counts, same)
    return placed.select(*sent.columns, (F.col("_own") + F.col("_before")).alias("rank"))


def failure_counts(sent: DataFrame) -> DataFrame:
    """Failures of each channel: how many there were, and how many of them no error topic took."""
    logged = F.col("sink") == "log"
    return sent.where(logged | (F.col("sink") == "error")).groupBy("channel_id").agg(
        F.count("*").alias("failures"), F.count(F.when(logged, 1)).alias("failures_without_topic")
    )


def _failure_metrics() -> list[Column]:
    logged = F.col("sink") == "log"
    return [F.count_if(logged | (F.col("sink") == "error")).alias("failures"), F.count_if(logged).alias("failures_without_topic")]


def write_records(sent: DataFrame, path: str, batch_id: int, on_totals: Callable[[dict[str, int]], None] | None = None) -> DataFrame:
    """Write one batch of records into its own folder, one part per sink and address, and return what is there.

    Every file has the records of a channel in the order of their input: by part, and by position as a number. Records keep
    both, so a reader of several files can merge them. `on_totals` gets how many failures there were, and how many of them no error
    topic took; both are counted by the job that writes.
    """
    target = f"{path}/batch_id={batch_id}"
    seen = Observation(f"failures-{batch_id}-{uuid.uuid4().hex}")
    rows = sent.observe(seen, *_failure_metrics()) if on_totals else sent
    rows = rows.sortWithinPartitions("sink", "address", "channel_id", "part", "position", "msg_id")
    rows.write.mode("overwrite").partitionBy("sink", "address").parquet(target)
    if on_totals:
        on_totals(seen.get)
    return sent.sparkSession.read.schema(sent.schema).parquet(target)


def addressed(sent: DataFrame, servers: str | dict[str, str] | None) -> DataFrame:
    """Kafka records without an address of their own get that of `servers`: one for all, or one for each topic named."""
    if not servers:
        return sent
    if isinstance(servers, str):
        other = F.lit(servers)
    else:
        other = F.try_element_at(F.create_map(*[F.lit(x) for pair in servers.items() for x in pair]), F.col("topic"))
    return sent.withColumn("address", F.when(F.col("broker") == "KAFKA", F.coalesce("address", other)).otherwise(F.col("address")))


def send_records(written: DataFrame, send: Callable[[DataFrame, str], None]) -> None:
    """Hand the Kafka records of a written batch to `send` (rows, address), one address after the other.

    The folder is partitioned by address, so each reads its own part of it. A record without an address is an error: no topic stays behind unseen.
    """
    kafka = written.where("broker = 'KAFKA'")
    # one row for each address that the brokers have
    for (address,) in kafka.select("address").distinct().collect():
        rows = kafka.where(F.col("address").eqNullSafe(F.lit(address)))
        if address is None:
            topics = [r[0] for r in rows.select("topic").distinct().limit(5).collect()]
            raise ValueError(f"no Kafka address for topics {', '.join(topics)}")
        send(to_kafka(rows), address)


def run_channels(
    stream: DataFrame,
    load_channels: Callable[[], DataFrame],
    mappings: dict[str, Mapping],
    path: str,
    checkpoint: str,
    transformations: dict[str, Transformation] | None = None,
    kafka_servers: str | dict[str, str] | None = None,
    on_failures: Callable[[DataFrame], None] | None = None,
    on_totals: Callable[[dict[str, int]], None] | None = None,
    send: Callable[[DataFrame, str], None] | None = None,
    trigger: dict | None = None,
    query_name: str | None = None,
    at: Column | None = None,
):
    """Start the streaming query behind any number of channels and return it.

    Channels are read again for every micro-batch, so switching a topic or stopping a channel takes
    effect at the next one. Each micro-batch overwrites its own folder: a batch repeated after a lost
    executor or a restart leaves the same records, once. With `kafka_servers` or `send`, Kafka gets what that folder
    holds, at least once: each record at the address of its channel's own settings, others at that of `kafka_servers`, one for
    all or one by topic. A record with neither stops the query. `send` (rows, address) stands in for Spark's Kafka sink.
    `on_totals` gets each batch's failures as counted while it is written, `on_failures` its counts by channel, which
    read the folder again. `at` is the time in monitor markers, as in `records`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        annotated = annotate(batch, load_channels(), mappings, transformations)
        written = write_records(addressed(records(annotated, at), kafka_servers), path, batch_id, on_totals)
        if on_failures:
            on_failures(failure_counts(written))
        if kafka_servers or send:
            send_records(written, send or send_to_kafka)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


class CompletionLog(StreamingQueryListener):
    """Appends an event to the state log for every channel of a query that ended.

    `append` takes the rows as a DataFrame; `channels_of` gives the channel table's rows that a query (by its name)
    was running, so any number of channels ends at the cost of one write.
    """

    def __init__(self, append: Callable[[DataFrame], None], channels_of: Callable[[str], DataFrame]):
        self._append = append
        self._channels_of = channels_of
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event):
        self._names[str(event.id)] = event.name

    def onQueryProgress(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        name = self._names.pop(str(event.id), None)
        seq = time.time_ns() // 1000
        self._append(completion_events(self._channels_of(name), seq, event.exception))
