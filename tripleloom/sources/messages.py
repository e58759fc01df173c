"""Message tables: reading topics, and writing records, by broker type.

Every reader gives the same columns, in batch and as a stream, so topics of different brokers can be
unioned: msg_id, topic, key, payload, ts, and the place of a message in its topic: part, position. Messages of one
part are in the order of their positions, as numbers; between parts a topic has no order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.vocab import BROKER_TYPES

MESSAGE_SCHEMA = "msg_id string, topic string, key string, payload string, ts timestamp, part string, position bigint"
MESSAGE_COLUMNS = ("msg_id", "topic", "key", "payload", "ts", "part", "position")

# fixed values: consumer defaults of a channel
START_AT = "latest"
DEFAULT_BUFFER = 10
DEFAULT_PARALLELISM = 2


@dataclass(frozen=True)
class TopicSource:
    """Where one topic is read from.

    A KAFKA topic names its servers. An MQTT topic lands as files: `path`, the file format, and for
    tables whose columns are named otherwise, the expression of each message column.
    """

    topic: str | None = None
    broker_type: str = "MQTT"
    servers: str | None = None
    group_id: str | None = None
    path: str | None = None
    file_format: str = "parquet"
    schema: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    buffer_size: int | None = None
    min_partitions: int | None = None


def kafka_source_options(source: TopicSource, streaming: bool) -> dict[str, str]:
    """Options of Spark's Kafka source. Offsets live in the checkpoint instead of being auto-committed."""
    options = {"kafka.bootstrap.servers": source.servers, "subscribe": source.topic}
    if source.group_id:
        options["kafka.group.id"] = source.group_id
    if source.min_partitions:  # more tasks than topic partitions, each still in offset order
        options["minPartitions"] = str(source.min_partitions)
    if streaming:
        options["startingOffsets"] = START_AT
        if source.buffer_size:
            options["maxOffsetsPerTrigger"] = str(source.buffer_size)
    else:
        options["startingOffsets"] = "earliest"  # a batch read has no "latest"
    return options


def kafka_sink_options(servers: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers}


def _read_kafka(spark: SparkSession, source: TopicSource, streaming: bool) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    rows = reader.options(**kafka_source_options(source, streaming)).load()
    return rows.select(
        F.concat_ws("/", "topic", "partition", "offset").alias("msg_id"),
        "topic",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("payload"),
        F.col("timestamp").alias("ts"),
        F.col("partition").cast("string").alias("part"),
        F.col("offset").alias("position"),
    )


def _read_files(spark: SparkSession, source: TopicSource, streaming: bool) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    if streaming and source.buffer_size:
        reader = reader.option("maxFilesPerTrigger", str(source.buffer_size))
    if source.file_format == "text":
        # One message per line. Its position is the first byte of the block it was read from and its number within that block.
        # A block has fewer lines than bytes, so positions of a file follow each other and no two lines share one,
        # however it is split. Spark reads a whole block by itself, and only the last ones of files together; their
        # numbers go on, which only a later block of the same file could notice.
        rows = reader.option("wholetext", "false").text(source.path)
        number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        rows = rows.select("value", F.col("_metadata").alias("_m"), number.alias("_n"))
        position = F.col("_m.file_block_start") + F.col("_n")
        rows = rows.select(
            F.concat_ws("/", "_m.file_path", position).alias("msg_id"),
            F.lit(source.topic).alias("topic"),
            F.lit(None).cast("string").alias("key"),
            F.col("value").alias("payload"),
            F.col("_m.file_modification_time").alias("ts"),
            F.col("_m.file_path").alias("part"),
            position.alias("position"),
        )
        return rows
    rows = reader.format(source.file_format).schema(source.schema or MESSAGE_SCHEMA).load(source.path)
    if source.columns:
        rows = rows.select(*[F.expr(source.columns.get(c, "null")).alias(c) for c in MESSAGE_COLUMNS])
    rows = rows.select(
        F.col("msg_id").cast("string"), "topic", F.col("key").cast("string"), "payload", F.col("ts").cast("timestamp"),
        F.col("part").cast("string"), F.col("position").cast("bigint"),
    )
    return rows if source.topic is None else rows.where(F.col("topic") == source.topic)


def read_messages(spark: SparkSession, *sources: TopicSource, streaming: bool = False) -> DataFrame:
    """Messages of one or more topics, each read the way its broker type wants."""
    out: DataFrame | None = None
    for source in sources:
        if source.broker_type not in BROKER_TYPES:
            raise ValueError(f"unknown broker type {source.broker_type!r}")
        read = _read_kafka if source.broker_type == "KAFKA" else _read_files
        rows = read(spark, source, streaming)
        out = rows if out is None else out.unionByName(rows)
    return out


def record_key(broker: Column, channel_id: Column) -> Column:
    """A Kafka record carries the channel id as its key; an MQTT message has no key."""
    return F.when(broker == "KAFKA", channel_id)


def to_kafka(records: DataFrame) -> DataFrame:
    """The columns Spark's Kafka sink wants."""
    return records.where("broker = 'KAFKA'").select("topic", "key", "value")


def send_to_kafka(rows: DataFrame, address: str) -> None:
    """Write records (topic, key, value) to the Kafka servers at this address."""
    rows.write.format("kafka").options(**kafka_sink_options(address)).save()
