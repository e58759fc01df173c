"""Channel definitions: their schema, JSON form, defaults, generated ids and encrypted credentials."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: field names of a channel definition ------------------------------------------
KAFKA = "struct<host: string, port: int, groupId: string>"
MQTT = "struct<protocol: string, host: string, port: int, clientId: string, user: string, password: string>"
TOPIC = f"struct<topic: string, brokerType: string, kafkaSettings: {KAFKA}, mqttSettings: {MQTT}>"
ROLES = {
    "input": "inputTopicSettings",
    "output": "outputTopicSettings",
    "monitor_in": "monitorInputTopicSettings",
    "monitor_out": "monitorOutputTopicSettings",
    "error": "errorTopicSettings",
}
REQUIRED_ROLES = ("input", "output")
SETTINGS = (
    "struct<channelId: string, "
    + ", ".join(f"{name}: {TOPIC}" for name in ROLES.values())
    + ", parallelism: int, bufferSize: int>"
)
MAPPING = (
    "struct<name: string, author: string, version: string, description: string, tags: array<string>, "
    "inputFormat: string, outputFormat: string, rml: string>"
)
METADATA = f"struct<name: string, author: string, tags: array<string>, mapping: {MAPPING}>"
# Definitions and updates spell the monitor flags differently; both are read, the first is written.
MONITOR_SPELLINGS = {
    "monitor_in": ("inputMonitoringTopicEnabled", "inputMonitorTopicEnabled"),
    "monitor_out": ("outputMonitoringTopicEnabled", "outputMonitorTopicEnabled"),
}
STATUS_IN = (
    "struct<isStopped: boolean, "
    + ", ".join(f"{s}: boolean" for pair in MONITOR_SPELLINGS.values() for s in pair)
    + ", errorTopicEnabled: boolean, error: string>"
)
# ------------------------------------------------------------------------------------------------


def read_definitions(df: DataFrame, json: str = "definition") -> DataFrame:
    """settings, metadata and status structs of channel definitions given as JSON text.

    Unknown keys are ignored, a missing status gets its defaults, and `error` names what a definition
    lacks or has outside its domain.
    """
    parsed = df.withColumn("_d", F.from_json(json, f"settings {SETTINGS}, metadata {METADATA}, status {STATUS_IN}"))
    status = F.col("_d.status")

    def flag(*names: str, default: bool) -> Column:
        return F.coalesce(*[status.getField(n) for n in names], F.lit(default))

    missing = [
        F.when(F.col(path).isNull(), F.lit(path[3:]))
        for path in (
            "_d.settings.inputTopicSettings.topic",
            "_d.settings.inputTopicSettings.brokerType",
            "_d.settings.outputTopicSettings.topic",
            "_d.settings.outputTopicSettings.brokerType",
            "_d.metadata.mapping.inputFormat",
            "_d.metadata.mapping.outputFormat",
            "_d.metadata.mapping.rml",
        )
    ]
    outside = [
        F.when(~F.col(f"_d.metadata.mapping.{name}").isin(*domain), F.lit(f"metadata.mapping.{name}"))
        for name, domain in (("inputFormat", ("JSON", "CSV", "XML")), ("outputFormat", ("TTL", "JSONLD")))
    ] + [
        F.when(~F.col(f"_d.settings.{role}.brokerType").isin("MQTT", "KAFKA"), F.lit(f"settings.{role}.brokerType"))
        for role in ROLES.values()
    ]
    bad = F.concat_ws(", ", *missing, *outside)
    return parsed.select(
        *[c for c in df.columns if c != json],
        F.col("_d.settings").alias("settings"),
        F.col("_d.metadata").alias("metadata"),
        F.struct(
            flag("isStopped", default=False).alias("isStopped"),
            flag(*MONITOR_SPELLINGS["monitor_in"], default=True).alias("inputMonitoringTopicEnabled"),
            flag(*MONITOR_SPELLINGS["monitor_out"], default=True).alias("outputMonitoringTopicEnabled"),
            flag("errorTopicEnabled", default=True).alias("errorTopicEnabled"),
            status.getField("error").alias("error"),
        ).alias("status"),
        F.when(bad != "", F.concat(F.lit("WrongDefinition: "), bad)).alias("error"),
    )


def mapping_hash(rml: Column) -> Column:
    """SHA-256 of the mapping text, upper-case hexadecimal."""
    return F.upper(F.sha2(rml, 256))


def _without_empty_tags(struct: Column) -> Column:
    tags = struct.getField("tags")
    return struct.withField("tags", F.when(F.size(tags) > 0, tags))


def mapping_header(mapping: Column) -> Column:
    """A mapping without its text, with the hash of the text instead."""
    return mapping.dropFields("rml").withField("rmlHash", mapping_hash(mapping.getField("rml")))


def write_definitions(df: DataFrame, name: str = "definition") -> DataFrame:
    """Definitions as JSON text; absent optional fields and empty tags are left out."""
    mapping = F.col("metadata.mapping")
    full = _without_empty_tags(mapping).withField("rmlHash", mapping_hash(mapping.getField("rml")))
    metadata = _without_empty_tags(F.col("metadata")).withField("mapping", full)
    body = F.to_json(F.struct("status", metadata.alias("metadata"), "settings"))
    return df.withColumn(name, body).drop("settings", "metadata", "status")


# --- generated ids ------------------------------------------------------------------------------


def generated_id(settings: Column) -> Column:
    """<input topic>_<output topic>_<input broker>_<output broker>_<suffix>, white space removed.

    The suffix is a hash of the definition instead of a random number, so a repeated task gives the
    same id again.
    """

    def part(role: str, name: str) -> Column:
        return F.regexp_replace(settings.getField(ROLES[role]).getField(name), r"\s", "")

    suffix = F.substring(F.sha2(F.to_json(settings), 256), 1, 32)
    return F.concat_ws(
        "_", part("input", "topic"), part("output", "topic"), part("input", "brokerType"), part("output", "brokerType"), suffix
    )


def with_channel_id(df: DataFrame) -> DataFrame:
    """The definition's own id where it has one, else a generated one."""
    settings = F.col("settings")
    own = settings.getField("channelId")
    return df.withColumn("channel_id", F.coalesce(own, generated_id(settings)))


# --- defaults -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class BrokerDefaults:
    """Default broker of one topic role."""

    kafka_host: str = "127.0.0.1"
    kafka_port: int = 9093
    mqtt_protocol: str = "tcp"
    mqtt_host: str = "127.0.0.1"
    mqtt_port: int = 1883
    mqtt_client_id: str = "tripleloom"


@dataclass(frozen=True)
class Defaults:
    """What a definition leaves open: one broker per role, parallelism and buffer size."""

    roles: tuple[tuple[str, BrokerDefaults], ...] = tuple(
        (role, BrokerDefaults(mqtt_client_id=f"tripleloom/{role}")) for role in ROLES
    )
    parallelism: int = 2
    buffer_size: int = 10


def resolve_settings(df: DataFrame, defaults: Defaults = Defaults()) -> DataFrame:
    """Settings with every default filled in, per topic role; absent optional topics stay absent.

    Expects channel_id. The consumer group falls back to one named after the channel.
    """
    settings = F.col("settings")
    group = F.coalesce(settings["inputTopicSettings"]["kafkaSettings"]["groupId"], F.concat(F.lit("group_"), "channel_id"))
    resolved = settings.withField("channelId", F.col("channel_id"))
    for role, broker in defaults.roles:
        topic = settings.getField(ROLES[role])
        kafka, mqtt = topic.getField("kafkaSettings"), topic.getField("mqttSettings")
        filled = F.struct(
            topic.getField("topic").alias("topic"),
            topic.getField("brokerType").alias("brokerType"),
            F.struct(
                F.coalesce(kafka.getField("host"), F.lit(broker.kafka_host)).alias("host"),
                F.coalesce(kafka.getField("port"), F.lit(broker.kafka_port)).alias("port"),
                F.coalesce(kafka.getField("groupId"), group).alias("groupId"),
            ).alias("kafkaSettings"),
            F.struct(
                F.coalesce(mqtt.getField("protocol"), F.lit(broker.mqtt_protocol)).alias("protocol"),
                F.coalesce(mqtt.getField("host"), F.lit(broker.mqtt_host)).alias("host"),
                F.coalesce(mqtt.getField("port"), F.lit(broker.mqtt_port)).alias("port"),
                F.coalesce(mqtt.getField("clientId"), F.lit(broker.mqtt_client_id)).alias("clientId"),
                mqtt.getField("user").alias("user"),
                mqtt.getField("password").alias("password"),
            ).alias("mqttSettings"),
        )
        resolved = resolved.withField(ROLES[role], F.when(topic.isNotNull(), filled))
    resolved = resolved.withField("parallelism", F.coalesce(settings.getField("parallelism"), F.lit(defaults.parallelism)))
    resolved = resolved.withField("bufferSize", F.coalesce(settings.getField("bufferSize"), F.lit(defaults.buffer_size)))
    return df.withColumn("settings", resolved)


# --- credentials --------------------------------------------------------------------------------


def _key16(key: Column) -> Column:
    """Keys shorter than 16 characters are filled with spaces on the left, never cut."""
    return F.format_string("%16s", key)


def encrypt_text(value: Column, key: Column) -> Column:
    """Base64 of a random initialisation vector followed by the AES-CBC ciphertext."""
    return F.when(value.isNotNull(), F.base64(F.aes_encrypt(value, _key16(key), F.lit("CBC"), F.lit("PKCS"))))


def decrypt_text(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), _key16(key), F.lit("CBC"), F.lit("PKCS")).cast("string")


def _on_credentials(df: DataFrame, change) -> DataFrame:
    """Apply a change to MQTT user and password of all five topics."""
    settings = F.col("settings")
    for role in ROLES.values():
        topic = F.col("settings").getField(role)
        mqtt = topic.getField("mqttSettings")
        changed = mqtt.withField("user", change(mqtt.getField("user"))).withField("password", change(mqtt.getField("password")))
        settings = settings.withField(role, topic.withField("mqttSettings", changed))
    return df.withColumn("settings", settings)


def encrypt_credentials(df: DataFrame, key: str) -> DataFrame:
    return _on_credentials(df, lambda c: encrypt_text(c, F.lit(key)))


def decrypt_credentials(df: DataFrame, key: str) -> DataFrame:
    return _on_credentials(df, lambda c: decrypt_text(c, F.lit(key)))


# --- the flat table the pipeline reads ----------------------------------------------------------


def channel_table(df: DataFrame) -> DataFrame:
    """Resolved definitions (settings, status, channel_id, mapping_id) as channel rows."""
    columns = [F.col("channel_id")]
    for role, name in ROLES.items():
        topic = F.col("settings").getField(name)
        columns.append(topic.getField("topic").alias(f"{role}_topic"))
        if role != "input":
            broker, kafka, mqtt = topic.getField("brokerType"), topic.getField("kafkaSettings"), topic.getField("mqttSettings")
            columns.append(broker.alias(f"{role}_broker"))
            at = lambda server: F.concat(server.getField("host"), F.lit(":"), server.getField("port").cast("string"))
            mqtt_at = F.concat(mqtt.getField("protocol"), F.lit("://"), at(mqtt))
            columns.append(F.when(broker == "KAFKA", at(kafka)).otherwise(mqtt_at).alias(f"{role}_address"))
    return df.select(
        *columns,
        "mapping_id",
        F.col("status.isStopped").alias("is_stopped"),
        F.col("status.inputMonitoringTopicEnabled").alias("monitor_in_enabled"),
        F.col("status.outputMonitoringTopicEnabled").alias("monitor_out_enabled"),
        F.col("status.errorTopicEnabled").alias("error_enabled"),
    )
