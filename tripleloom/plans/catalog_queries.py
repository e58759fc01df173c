"""Registered queries of the catalog, settings and state operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.operators import catalog, settings, state
from tripleloom.plans import fixtures
from tripleloom.plans.channel_queries import MAPPINGS
from tripleloom.plans.mapping_queries import PARTS
from tripleloom.session import work_dir

ROLE_NAMES = settings.ROLES


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.read_definitions(fixtures.definitions(spark, sf_dir))


def _definitions_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions read from JSON text, written again, and read back field by field."""
    rows = settings.write_definitions(_definitions(spark, sf_dir))

    def field(path: str, name: str):
        return F.get_json_object("definition", path).alias(name)

    return rows.select(
        "c_custkey",
        "error",
        field("$.settings.channelId", "own_id"),
        field("$.settings.inputTopicSettings.topic", "input_topic"),
        field("$.settings.inputTopicSettings.kafkaSettings.port", "kafka_port"),
        field("$.settings.errorTopicSettings.mqttSettings.user", "error_user"),
        field("$.metadata.mapping.rmlHash", "rml_hash"),
        field("$.metadata.mapping.tags[0]", "tag"),
        field("$.metadata.unknownKey", "unknown_key"),
        field("$.status.isStopped", "is_stopped"),
        field("$.status.inputMonitoringTopicEnabled", "monitor_in_enabled"),
        field("$.status.errorTopicEnabled", "error_enabled"),
    )


def _channel_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own ids as they are; of generated ones everything but the hash, and how many there are of it."""
    rows = settings.with_channel_id(_definitions(spark, sf_dir))
    generated = F.regexp_extract("channel_id", "^(.*)_([0-9a-f]{32})$", 1)
    return rows.select(
        "c_custkey",
        F.when(generated != "", generated).otherwise(F.col("channel_id")).alias("name"),
        F.length(F.regexp_extract("channel_id", "_([0-9a-f]{32})$", 1)).alias("suffix_length"),
    )


def _resolve_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _definitions(spark, sf_dir).withColumn("channel_id", F.concat(F.lit("c"), "c_custkey"))
    rows = settings.resolve_settings(rows)

    def field(role: str, path: str, name: str):
        return F.col(f"settings.{ROLE_NAMES[role]}.{path}").alias(name)

    return rows.select(
        "channel_id",
        F.col("settings.parallelism").alias("parallelism"),
        F.col("settings.bufferSize").alias("buffer_size"),
        field("input", "kafkaSettings.host", "in_kafka_host"),
        field("input", "kafkaSettings.port", "in_kafka_port"),
        field("input", "kafkaSettings.groupId", "in_group"),
        field("input", "mqttSettings.protocol", "in_protocol"),
        field("input", "mqttSettings.clientId", "in_client"),
        field("input", "mqttSettings.user", "in_user"),
        field("output", "kafkaSettings.groupId", "out_group"),
        field("output", "mqttSettings.port", "out_mqtt_port"),
        field("error", "topic", "error_topic"),
        field("error", "mqttSettings.host", "error_mqtt_host"),
        field("monitor_in", "topic", "monitor_topic"),
    )


def _credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypt, check that the clear text is gone, decrypt."""
    key = "demo key"
    rows = _definitions(spark, sf_dir)
    locked = settings.encrypt_credentials(rows, key).withColumn(
        "locked_user", F.col("settings.inputTopicSettings.mqttSettings.user")
    )
    opened = settings.decrypt_credentials(locked, key)
    return opened.select(
        "c_custkey",
        F.length("locked_user").alias("locked_length"),
        F.col("settings.inputTopicSettings.mqttSettings.user").alias("user"),
        F.col("settings.inputTopicSettings.mqttSettings.password").alias("password"),
        F.col("settings.errorTopicSettings.mqttSettings.password").alias("error_password"),
        F.col("settings.inputTopicSettings.topic").alias("topic"),
    )


def _register_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ask for channels of their customers; some customers have one already."""
    requests = fixtures.table(spark, sf_dir, "orders").selectExpr(
        "concat('c', o_custkey) as channel_id",
        "o_orderkey as seq",
        "case o_orderstatus when 'F' then 'flat' when 'O' then 'parts' else 'nothing' end as mapping_id",
    )
    existing = fixtures.table(spark, sf_dir, "customer").selectExpr(
        "concat('c', c_custkey) as channel_id", "c_mktsegment as segment"
    )
    existing = existing.where("segment = 'BUILDING'")
    return catalog.register_channels(requests, existing, {**MAPPINGS, "parts": PARTS})


def _list_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _definitions(spark, sf_dir).withColumn("channel_id", F.concat(F.lit("c"), "c_custkey"))
    listed = catalog.list_channels(rows, status=True, metadata=True)
    return listed.select(
        "channel_id",
        F.col("status.isStopped").alias("is_stopped"),
        F.col("metadata.name").alias("name"),
        F.col("metadata.mapping.rmlHash").alias("rml_hash"),
        F.to_json("metadata.mapping").contains("rules of").alias("has_text"),
    )


def _list_channels_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _definitions(spark, sf_dir).withColumn("channel_id", F.concat(F.lit("c"), "c_custkey"))
    return catalog.list_channels(rows)


def _find_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) as channel_id", "c_name as name")
    wanted = fixtures.table(spark, sf_dir, "orders").selectExpr("concat('c', o_custkey * 2) as channel_id")
    return catalog.find(rows, wanted, "channel_id")


def _remove_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) as channel_id", "c_name as name")
    gone = fixtures.table(spark, sf_dir, "orders").selectExpr("concat('c', o_custkey * 2) as channel_id")
    return catalog.remove(rows, gone, "channel_id")


def _remove_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) as channel_id")
    gone = fixtures.table(spark, sf_dir, "orders").selectExpr("concat('c', o_custkey * 2) as channel_id")
    return catalog.remove_report(rows, gone, "channel_id")


def _list_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.list_mappings(fixtures.mapping_catalog(spark, sf_dir), header=True)
    return rows.withColumn("tags", F.concat_ws(",", "tags"))


def _list_mappings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.list_mappings(fixtures.mapping_catalog(spark, sf_dir), include_all=True)
    return rows.withColumn("tags", F.concat_ws(",", "tags"))


def _mapping_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.mapping_catalog(spark, sf_dir)
    return rows.select("mapping_id", settings.mapping_hash(F.col("rml")).alias("rml_hash"))


def _channel_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current_state(fixtures.channel_log(spark, sf_dir))


def _state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in two halves, each followed by a run of its own; the second reads the second half alone."""
    log, out, checkpoint = (work_dir(spark, name) for name in ("state-log", "state", "state-checkpoint"))
    events = fixtures.channel_log(spark, sf_dir)
    half = events.agg(F.max("seq")).first()[0] // 2
    for part in (events.where(F.col("seq") > half), events.where(F.col("seq") <= half)):  # the later half first
        part.write.mode("append").parquet(log)
        stream = spark.readStream.schema(events.schema).parquet(log)
        state.follow(stream, out, checkpoint).awaitTermination()
    return state.followed_state(spark, out)


def _status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.status_report(_channel_state(spark, sf_dir), fixtures.log_channels(spark, sf_dir))


def _to_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.to_restore(_channel_state(spark, sf_dir))


def _status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.status_changes(fixtures.channel_log(spark, sf_dir), fixtures.log_channels(spark, sf_dir), span=2000)


# --- SQL ----------------------------------------------------------------------------------------

_BAD_FORMAT = "case when c_custkey % 10 = 9 then 'WrongDefinition: metadata.mapping.inputFormat' end"
_HAS_ERR = "c_nationkey % 2 = 0"

_CHANGES_SQL = f"""with {fixtures.LOG_SQL}, seen as (
  select *,
    last_value(f_stop ignore nulls) over w as b_stop, last_value(f_in ignore nulls) over w as b_in,
    last_value(f_out ignore nulls) over w as b_out, last_value(f_err ignore nulls) over w as b_err,
    coalesce(last_value(f_present ignore nulls) over w, false) as known
  from log window w as (partition by channel_id order by seq rows between unbounded preceding and 1 preceding)),
ch as (
  select 'u' || c_custkey as channel_id, c_nationkey % 2 = 0 as has_in, c_nationkey % 3 = 0 as has_out,
    c_nationkey % 4 <> 0 as has_err from customer),
changes as (
  select seen.channel_id, seq, known,
    coalesce(ask_stop, ask_in, ask_out, ask_err) is null as empty,
    case when known and ask_stop <> b_stop then not ask_stop end as running,
    case when known and has_in and ask_in <> b_in then ask_in end as monitor_in,
    case when known and has_out and ask_out <> b_out then ask_out end as monitor_out,
    case when known and has_err and ask_err <> b_err then ask_err end as error_topic
  from seen left join ch on seen.channel_id = ch.channel_id where action = 'update')
select channel_id, seq, running, monitor_in, monitor_out, error_topic,
  case when not known then 'No channel with ID: ' || channel_id
    when empty then 'ChannelStatus object was empty, so no updates were made.'
    when running is null and coalesce(monitor_in, monitor_out, error_topic) is null
      then 'No updates were made to channel status for channel with ID: ' || channel_id
    when running is null then 'Updated settings for channel with ID: ' || channel_id
    when not running then 'Updated settings and stopped channel with ID: ' || channel_id
    else 'Updated settings and started channel with ID: ' || channel_id end as report
from changes"""

_MAPPING_COLUMNS = """'m' || doc_id as mapping_id, 'mapping ' || doc_id as name, source as author,
  case when doc_id % 2 = 0 then 'v1' end as version, lang || ',' || source as tags,
  case doc_id % 3 when 0 then 'JSON' when 1 then 'XML' else 'CSV' end as input_format,
  case when doc_id % 2 = 0 then 'TTL' else 'JSONLD' end as output_format"""

QUERIES = {
    "definitions_json": (
        _definitions_json,
        f"""select c_custkey, {_BAD_FORMAT} as error,
          case when c_custkey % 5 = 0 then 'own-' || c_custkey end as own_id, 'in/a b/' || c_custkey as input_topic,
          case when c_custkey % 3 = 0 then '9092' end as kafka_port,
          case when {_HAS_ERR} and c_custkey % 4 = 0 then c_name end as error_user,
          upper(sha256('rules of ' || c_name)) as rml_hash, c_mktsegment as tag, cast(null as varchar) as unknown_key,
          case when c_custkey % 4 = 0 then 'true' else 'false' end as is_stopped,
          case when c_custkey % 6 = 0 then 'false' else 'true' end as monitor_in_enabled, 'true' as error_enabled
        from customer""",
    ),
    "channel_ids": (
        _channel_ids,
        """select c_custkey, case when c_custkey % 5 = 0 then 'own-' || c_custkey
            else 'in/ab/' || c_custkey || '_out/ab/' || c_custkey || '_' || broker || '_' || broker end as name,
          case when c_custkey % 5 = 0 then 0 else 32 end as suffix_length
        from (select *, case when c_custkey % 2 = 0 then 'KAFKA' else 'MQTT' end as broker from customer)""",
    ),
    "resolve_settings": (
        _resolve_settings,
        f"""select 'c' || c_custkey as channel_id, case when c_custkey % 7 = 0 then 8 else 2 end as parallelism, 10 as buffer_size,
          case when c_custkey % 3 = 0 then 'k.example.com' else '127.0.0.1' end as in_kafka_host,
          case when c_custkey % 3 = 0 then 9092 else 9093 end as in_kafka_port, grp as in_group,
          case when c_custkey % 4 = 0 then 'ssl' else 'tcp' end as in_protocol, 'tripleloom/input' as in_client,
          case when c_custkey % 4 = 0 then c_name end as in_user, grp as out_group, 1883 as out_mqtt_port,
          case when {_HAS_ERR} then 'err/a b/' || c_custkey end as error_topic,
          case when {_HAS_ERR} then case when c_custkey % 4 = 0 then 'm.example.com' else '127.0.0.1' end end as error_mqtt_host,
          cast(null as varchar) as monitor_topic
        from (select *, case when c_custkey % 6 = 0 then 'g' || c_custkey else 'group_c' || c_custkey end as grp from customer)""",
    ),
    "credentials_roundtrip": (
        _credentials,
        f"""select c_custkey, case when has then 64 end as locked_length, case when has then c_name end as user,
          case when has then 'pw é ' || c_mktsegment end as password,
          case when has and {_HAS_ERR} then 'pw é ' || c_mktsegment end as error_password, 'in/a b/' || c_custkey as topic
        from (select *, c_custkey % 4 = 0 as has from customer)""",
    ),
    "register_channels": (
        _register_channels,
        """with tried as (
          select 'c' || o_custkey as channel_id, o_orderkey as seq,
            case o_orderstatus when 'F' then 'flat' when 'O' then 'parts' else 'nothing' end as mapping_id,
            o_orderstatus not in ('F', 'O') as failed,
            exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING') as known
          from orders),
        decided as (
          select *, seq = min(seq) filter (where not failed and not known) over (partition by channel_id) as is_first from tried)
        select channel_id, seq, mapping_id,
          case when failed then 'RMLMappingException: NoSuchMapping: nothing'
            when known or not coalesce(is_first, false) then 'NonUniqueChannelIdException: ' || channel_id end as reason,
          not failed and not known and coalesce(is_first, false) as accepted
        from decided""",
    ),
    "list_channels": (
        _list_channels,
        """select 'c' || c_custkey as channel_id, c_custkey % 4 = 0 as is_stopped, c_name as name,
          upper(sha256('rules of ' || c_name)) as rml_hash, false as has_text from customer""",
    ),
    "list_channels_ids": (_list_channels_ids, "select 'c' || c_custkey as channel_id from customer"),
    "find_channels": (
        _find_channels,
        """select w.channel_id, c_name as name, case when c_custkey is null then 'No entry with ID: ' || w.channel_id end as error
        from (select distinct 'c' || (o_custkey * 2) as channel_id from orders) w
        left join customer on 'c' || c_custkey = w.channel_id""",
    ),
    "remove_channels": (
        _remove_channels,
        """select 'c' || c_custkey as channel_id, c_name as name from customer
        where c_custkey not in (select o_custkey * 2 from orders where o_custkey is not null)""",
    ),
    "remove_report": (
        _remove_report,
        """select channel_id, channel_id in (select 'c' || c_custkey from customer) as removed
        from (select distinct 'c' || (o_custkey * 2) as channel_id from orders)""",
    ),
    "list_mappings": (
        _list_mappings,
        f"select {_MAPPING_COLUMNS}, upper(sha256(text)) as rml_hash from documents",
    ),
    "list_mappings_all": (
        _list_mappings_all,
        f"select {_MAPPING_COLUMNS}, text as rml, upper(sha256(text)) as rml_hash from documents",
    ),
    "mapping_hash": (_mapping_hash, "select 'm' || doc_id as mapping_id, upper(sha256(text)) as rml_hash from documents"),
    "channel_state": (_channel_state, f"with {fixtures.LOG_SQL}, {fixtures.STATE_SQL} select * from state"),
    "channel_state_stream": (_state_stream, f"with {fixtures.LOG_SQL}, {fixtures.STATE_SQL} select * from state"),
    "status_report": (
        _status_report,
        f"""with {fixtures.LOG_SQL}, {fixtures.STATE_SQL}
        select channel_id, is_stopped, case when c_nationkey % 2 = 0 then monitor_in_enabled end as monitor_in_enabled,
          case when c_nationkey % 3 = 0 then monitor_out_enabled end as monitor_out_enabled,
          case when c_nationkey % 4 <> 0 then error_enabled end as error_enabled, error
        from state join customer on channel_id = 'u' || c_custkey""",
    ),
    "channels_to_restore": (
        _to_restore,
        f"""with {fixtures.LOG_SQL}, {fixtures.STATE_SQL}
        select channel_id, true as is_stopped, monitor_in_enabled, monitor_out_enabled, error_enabled, error,
          not is_stopped as start from state""",
    ),
    "status_changes": (_status_changes, _CHANGES_SQL),
}
