"""Registered queries of the channel operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.model import Mapping, TriplesMap, blank, po, reference, template
from tripleloom.operators import settings
from tripleloom.operators.dryrun import dry_run
from tripleloom.plans import fixtures
from tripleloom.plans.mapping_queries import _ESC, AT, EX, FLAT, K, PARTS, SUPPLIERS, VALUE
from tripleloom.session import work_dir
from tripleloom.sources import rules
from tripleloom.sources.messages import TopicSource, read_messages
from tripleloom.streaming import channel
from tripleloom.vocab import RDF_TYPE, XSD

SHORT = Mapping(
    "short",
    (TriplesMap("event", template(EX + "e/{event_id}"), (po(EX + "type", reference("event_type")),)),),
)
MAPPINGS = {"flat": FLAT, "short": SHORT}
TRANSFORMATIONS = {"identity": lambda payload: payload}

EVENTS_AS_MESSAGES = TopicSource(
    schema="event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    columns={"msg_id": "event_id", "topic": "concat('user/', user_id)", "payload": "props", "ts": "ts", "part": "user_id % 4", "position": "event_id"},
)


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channel.annotate(fixtures.broken_events(spark, sf_dir), fixtures.channels(spark, sf_dir), MAPPINGS, TRANSFORMATIONS)


def _records(sink: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = channel.records(_annotated(spark, sf_dir)).where(F.col("sink") == sink)
        return rows.select("msg_id", "channel_id", "broker", "topic", "key", "value")

    return run


def _error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = channel.records(_annotated(spark, sf_dir)).where("sink = 'error'")
    return rows.select("msg_id", "channel_id", "broker", "topic", "key", "value", "payload")


def _order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of each output in its channel."""
    rows = channel.records(_annotated(spark, sf_dir)).where("sink = 'output'").withColumn("position", F.col("msg_id"))
    return channel.ranked(rows, 1000).select("msg_id", "channel_id", "rank")


def _many_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under 240 mappings that come out of a rule table, and some under a mapping that is not there."""
    made = [
        Mapping(
            f"m{i}",
            (
                TriplesMap(
                    "e",
                    template(EX + f"e{i}/{{event_id}}"),
                    (po(EX + f"kind{i % 7}", reference("event_type")), po(EX + "k", reference("props.k", XSD + "integer"))),
                    (EX + f"Class{i % 3}",),
                ),
            ),
        )
        for i in range(MANY)
    ]
    mappings = rules.all_from_rule_table(rules.to_rule_table(spark, *made))
    named = F.concat(F.lit("m"), (F.col("msg_id") % (MANY + 1)).cast("string"))
    rows = fixtures.events(spark, sf_dir).withColumn("mapping_id", named)
    return channel.transform(rows, mappings).select("msg_id", "mapping_id", "doc", "error")


MANY = 240


def shapes(n: int) -> dict[str, Mapping]:
    """So many mappings of five shapes: one item, items of an array, JSON-LD, CSV, and arrays inside templates beside a blank node."""
    kind = po(EX + "kind", reference("event_type"))

    def of(i: int) -> Mapping:
        one = (TriplesMap("e", template(EX + f"e{i}/{{event_id}}"), (kind,), (EX + f"Class{i % 3}",)),)
        if i % 5 == 1:
            return Mapping(f"m{i}", (TriplesMap("i", template(EX + f"e{i}/{{v}}"), (po(EX + "n", reference("n", XSD + "integer")),), iterator="$.items[*]"),))
        if i % 5 == 2:
            return Mapping(f"m{i}", one, output_format="JSONLD")
        if i % 5 == 3:
            return Mapping(f"m{i}", (TriplesMap("r", template(EX + f"e{i}/{{event_id}}"), (po(EX + "kind", reference("kind")),), iterator=""),), "CSV")
        if i % 5 == 4:
            return Mapping(f"m{i}", (TriplesMap("t", template(EX + f"e{i}/{{tags}}"), (po(EX + "of", blank("b{event_id}")),)),))
        return Mapping(f"m{i}", one)

    return {f"m{i}": of(i) for i in range(n)}


def _many_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channel.transform(fixtures.shaped_events(spark, sf_dir, MANY), shapes(MANY)).select("msg_id", "mapping_id", "doc", "error")


def xml_shapes(n: int) -> dict[str, Mapping]:
    """So many mappings of XML messages: items of a repeated element, or one object with several values as JSON-LD."""

    def of(i: int) -> Mapping:
        if i % 2:
            one = TriplesMap("part", template(EX + f"x{i}/{{@key}}"), (po(EX + "has", reference("attr/value")),), iterator="/part")
            return Mapping(f"x{i}", (one,), "XML", "JSONLD")
        return Mapping(f"x{i}", (TriplesMap("attr", template(EX + f"x{i}/{{@kind}}"), (po(EX + "value", reference("value")),), iterator="/part/attr"),), "XML")

    return {f"x{i}": of(i) for i in range(n)}


def _xml_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as XML through one of many mappings that are data."""
    named = F.concat(F.lit("x"), (F.col("msg_id") % MANY).cast("string"))
    rows = fixtures.parts_xml(spark, sf_dir).withColumn("mapping_id", named)
    return channel.transform(rows, xml_shapes(MANY)).select("msg_id", "mapping_id", "doc", "error")


def _mapping_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document mapped by the rule document that is made of it."""
    catalog = rules.load_catalog(fixtures.rule_documents(spark, sf_dir))
    return channel.transform(fixtures.documents_as_items(spark, sf_dir), catalog).select("msg_id", "mapping_id", "doc", "error")


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(spark, sf_dir).select("msg_id", "channel_id", "doc", "error")


def _routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side topics each message of each channel reaches, given topics and switches."""
    routed = channel.route(fixtures.broken_events(spark, sf_dir), fixtures.channels(spark, sf_dir))

    def on(sink: str):
        return F.when(F.col(f"{sink}_enabled"), F.col(f"{sink}_topic")).alias(sink)

    return routed.select("msg_id", "channel_id", "topic", "output_topic", on("monitor_in"), on("monitor_out"), on("error"))


def _identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any text-to-text transformation; the identity gives every message back, bad ones included."""
    rows = fixtures.broken_events(spark, sf_dir).withColumn("mapping_id", F.lit("identity"))
    done = channel.transform(rows, {}, TRANSFORMATIONS)
    return done.select("msg_id", "doc", "error")


def _read_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two file-backed topics of different tables, read into one message schema."""
    fixtures.table(spark, sf_dir, "events")
    events = TopicSource(path=f"{sf_dir}/events.parquet", schema=EVENTS_AS_MESSAGES.schema, columns=EVENTS_AS_MESSAGES.columns)
    turns = TopicSource(
        path=f"{sf_dir}/conversations.parquet",
        schema="conv_id bigint, turn bigint, role string, text string",
        columns={"msg_id": "concat(conv_id, '/', turn)", "topic": "concat('talk/', role)", "key": "conv_id", "payload": "text"},
    )
    return read_messages(spark, events, turns).select("msg_id", "topic", "key", "payload", F.unix_millis("ts").alias("ms"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream through every channel, until all input is used up."""
    fixtures.table(spark, sf_dir, "events")
    out, checkpoint = work_dir(spark, "channel-out"), work_dir(spark, "channel-checkpoint")
    source = TopicSource(path=f"{sf_dir}/events.parquet*", schema=EVENTS_AS_MESSAGES.schema, columns=EVENTS_AS_MESSAGES.columns)
    stream = read_messages(spark, source, streaming=True)
    query = channel.run_channels(
        stream, lambda: fixtures.channels(spark, sf_dir), {"flat": PROPS, "short": PROPS}, out, checkpoint, TRANSFORMATIONS
    )
    query.awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select("msg_id", "channel_id", "sink", "broker", "topic", "key", "value")


def _text_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text files, every second one the same: each its own message, in the order of the file."""
    path = work_dir(spark, "lines")
    line = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("tick")
    rows = fixtures.table(spark, sf_dir, "events").repartitionByRange(8, "event_id").sortWithinPartitions("event_id")
    rows.select(line.alias("value")).write.text(path)
    read = read_messages(spark, TopicSource("lines", path=path, file_format="text"))
    placed = channel.ranked(read.withColumns({"channel_id": F.lit("lines"), "sink": F.lit("input")}), 1000)
    return placed.groupBy("payload", "rank").agg(F.countDistinct("msg_id").alias("messages"))


def _sink_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written by channels with servers of their own, read back from the part of their address."""
    resolved = settings.resolve_settings(settings.with_channel_id(settings.read_definitions(fixtures.placed_definitions(spark, sf_dir))))
    channels = settings.channel_table(resolved.withColumn("mapping_id", F.lit("short")))
    sent = channel.records(channel.annotate(fixtures.broken_events(spark, sf_dir), channels, MAPPINGS))
    written = channel.write_records(channel.addressed(sent, None), work_dir(spark, "addresses"), 0)
    return written.where("sink in ('output', 'error')").select("msg_id", "channel_id", "sink", "broker", "address", "topic")


def _failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channel.failure_counts(channel.records(_annotated(spark, sf_dir)))


PROPS = Mapping("props", (TriplesMap("p", template(EX + "k/{k}"), (po(EX + "k", reference("k", XSD + "integer")),)),))


def _dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of mappings tried on their samples, or on a text stored beside them."""
    catalog = fixtures.table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "case p_size % 4 when 0 then 'flat' when 1 then 'parts' when 2 then 'suppliers' else 'unknown' end as mapping_id",
        "if(p_partkey % 2 = 0, null, if(p_partkey % 3 = 0, '', p_name)) as sample",
    )
    done = dry_run(catalog, {"flat": FLAT, "parts": PARTS, "suppliers": SUPPLIERS}, sample="sample")
    return done.select("p_partkey", "mapping_id", "ok", "doc", "error")


# --- SQL ----------------------------------------------------------------------------------------

_PAYLOAD = f"""'{{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"'
  || coalesce(',"value":"' || {VALUE} || '"', '') || ',"at":"' || {AT} || '","props":{{"k":' || {K} || '}}}}'"""
_BAD = "(event_id % 11 = 0 or event_id % 7 = 0 or event_id % 13 = 0)"
NOT_JSON_SQL = "'MalformedMessage: not a well-formed JSON document'"

MESSAGES_SQL = f"""messages as (
  select event_id as msg_id, 'user/' || user_id as topic, ts, event_id, user_id, event_type, value, props, {_BAD} as bad,
    case when event_id % 11 = 0 then '' when event_id % 7 = 0 then left(whole, len(whole) - 1)
      when event_id % 13 = 0 then whole || ' ' || whole else whole end as payload
  from (select *, {_PAYLOAD} as whole from events))"""

_EVENT = f"'<{EX}event/' || event_id || '> <{EX}'"
_FLAT_DOC = f"""'<{EX}event/' || event_id || '> <{RDF_TYPE}> <{EX}Event> .' || chr(10)
  || {_EVENT} || 'user> "' || user_id || '"^^<{XSD}integer> .' || chr(10)
  || {_EVENT} || 'type> "' || event_type || '" .' || chr(10)
  || coalesce({_EVENT} || 'value> "' || {VALUE} || '"^^<{XSD}decimal> .' || chr(10), '')
  || {_EVENT} || 'at> "' || {AT} || '"^^<{XSD}dateTime> .' || chr(10)
  || {_EVENT} || 'k> "' || {K} || '"^^<{XSD}integer> .' || chr(10)
  || {_EVENT} || 'page> <{EX}user/' || user_id || '/' || event_type || '> .' || chr(10)"""
_SHORT_DOC = f"""'<{EX}e/' || event_id || '> <{EX}type> "' || event_type || '" .' || chr(10)"""

FLOW_SQL = f"""{MESSAGES_SQL}, {fixtures.CHANNELS_SQL}, flow as (
  select m.*, c.*,
    case when mapping_id = 'identity' then payload when bad then null
      when mapping_id = 'flat' then {_FLAT_DOC} else {_SHORT_DOC} end as doc,
    case when mapping_id <> 'identity' and bad then {NOT_JSON_SQL} end as error
  from messages m join channels c on m.topic = c.input_topic where not is_stopped)"""

_KEY = "case when {0}_broker = 'KAFKA' then channel_id end as key"
_MARK = "'@' || topic || ':' || (epoch_us(ts) // 1000) as value"


def _record_sql(sink: str, value: str, where: str, extra: str = "") -> str:
    return f"""with {FLOW_SQL} select msg_id, channel_id, {sink}_broker as broker, {sink}_topic as topic,
      {_KEY.format(sink)}, {value}{extra} from flow where {where}"""


def _stream_sql() -> str:
    doc = f"""'<{EX}k/' || {K} || '> <{EX}k> "' || {K} || '"^^<{XSD}integer> .' || chr(10)"""
    flow = f"""{fixtures.CHANNELS_SQL}, flow as (
      select event_id::varchar as msg_id, 'user/' || user_id as topic, ts, c.*,
        case when mapping_id = 'identity' then props else {doc} end as doc
      from events join channels c on 'user/' || user_id = c.input_topic where not is_stopped)"""

    def part(sink: str, value: str, where: str) -> str:
        return f"""select msg_id, channel_id, '{sink}' as sink, {sink}_broker as broker, {sink}_topic as topic,
          {_KEY.format(sink)}, {value} from flow where {where}"""

    return f"with {flow} " + " union all ".join(
        [
            part("output", "doc as value", "true"),
            part("monitor_in", _MARK, "monitor_in_topic is not null and monitor_in_enabled"),
            part("monitor_out", _MARK, "monitor_out_topic is not null and monitor_out_enabled"),
        ]
    )


QUERIES = {
    "channel_flow": (_flow, f"with {FLOW_SQL} select msg_id, channel_id, doc, error from flow"),
    "channel_routing": (
        _routing,
        f"""with {MESSAGES_SQL}, {fixtures.CHANNELS_SQL}
        select msg_id, channel_id, topic, output_topic,
          case when monitor_in_enabled then monitor_in_topic end as monitor_in,
          case when monitor_out_enabled then monitor_out_topic end as monitor_out,
          case when error_enabled then error_topic end as error
        from messages join channels on topic = input_topic where not is_stopped""",
    ),
    "channel_identity": (_identity, f"with {MESSAGES_SQL} select msg_id, payload as doc, cast(null as varchar) as error from messages"),
    "output_records": (_records("output"), _record_sql("output", "doc as value", "error is null")),
    "channel_many_mappings": (
        _many_mappings,
        f"""select event_id as msg_id, 'm' || i as mapping_id,
          case when i < {MANY} then s || ' <{RDF_TYPE}> <{EX}Class' || (i % 3) || '> .' || chr(10)
            || s || ' <{EX}kind' || (i % 7) || '> "' || event_type || '" .' || chr(10)
            || s || ' <{EX}k> "' || {K} || '"^^<{XSD}integer> .' || chr(10) end as doc,
          case when i >= {MANY} then 'NoSuchMapping: m' || i end as error
        from (select *, event_id % {MANY + 1} as i, '<{EX}e' || (event_id % {MANY + 1}) || '/' || event_id || '>' as s from events)""",
    ),
    "channel_many_shapes": (
        _many_shapes,
        f"""select event_id as msg_id, 'm' || i as mapping_id, case i % 5
            when 0 then s || '/' || event_id || '> <{RDF_TYPE}> <{EX}Class' || (i % 3) || '> .' || chr(10)
              || s || '/' || event_id || '> <{EX}kind> "' || event_type || '" .' || chr(10)
            when 1 then s || '/' || event_type || '> <{EX}n> "1"^^<{XSD}integer> .' || chr(10) || s || '/' || u || '> <{EX}n> "2"^^<{XSD}integer> .' || chr(10)
            when 2 then '[{{"@id":"{EX}e' || i || '/' || event_id || '","@type":["{EX}Class' || (i % 3) || '"],"{EX}kind":[{{"@value":"' || event_type || '"}}]}}]'
            when 3 then s || '/' || event_id || '> <{EX}kind> "' || event_type || '" .' || chr(10)
            else s || '/' || event_type || b || s || '/' || u || b end as doc, cast(null as varchar) as error
        from (select *, event_id % {MANY} as i, '<{EX}e' || (event_id % {MANY}) as s, 'u' || (user_id % 10) as u,
          '> <{EX}of> _:b' || sha256(event_id || ':b' || event_id) || ' .' || chr(10) as b from events)""",
    ),
    "channel_xml_shapes": (
        _xml_shapes,
        f"""select p_partkey as msg_id, 'x' || i as mapping_id, case when i % 2 = 1
            then '[{{"@id":"{EX}x' || i || '/' || p_partkey || '","{EX}has":[{{"@value":"' || p_name || ' & <co>"}},{{"@value":"' || p_brand || '"}},{{"@value":"' || p_size || '"}}]}}]'
            else s || 'name> <{EX}value> "' || p_name || ' & <co>" .' || chr(10) || s || 'brand> <{EX}value> "' || p_brand || '" .' || chr(10)
              || s || 'size> <{EX}value> "' || p_size || '" .' || chr(10) end as doc, cast(null as varchar) as error
        from (select *, p_partkey % {MANY} as i, '<{EX}x' || (p_partkey % {MANY}) || '/' as s from part)""",
    ),
    "load_mapping_catalog": (
        _mapping_catalog,
        f"""select doc_id as msg_id, 'm' || doc_id as mapping_id,
          case when doc_id % 7 <> 0 then s || ' <{RDF_TYPE}> <{EX}' || source || '> .' || chr(10) || s || ' <{EX}text> "' || {_ESC} || '"@' || lang || ' .' || chr(10) end as doc,
          case when doc_id % 7 = 0 then 'MappingError: nothing is said about term map ''_:subject''' end as error
        from (select *, '<{EX}doc/' || doc_id || '>' as s from documents)""",
    ),
    "channel_order": (
        _order,
        f"""with {FLOW_SQL} select msg_id, channel_id, row_number() over (partition by channel_id order by msg_id) as rank
        from flow where error is null""",
    ),
    "monitor_in": (_records("monitor_in"), _record_sql("monitor_in", _MARK, "monitor_in_topic is not null and monitor_in_enabled")),
    "monitor_out": (
        _records("monitor_out"),
        _record_sql("monitor_out", _MARK, "error is null and monitor_out_topic is not null and monitor_out_enabled"),
    ),
    "error_records": (
        _error_records,
        _record_sql(
            "error",
            "'Failure(' || error || ')' as value",
            "error is not null and error_topic is not null and error_enabled",
            ", payload",
        ),
    ),
    "read_messages": (
        _read_messages,
        """select event_id::varchar as msg_id, 'user/' || user_id as topic, cast(null as varchar) as key, props as payload,
          (epoch_us(ts) // 1000) as ms from events
        union all select conv_id || '/' || turn, 'talk/' || role, conv_id::varchar, text, null from conversations""",
    ),
    "read_text_messages": (
        _text_messages,
        """select case when event_id % 2 = 0 then event_id::varchar else 'tick' end as payload,
          row_number() over (order by event_id) as rank, 1 as messages from events""",
    ),
    "sink_addresses": (
        _sink_addresses,
        f"""with {MESSAGES_SQL}, flow as (
          select msg_id, bad, c_custkey as c, 'ch-' || c_custkey as channel_id from messages join customer on topic = 'user/' || c_custkey)
        select msg_id, channel_id, 'output' as sink, case when c % 5 = 0 then 'MQTT' else 'KAFKA' end as broker,
          case when c % 5 = 0 then case when c % 2 = 0 then 'ssl://m:8883' else 'tcp://127.0.0.1:1883' end
            when c % 4 <> 0 then 'k' || (c % 3) || ':9092' else '127.0.0.1:9093' end as address, 'out/' || c as topic from flow where not bad
        union all select msg_id, channel_id, 'error', 'KAFKA', '127.0.0.1:9093', 'err/' || c from flow where bad and c % 3 <> 0""",
    ),
    "failure_counts": (
        _failure_counts,
        f"""with {FLOW_SQL} select channel_id, count(*) as failures,
          count(*) filter (where error_topic is null or not error_enabled) as failures_without_topic
        from flow where error is not null group by channel_id""",
    ),
    "channel_stream": (_stream, _stream_sql()),
    "dry_run": (
        _dry_run,
        f"""select p_partkey, mapping_id, error is null as ok,
          case when error is not null then null
            when mapping_id = 'parts' and sample is null then ''
            else '' end as doc, error
        from (
          select *, case when mapping_id = 'unknown' then 'NoSuchMapping: unknown'
            when sample is null then null
            when mapping_id = 'flat' then {NOT_JSON_SQL}
            when mapping_id = 'parts' then 'MalformedMessage: not a well-formed XML document'
            when sample = '' then 'java.lang.IllegalArgumentException: Empty input is not allowed!' end as error
          from (
            select p_partkey,
              case p_size % 4 when 0 then 'flat' when 1 then 'parts' when 2 then 'suppliers' else 'unknown' end as mapping_id,
              case when p_partkey % 2 = 0 then null when p_partkey % 3 = 0 then '' else p_name end as sample
            from part))""",
    ),
}
