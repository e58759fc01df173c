"""Message, channel and mapping tables derived row by row from the given tables.

Nothing here groups or joins: a payload is built from its own row, so no key can make a message grow
without bound and the tables scale with their input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.session import prepare
from tripleloom.vocab import QL, RDF_TYPE, RML, RR, STREAM


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows become messages."""
    return table(spark, sf_dir, name)


def money(c: str) -> Column:
    return F.format_string("%.2f", F.col(c))


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def event_payload(*extra: Column) -> Column:
    """Flat JSON object; a sign-up carries no value."""
    return F.to_json(
        F.struct(
            "event_id",
            "user_id",
            "event_type",
            F.when(F.col("event_type") != "signup", money("value")).alias("value"),
            _iso("ts").alias("at"),
            F.from_json("props", "k bigint").alias("props"),
            *extra,
        )
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id").alias("msg_id"),
        F.concat(F.lit("events/"), "event_type").alias("topic"),
        event_payload().alias("payload"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def tagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag is an array (with a repeated entry), or for some events a plain text in brackets."""
    as_array = F.to_json(
        F.struct(
            "event_id",
            F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")), "event_type").alias("tag"),
        )
    )
    as_text = F.to_json(F.struct("event_id", F.concat(F.lit("["), "event_type", F.lit("]")).alias("tag")))
    return messages(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"),
        F.when(F.col("event_id") % 3 == 0, as_text).otherwise(as_array).alias("payload"),
    )


def several_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrays, one of which is for some events a single value and for others missing."""
    part = F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string"))
    tag = F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")))
    as_array = F.to_json(F.struct("event_id", tag.alias("tag"), F.array(F.lit("a"), part).alias("part")))
    as_text = F.to_json(F.struct("event_id", tag.alias("tag"), F.when(F.col("event_id") % 5 != 0, "a").alias("part")))
    return messages(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"), F.when(F.col("event_id") % 3 == 0, as_text).otherwise(as_array).alias("payload")
    )


def broken_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 11th payload is empty, every 7th cut short, every 13th followed by a second document."""
    rows = messages(spark, sf_dir, "events")
    whole = event_payload()
    payload = (
        F.when(F.col("event_id") % 11 == 0, F.lit(""))
        .when(F.col("event_id") % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1))
        .when(F.col("event_id") % 13 == 0, F.concat(whole, F.lit(" "), whole))
        .otherwise(whole)
    )
    return rows.select(
        F.col("event_id").alias("msg_id"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("topic"),
        payload.alias("payload"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order with an array of facts and the units they are given in."""
    rows = messages(spark, sf_dir, "orders")

    def fact(n: int, name: str, value: Column, unit: str) -> Column:
        return F.struct(F.lit(n).alias("n"), F.lit(name).alias("name"), value.alias("value"), F.lit(unit).alias("unit"))

    def unit(code: str, label: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"))

    facts = F.array(
        fact(1, "status", F.col("o_orderstatus"), "code"),
        fact(2, "total", money("o_totalprice"), "money"),
        fact(3, "priority", F.col("o_orderpriority"), "code"),
        fact(4, "date", F.date_format("o_orderdate", "yyyy-MM-dd"), "none"),
    )
    payload = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("key"),
            F.struct(F.col("o_custkey").alias("key")).alias("customer"),
            facts.alias("facts"),
            F.array(unit("code", "a code"), unit("money", "an amount")).alias("units"),
        )
    )
    return rows.select(F.col("o_orderkey").alias("msg_id"), F.lit("orders").alias("topic"), payload.alias("payload"))


def sectioned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order in two sections, each with its facts and its tags."""

    def facts(**values: Column) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("n"), v.alias("v")) for n, v in values.items()])

    def section(name: str, of: Column, *tags: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), of.alias("facts"), F.array(*[F.struct(t.alias("t")) for t in tags]).alias("tags"))

    state = section("state", facts(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")), F.lit("a"), F.col("o_orderstatus"))
    money_ = section("money", facts(total=money("o_totalprice")), F.lit("c"))
    payload = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.array(state, money_).alias("sections")))
    return messages(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("msg_id"), payload.alias("payload"))


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with money as JSON numbers, two decimals each, as fields and as array elements."""
    rows = messages(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    payload = F.concat(
        F.lit('{"line":"'), key, F.lit('","price":'), money("l_extendedprice"), F.lit(',"rates":['), money("l_discount"),
        F.lit(","), money("l_tax"), F.lit('],"count":'), F.col("l_quantity").cast("long").cast("string"), F.lit("}"),
    )
    return rows.select(key.alias("msg_id"), payload.alias("payload"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    return messages(spark, sf_dir, "customer").select(F.col("c_custkey").alias("msg_id"), payload.alias("payload"))


def customers_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root array: one object per attribute of a customer."""

    def entry(field: str, value: Column) -> Column:
        return F.struct(F.col("c_custkey").alias("key"), F.lit(field).alias("field"), value.alias("value"))

    payload = F.to_json(
        F.array(
            entry("name", F.col("c_name")),
            entry("segment", F.col("c_mktsegment")),
            entry("balance", money("c_acctbal")),
        )
    )
    return messages(spark, sf_dir, "customer").select(F.col("c_custkey").alias("msg_id"), payload.alias("payload"))


def _xml_text(c: Column) -> Column:
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(written))
    return c


def parts_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML with a prolog, an attribute and a repeated element."""

    def attr(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'<attr kind="{name}"><value>'), _xml_text(value), F.lit("</value></attr>"))

    payload = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8" ?>\n<part key="'),
        F.col("p_partkey").cast("string"),
        F.lit('">'),
        attr("name", F.concat("p_name", F.lit(" & <co>"))),
        attr("brand", F.col("p_brand")),
        attr("size", F.col("p_size").cast("string")),
        F.lit("<note/></part>"),
    )
    return messages(spark, sf_dir, "part").select(F.col("p_partkey").alias("msg_id"), payload.alias("payload"))


def broken_parts_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 5th document loses its last character, every 7th has a second root, every 11th text behind it."""
    key = F.col("msg_id")
    payload = F.col("payload")
    return parts_xml(spark, sf_dir).withColumn(
        "payload",
        F.when(key % 5 == 0, F.substring(payload, F.lit(1), F.length(payload) - 1))
        .when(key % 7 == 0, F.concat(payload, F.lit("<part/>")))
        .when(key % 11 == 0, F.concat(payload, F.lit("tail")))
        .when(key % 13 == 0, F.concat(payload, F.lit("\n<!-- end -->\n")))
        .otherwise(payload),
    )


def suppliers_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with a header, a quoted cell that holds a comma and quotes, and an empty cell."""
    key = F.col("s_suppkey").cast("string")
    payload = F.concat(
        F.lit("key,field,value,remark\n"),
        key, F.lit(',name,"'), F.col("s_name"), F.lit(', ""Ltd""",\n'),
        key, F.lit(",nation,"), F.col("s_nationkey").cast("string"), F.lit(",home\n"),
        key, F.lit(",balance, "), money("s_acctbal"), F.lit(" ,\n"),
    )
    return messages(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("msg_id"), payload.alias("payload"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document with its whole text and an array of its lines."""
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("n"), t.alias("text")))
    payload = F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", "source", "text", lines.alias("lines")))
    return messages(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), payload.alias("payload"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel per customer, and one per supplier on the same topics."""
    customer = table(spark, sf_dir, "customer").selectExpr(
        "concat('cu-', c_custkey) as channel_id",
        "concat('user/', c_custkey) as input_topic",
        "concat('out/', lower(c_mktsegment), '/', c_custkey) as output_topic",
        "if(c_custkey % 2 = 0, 'KAFKA', 'MQTT') as output_broker",
        "if(c_nationkey % 2 = 0, concat('mon/in/', c_custkey), null) as monitor_in_topic",
        "'MQTT' as monitor_in_broker",
        "if(c_nationkey % 3 = 0, concat('mon/out/', c_custkey), null) as monitor_out_topic",
        "'KAFKA' as monitor_out_broker",
        "if(c_nationkey % 4 <> 0, concat('err/', c_custkey), null) as error_topic",
        "if(c_custkey % 3 = 0, 'KAFKA', 'MQTT') as error_broker",
        "case c_custkey % 3 when 0 then 'flat' when 1 then 'short' else 'identity' end as mapping_id",
        "c_acctbal < 0 as is_stopped",
        "c_custkey % 5 <> 0 as monitor_in_enabled",
        "c_custkey % 7 <> 0 as monitor_out_enabled",
        "c_custkey % 11 <> 0 as error_enabled",
    )
    supplier = table(spark, sf_dir, "supplier").selectExpr(
        "concat('su-', s_suppkey) as channel_id",
        "concat('user/', s_suppkey) as input_topic",
        "concat('copy/', s_suppkey) as output_topic",
        "'KAFKA' as output_broker",
        "cast(null as string) as monitor_in_topic",
        "cast(null as string) as monitor_in_broker",
        "cast(null as string) as monitor_out_topic",
        "cast(null as string) as monitor_out_broker",
        "cast(null as string) as error_topic",
        "cast(null as string) as error_broker",
        "'short' as mapping_id",
        "false as is_stopped",
        "true as monitor_in_enabled",
        "true as monitor_out_enabled",
        "true as error_enabled",
    )
    return customer.unionByName(supplier)


# The same table for the oracle, as a common table expression.
CHANNELS_SQL = """channels as (
  select 'cu-' || c_custkey as channel_id, 'user/' || c_custkey as input_topic,
    'out/' || lower(c_mktsegment) || '/' || c_custkey as output_topic,
    case when c_custkey % 2 = 0 then 'KAFKA' else 'MQTT' end as output_broker,
    case when c_nationkey % 2 = 0 then 'mon/in/' || c_custkey end as monitor_in_topic, 'MQTT' as monitor_in_broker,
    case when c_nationkey % 3 = 0 then 'mon/out/' || c_custkey end as monitor_out_topic, 'KAFKA' as monitor_out_broker,
    case when c_nationkey % 4 <> 0 then 'err/' || c_custkey end as error_topic,
    case when c_custkey % 3 = 0 then 'KAFKA' else 'MQTT' end as error_broker,
    case c_custkey % 3 when 0 then 'flat' when 1 then 'short' else 'identity' end as mapping_id,
    c_acctbal < 0 as is_stopped, c_custkey % 5 <> 0 as monitor_in_enabled,
    c_custkey % 7 <> 0 as monitor_out_enabled, c_custkey % 11 <> 0 as error_enabled
  from customer
  union all
  select 'su-' || s_suppkey, 'user/' || s_suppkey, 'copy/' || s_suppkey, 'KAFKA', null, null, null, null, null, null,
    'short', false, true, true, true from supplier)"""


def channel_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a log of what happened to channels: user = channel, event type = action."""
    e, none = "event_id", "cast(null as boolean)"
    return table(spark, sf_dir, "events").selectExpr(
        "concat('u', user_id) as channel_id",
        "event_id as seq",
        f"""case event_type when 'signup' then 'add' when 'click' then 'update' when 'view' then 'update'
            when 'purchase' then case {e} % 3 when 0 then 'restart' when 1 then 'completed' else 'update' end
            else if({e} % 6 = 0, 'remove', 'failed') end as action""",
        f"""case when event_type = 'signup' then {e} % 4 = 0
            when event_type = 'purchase' and {e} % 3 = 2 then {e} % 2 = 0 else {none} end as is_stopped""",
        f"case when event_type = 'click' and {e} % 13 <> 0 then {e} % 2 = 0 else {none} end as monitor_in_enabled",
        f"case when event_type = 'view' then {e} % 3 = 0 else {none} end as monitor_out_enabled",
        f"case when event_type = 'view' then {e} % 5 = 0 else {none} end as error_enabled",
        f"if(event_type = 'error' and {e} % 6 <> 0, concat('E', {e}), null) as error",
    )


# The effects of that log for the oracle: what every event sets.
LOG_SQL = """raw_log as (
  select 'u' || user_id as channel_id, event_id as seq, event_id as e,
    case event_type when 'signup' then 'add' when 'click' then 'update' when 'view' then 'update'
      when 'purchase' then case event_id % 3 when 0 then 'restart' when 1 then 'completed' else 'update' end
      else case when event_id % 6 = 0 then 'remove' else 'failed' end end as action,
    case when event_type = 'signup' then event_id % 4 = 0
      when event_type = 'purchase' and event_id % 3 = 2 then event_id % 2 = 0 end as ask_stop,
    case when event_type = 'click' and event_id % 13 <> 0 then event_id % 2 = 0 end as ask_in,
    case when event_type = 'view' then event_id % 3 = 0 end as ask_out,
    case when event_type = 'view' then event_id % 5 = 0 end as ask_err
  from events),
log as (
  select *,
    case action when 'restart' then false when 'completed' then true when 'failed' then true else ask_stop end as f_stop,
    case action when 'add' then true else ask_in end as f_in,
    case action when 'add' then true else ask_out end as f_out,
    case action when 'add' then true else ask_err end as f_err,
    case when action = 'add' or action = 'restart' or (action = 'update' and ask_stop = false) then ''
      when action = 'failed' then 'E' || e end as f_error,
    case action when 'add' then true when 'remove' then false end as f_present
  from raw_log)"""

STATE_SQL = """state as (
  select channel_id,
    arg_max(f_stop, seq) filter (where f_stop is not null) as is_stopped,
    arg_max(f_in, seq) filter (where f_in is not null) as monitor_in_enabled,
    arg_max(f_out, seq) filter (where f_out is not null) as monitor_out_enabled,
    arg_max(f_err, seq) filter (where f_err is not null) as error_enabled,
    nullif(arg_max(f_error, seq) filter (where f_error is not null), '') as error,
    max(seq) as last_seq
  from log group by channel_id
  having arg_max(f_present, seq) filter (where f_present is not null))"""


def log_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels of that log, some without monitor or error topics."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('u', c_custkey) as channel_id",
        "if(c_nationkey % 2 = 0, concat('mon/in/', c_custkey), null) as monitor_in_topic",
        "if(c_nationkey % 3 = 0, concat('mon/out/', c_custkey), null) as monitor_out_topic",
        "if(c_nationkey % 4 <> 0, concat('err/', c_custkey), null) as error_topic",
    )


def mapping_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of stored mappings; the text of a document stands for the mapping text."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('m', doc_id) as mapping_id",
        "concat('mapping ', doc_id) as name",
        "source as author",
        "if(doc_id % 2 = 0, 'v1', null) as version",
        "array(lang, source) as tags",
        "case doc_id % 3 when 0 then 'JSON' when 1 then 'XML' else 'CSV' end as input_format",
        "if(doc_id % 2 = 0, 'TTL', 'JSONLD') as output_format",
        "text as rml",
    )


def placed_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel definitions that read the topic of a user; some name the servers of their own topics."""
    c = F.col("c_custkey")

    def topic(prefix: str, broker: Column, *servers: Column) -> Column:
        return F.struct(F.concat(F.lit(prefix), c.cast("string")).alias("topic"), broker.alias("brokerType"), *servers)

    kafka = F.when(c % 4 != 0, F.struct(F.concat(F.lit("k"), c % 3).alias("host"), F.lit(9092).alias("port")))
    mqtt = F.when(c % 2 == 0, F.struct(F.lit("ssl").alias("protocol"), F.lit("m").alias("host"), F.lit(8883).alias("port")))
    settings = F.struct(
        F.concat(F.lit("ch-"), c).alias("channelId"),
        topic("user/", F.lit("MQTT")).alias("inputTopicSettings"),
        topic("out/", F.when(c % 5 == 0, "MQTT").otherwise("KAFKA"), kafka.alias("kafkaSettings"), mqtt.alias("mqttSettings")).alias("outputTopicSettings"),
        F.when(c % 3 != 0, topic("err/", F.lit("KAFKA"))).alias("errorTopicSettings"),
    )
    mapping = F.struct(F.lit("JSON").alias("inputFormat"), F.lit("TTL").alias("outputFormat"), F.lit("rules").alias("rml"))
    body = F.to_json(F.struct(settings.alias("settings"), F.struct(mapping.alias("mapping")).alias("metadata")))
    return table(spark, sf_dir, "customer").select(body.alias("definition"))


def rule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples of one rule document per document: its text, tagged with its language, and its source as a class. Every seventh lacks its subject's template."""
    node = lambda name: F.lit(f"_:{name}")
    said = [
        (F.lit("urn:doc"), RML + "logicalSource", node("source"), "bnode"),
        (node("source"), RML + "referenceFormulation", F.lit(QL + "JSONPath"), "iri"),
        (node("source"), RML + "iterator", F.lit("$"), "literal"),
        (node("source"), RML + "source", node("stream"), "bnode"),
        (node("stream"), RDF_TYPE, F.lit(STREAM), "iri"),
        (F.lit("urn:doc"), RR + "subjectMap", node("subject"), "bnode"),
        (node("subject"), RR + "template", F.when(F.col("doc_id") % 7 != 0, "http://example.com/doc/{id}"), "literal"),
        (node("subject"), RR + "class", F.concat(F.lit("http://example.com/"), "source"), "iri"),
        (F.lit("urn:doc"), RR + "predicateObjectMap", node("says"), "bnode"),
        (node("says"), RR + "predicate", F.lit("http://example.com/text"), "iri"),
        (node("says"), RR + "objectMap", node("text"), "bnode"),
        (node("text"), RML + "reference", F.lit("text"), "literal"),
        (node("text"), RR + "language", F.col("lang"), "literal"),
    ]
    rows = F.array(*[F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind")) for s, p, o, k in said])
    triples = table(spark, sf_dir, "documents").select(F.concat(F.lit("m"), "doc_id").alias("mapping_id"), F.explode(rows).alias("t"))
    return triples.select("mapping_id", "t.*").where("o is not null")


def documents_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("doc_id").alias("id"), "text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), F.concat(F.lit("m"), "doc_id").alias("mapping_id"), payload.alias("payload"))


def shaped_events(spark: SparkSession, sf_dir: str, mappings: int) -> DataFrame:
    """Events in the form that their mapping, one of so many by number, reads: CSV for the third of every five, else JSON with arrays."""
    number, user = F.col("event_id") % mappings, F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))
    item = lambda n, v: F.struct(F.lit(n).alias("n"), v.alias("v"))
    as_json = F.to_json(F.struct("event_id", "event_type", F.array("event_type", user).alias("tags"), F.array(item(1, F.col("event_type")), item(2, user)).alias("items")))
    as_csv = F.concat(F.lit("event_id,kind\n"), F.col("event_id").cast("string"), F.lit(',"'), "event_type", F.lit('"\n'))
    return messages(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"), F.concat(F.lit("m"), number.cast("string")).alias("mapping_id"), F.when(number % 5 == 3, as_csv).otherwise(as_json).alias("payload")
    )


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel definitions as JSON text, one per customer; optional parts come and go."""
    c = F.col("c_custkey")

    def topic(prefix: str, *more: Column) -> Column:
        return F.struct(
            F.concat(F.lit(prefix + "/a b/"), c.cast("string")).alias("topic"),
            F.when(c % 2 == 0, F.lit("KAFKA")).otherwise(F.lit("MQTT")).alias("brokerType"),
            *more,
        )

    kafka = F.when(
        c % 3 == 0,
        F.struct(F.lit("k.example.com").alias("host"), F.lit(9092).alias("port"), F.when(c % 6 == 0, F.concat(F.lit("g"), c)).alias("groupId")),
    )
    mqtt = F.when(
        c % 4 == 0,
        F.struct(
            F.lit("ssl").alias("protocol"), F.lit("m.example.com").alias("host"), F.lit(8883).alias("port"),
            F.col("c_name").alias("user"), F.concat(F.lit("pw é "), F.col("c_mktsegment")).alias("password"),
        ),
    )
    settings = F.struct(
        F.when(c % 5 == 0, F.concat(F.lit("own-"), c)).alias("channelId"),
        topic("in", kafka.alias("kafkaSettings"), mqtt.alias("mqttSettings")).alias("inputTopicSettings"),
        topic("out").alias("outputTopicSettings"),
        F.when(F.col("c_nationkey") % 2 == 0, topic("err", mqtt.alias("mqttSettings"))).alias("errorTopicSettings"),
        F.when(c % 7 == 0, F.lit(8)).alias("parallelism"),
    )
    metadata = F.struct(
        F.col("c_name").alias("name"),
        F.struct(
            F.array(F.col("c_mktsegment")).alias("tags"),
            F.when(c % 10 == 9, F.lit("YAML")).otherwise(F.lit("JSON")).alias("inputFormat"),
            F.lit("TTL").alias("outputFormat"),
            F.concat(F.lit("rules of "), F.col("c_name")).alias("rml"),
        ).alias("mapping"),
        F.lit("ignored").alias("unknownKey"),
    )
    status = F.when(
        c % 2 == 0,
        F.struct((c % 4 == 0).alias("isStopped"), F.when(c % 6 == 0, F.lit(False)).alias("inputMonitorTopicEnabled")),
    )
    body = F.to_json(F.struct(settings.alias("settings"), metadata.alias("metadata"), status.alias("status")))
    return table(spark, sf_dir, "customer").select("c_custkey", body.alias("definition"))
