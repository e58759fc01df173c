"""Definitions, settings, credentials, the catalog and the state log."""

import json
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tripleloom.operators import catalog, settings, state
from tripleloom.plans import mapping_queries as q

HARBOUR = {
    "metadata": {
        "name": "Harbour log",
        "description": "not a field of channel metadata",
        "tags": ["tide", "north"],
        "mapping": {"name": "Water rules", "tags": [], "inputFormat": "JSON", "outputFormat": "TTL", "rml": "rules é"},
    },
    "settings": {
        "inputTopicSettings": {
            "topic": "quay/water in", "brokerType": "MQTT",
            "mqttSettings": {"protocol": "tcp", "host": "h", "port": 1, "user": "usér", "password": "pw"},
        },
        "outputTopicSettings": {"topic": "quay/out", "brokerType": "KAFKA"},
        "errorTopicSettings": {"topic": "quay/err", "brokerType": "MQTT", "mqttSettings": {"protocol": "ssl", "host": "e", "port": 2}},
    },
    "status": {"inputTopicEnabled": True, "errorTopicEnabled": False, "outputMonitorTopicEnabled": False},
}


def read(spark, *definitions):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(definitions)]
    return settings.read_definitions(spark.createDataFrame(rows, "n int, definition string"))


def test_definition_defaults_and_spellings(spark):
    row = read(spark, HARBOUR).first()
    assert row.error is None
    assert row.status.asDict() == {
        "isStopped": False, "inputMonitoringTopicEnabled": True, "outputMonitoringTopicEnabled": False, "errorTopicEnabled": False, "error": None,
    }
    other = json.loads(json.dumps(HARBOUR))
    other["status"] = {"inputMonitoringTopicEnabled": False, "isStopped": True, "error": "x"}
    row = read(spark, other).first()
    assert (row.status.inputMonitoringTopicEnabled, row.status.isStopped, row.status.error) == (False, True, "x")


def test_definition_errors(spark):
    def without(*path):
        d = json.loads(json.dumps(HARBOUR))
        at = d
        for step in path[:-1]:
            at = at[step]
        del at[path[-1]]
        return d

    def with_value(value, *path):
        d = json.loads(json.dumps(HARBOUR))
        at = d
        for step in path[:-1]:
            at = at[step]
        at[path[-1]] = value
        return d

    rows = read(
        spark,
        without("settings", "inputTopicSettings", "topic"),
        without("metadata", "mapping", "rml"),
        with_value("N3", "metadata", "mapping", "outputFormat"),
        with_value("AMQP", "settings", "errorTopicSettings", "brokerType"),
        without("status"),
        "{",
    ).orderBy("n")
    errors = [r.error for r in rows.collect()]
    assert errors[:5] == [
        "WrongDefinition: settings.inputTopicSettings.topic",
        "WrongDefinition: metadata.mapping.rml",
        "WrongDefinition: metadata.mapping.outputFormat",
        "WrongDefinition: settings.errorTopicSettings.brokerType",
        None,
    ]
    assert errors[5].startswith("WrongDefinition")


def test_written_definitions_leave_out_what_is_empty(spark):
    written = json.loads(settings.write_definitions(read(spark, HARBOUR)).first().definition)
    assert written["metadata"]["tags"] == ["tide", "north"] and "tags" not in written["metadata"]["mapping"]
    assert "description" not in written["metadata"] and "author" not in written["metadata"]
    assert written["metadata"]["mapping"]["rmlHash"] == settings_hash("rules é")
    assert "monitorInputTopicSettings" not in written["settings"]
    again = read(spark, written).first()
    assert again.settings == read(spark, HARBOUR).first().settings


def settings_hash(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest().upper()


def test_generated_ids(spark):
    own = json.loads(json.dumps(HARBOUR))
    own["settings"]["channelId"] = "mine"
    other = json.loads(json.dumps(HARBOUR))
    other["settings"]["outputTopicSettings"]["topic"] = "quay/o u t"
    ids = [r.channel_id for r in settings.with_channel_id(read(spark, HARBOUR, own, other, HARBOUR)).orderBy("n").collect()]
    assert ids[1] == "mine" and ids[0] == ids[3] != ids[2]
    assert ids[0].startswith("quay/waterin_quay/out_MQTT_KAFKA_") and ids[2].startswith("quay/waterin_quay/out_MQTT_KAFKA_")


def test_resolved_settings(spark):
    defaults = settings.Defaults(
        roles=tuple((r, settings.BrokerDefaults(kafka_host=f"k-{r}", mqtt_client_id=f"cl-{r}")) for r in settings.ROLES), buffer_size=5
    )
    rows = settings.resolve_settings(settings.with_channel_id(read(spark, HARBOUR)), defaults)
    s = rows.first().settings
    assert s.inputTopicSettings.kafkaSettings.host == "k-input" and s.outputTopicSettings.kafkaSettings.port == 9093
    assert s.inputTopicSettings.mqttSettings.host == "h" and s.inputTopicSettings.mqttSettings.clientId == "cl-input"
    assert s.errorTopicSettings.mqttSettings.protocol == "ssl" and s.errorTopicSettings.mqttSettings.user is None
    assert s.monitorInputTopicSettings is None and (s.parallelism, s.bufferSize) == (2, 5)
    assert s.outputTopicSettings.kafkaSettings.groupId == "group_" + s.channelId
    flat = settings.channel_table(rows.withColumn("mapping_id", F.lit("m"))).first()
    assert (flat.input_topic, flat.output_broker, flat.monitor_in_topic, flat.error_enabled) == ("quay/water in", "KAFKA", None, False)


@pytest.mark.parametrize("key", ["short", "exactly 16 chars", "a key of thirty-two characters.."])
def test_credentials(spark, key):
    clear = read(spark, HARBOUR)
    # the initialisation vector is random, so both values are taken from one evaluation
    locked = settings.encrypt_credentials(clear, key).select("settings").collect()
    mqtt = locked[0].settings.inputTopicSettings.mqttSettings
    assert mqtt.user != "usér" and mqtt.host == "h"
    assert locked[0].settings.errorTopicSettings.mqttSettings.user is None
    assert locked[0].settings.monitorInputTopicSettings is None
    opened = settings.decrypt_credentials(spark.createDataFrame(locked, clear.select("settings").schema), key).first()
    assert opened.settings == clear.first().settings


def test_register(spark):
    requests = spark.createDataFrame(
        [("a", 1, "flat"), ("a", 2, "flat"), ("b", 3, "gone"), ("b", 4, "flat"), ("old", 5, "flat")], "channel_id string, seq long, mapping_id string"
    )
    known = spark.createDataFrame([("old",), ("older",)], "channel_id string")
    got = {r.seq: (r.accepted, r.reason) for r in catalog.register_channels(requests, known, {"flat": q.FLAT}).collect()}
    assert got == {
        1: (True, None),
        2: (False, "NonUniqueChannelIdException: a"),
        3: (False, "RMLMappingException: NoSuchMapping: gone"),
        4: (True, None),
        5: (False, "NonUniqueChannelIdException: old"),
    }


def test_register_reads_the_requests_twice(spark, tmp_path):
    for name, rows in (("requests", [("a", 1, "flat")]), ("known", [("b", 1, "flat")])):
        spark.createDataFrame(rows, "channel_id string, seq long, mapping_id string").write.parquet(str(tmp_path / name))
    requests, known = (spark.read.parquet(str(tmp_path / name)) for name in ("requests", "known"))
    plan = catalog.register_channels(requests, known, {"flat": q.FLAT})._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^\]]*mapping_id", plan)) == 2 and plan.count("Exchange hashpartitioning") <= 5


def test_listings_read_only_what_is_asked(spark, tmp_path):
    path = str(tmp_path / "definitions")
    settings.with_channel_id(read(spark, HARBOUR)).write.parquet(path)
    table = spark.read.parquet(path)
    assert catalog.list_channels(table).columns == ["channel_id"]
    assert catalog.list_channels(table, status=True, settings=True).columns == ["channel_id", "status", "settings"]
    header = catalog.list_channels(table, metadata=True).first().metadata.mapping
    assert "rml" not in header.asDict() and header.rmlHash == settings_hash("rules é")
    full = catalog.list_channels(table, include_all=True).first()
    assert full.metadata.mapping.rml == "rules é" and full.settings is not None
    plan = catalog.list_channels(table, status=True)._jdf.queryExecution().executedPlan().toString()
    assert "rml" not in plan


def test_find_and_remove(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    ids = spark.createDataFrame([("b",), ("c",), ("b",)], "id string")
    assert sorted((r.id, r.v, r.error) for r in catalog.find(table, ids, "id").collect()) == [("b", 2, None), ("c", None, "No entry with ID: c")]
    assert [r.id for r in catalog.remove(table, ids, "id").collect()] == ["a"]
    assert sorted(map(tuple, catalog.remove_report(table, ids, "id").collect())) == [("b", True), ("c", False)]


def test_mapping_catalog(spark):
    table = catalog.with_mapping_id(spark.createDataFrame([("x", "text")], "name string, rml string"))
    assert len(table.first().mapping_id) == 24
    assert catalog.list_mappings(table).columns == ["mapping_id"]
    assert catalog.list_mappings(table, rml=True).columns == ["mapping_id"]
    assert catalog.list_mappings(table, header=True).columns == ["mapping_id", "name", "rml_hash"]
    assert catalog.list_mappings(table, header=True, rml=True).columns == ["mapping_id", "name", "rml", "rml_hash"]
    assert catalog.list_mappings(table, header=True).first().rml_hash == settings_hash("text") == q.Mapping("m", q.FLAT.triples_maps, rml="text").rml_hash


# --- the state log ------------------------------------------------------------------------------

LOG = "channel_id string, seq long, action string, is_stopped boolean, monitor_in_enabled boolean, monitor_out_enabled boolean, error_enabled boolean, error string"


def event(channel_id, seq, action, stop=None, mon_in=None, mon_out=None, err=None, error=None):
    return (channel_id, seq, action, stop, mon_in, mon_out, err, error)


def test_fold(spark):
    log = spark.createDataFrame(
        [
            event("a", 1, "add"), event("a", 2, "update", mon_in=False), event("a", 3, "failed", error="boom"),
            event("b", 1, "add", stop=True), event("b", 2, "failed", error="old"), event("b", 3, "restart"),
            event("c", 1, "add", err=False), event("c", 2, "remove"),
            event("d", 1, "add", mon_out=False), event("d", 2, "remove"), event("d", 3, "add"), event("d", 4, "completed"),
            event("e", 1, "update", mon_in=False),
            event("f", 1, "add"), event("f", 2, "failed", error="x"), event("f", 3, "update", stop=False),
        ],
        LOG,
    )
    got = {r.channel_id: tuple(r)[1:6] for r in state.current_state(log).collect()}
    assert got == {
        "a": (True, False, True, True, "boom"),
        "b": (False, True, True, True, None),
        "d": (True, True, True, True, None),
        "f": (False, True, True, True, None),
    }


def test_report_restore_and_completion(spark):
    log = spark.createDataFrame([event("a", 1, "add"), event("b", 1, "add", stop=True)], LOG)
    log = log.unionByName(state.completion_events(spark.createDataFrame([("b",)], "channel_id string"), 2, "RuntimeError: x"))
    now = state.current_state(log)
    topics = spark.createDataFrame(
        [("a", "x", None, None), ("b", None, "y", "z")], "channel_id string, monitor_in_topic string, monitor_out_topic string, error_topic string"
    )
    report = {r.channel_id: tuple(r)[1:] for r in state.status_report(now, topics).collect()}
    assert report == {"a": (False, True, None, None, None), "b": (True, None, True, True, "RuntimeError: x")}
    assert {r.channel_id: (r.is_stopped, r.start) for r in state.to_restore(now).collect()} == {"a": (True, True), "b": (True, False)}
    assert {r.start for r in state.to_restore(now, restore_stopped=True).collect()} == {False}


def random_log(n, channels, seed=7):
    """One channel owns a third of all events."""
    rng = random.Random(seed)
    flag = lambda: rng.choice([None, None, True, False])
    rows = []
    for seq in range(n):
        name = "hot" if seq % 3 == 0 else f"c{rng.randrange(channels)}"
        action = rng.choices(["add", "update", "restart", "completed", "failed", "remove"], [2, 6, 1, 1, 1, 1])[0]
        rows.append(event(name, seq, action, flag(), flag(), flag(), flag(), f"E{seq}" if action == "failed" else None))
    return rows


def replay(rows, topics):
    """The reference semantics, one event at a time."""
    now, changes = {}, []
    for channel_id, seq, action, stop, mon_in, mon_out, err, error in sorted(rows, key=lambda r: r[1]):
        asked = {"monitor_in": mon_in, "monitor_out": mon_out, "error_topic": err}
        if action == "update":
            made = {}
            if channel_id in now:
                st = now[channel_id]
                for name, value in asked.items():
                    if value is not None and name in topics[channel_id] and value != st[name]:
                        made[name] = value
                if stop is not None and stop != st["stopped"]:
                    made["running"] = not stop
                # the log keeps what was asked; flags of absent topics are never shown
                st.update({k: v for k, v in asked.items() if v is not None})
                if stop is not None:
                    st["stopped"] = stop
                    st["error"] = st["error"] if stop else None
            changes.append((channel_id, seq, *(made.get(k) for k in ("running", "monitor_in", "monitor_out", "error_topic"))))
        elif action == "add":
            now[channel_id] = {
                "stopped": bool(stop), "error": None, "monitor_in": mon_in is not False, "monitor_out": mon_out is not False, "error_topic": err is not False,
            }
        elif action == "remove":
            now.pop(channel_id, None)
        elif channel_id in now:
            now[channel_id]["stopped"] = action != "restart"
            if action != "completed":
                now[channel_id]["error"] = error if action == "failed" else None
    return now, changes


@pytest.mark.parametrize("span", [7, 100, 10_000])
def test_changes_and_state_against_replay(spark, span):
    rows = random_log(900, 8)
    names = sorted({r[0] for r in rows})
    topics = {n: [t for i, t in enumerate(("monitor_in", "monitor_out", "error_topic")) if (k >> i) & 1] for k, n in enumerate(names)}
    table = spark.createDataFrame(
        [(n, *("t" if t in topics[n] else None for t in ("monitor_in", "monitor_out", "error_topic"))) for n in names],
        "channel_id string, monitor_in_topic string, monitor_out_topic string, error_topic string",
    )
    log = spark.createDataFrame(rows, LOG)
    now, changes = replay(rows, topics)
    got = state.status_changes(log, table, span).collect()
    assert sorted((r.channel_id, r.seq, r.running, r.monitor_in, r.monitor_out, r.error_topic) for r in got) == sorted(changes)
    folded = {r.channel_id: (r.is_stopped, r.monitor_in_enabled, r.monitor_out_enabled, r.error_enabled, r.error) for r in state.current_state(log).collect()}
    assert folded == {k: (v["stopped"], v["monitor_in"], v["monitor_out"], v["error_topic"], v["error"]) for k, v in now.items()}


def test_state_follows_the_log(spark, tmp_path):
    """Runs over parts of a log, in any order, with snapshots: the state of the whole log; each run reads its part alone."""
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    rows = [(f"c{i % 7}", i, random.choice(["add", "update", "update", "failed", "completed", "restart", "remove"]), random.choice([None, True, False]),
             random.choice([None, True]), None, random.choice([None, False]), random.choice([None, f"e{i}"])) for i in range(300)]
    random.shuffle(rows)
    schema = "channel_id string, seq long, action string, is_stopped boolean, monitor_in_enabled boolean, monitor_out_enabled boolean, error_enabled boolean, error string"
    for n, part in enumerate((rows[:120], rows[120:130], rows[130:130], rows[130:])):
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(log)
        query = state.follow(spark.readStream.schema(schema).parquet(log), out, checkpoint, snapshot_every=2)
        query.awaitTermination()
        assert sum(p.numInputRows for p in query.recentProgress) == len(part)
        want = state.current_state(spark.read.parquet(log)).collect()
        assert sorted(map(tuple, state.followed_state(spark, out).collect())) == sorted(map(tuple, want)) and (n or want)
    assert state.followed_state(spark, out).columns == state.current_state(spark.read.parquet(log)).columns


def test_carry_over_equals_one_window(spark):
    log = spark.createDataFrame(random_log(500, 5), LOG)
    whole = Window.partitionBy("channel_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    want = log.withColumn("before", F.last("error_enabled", ignorenulls=True).over(whole)).select("channel_id", "seq", "before").collect()
    for span in (1, 13, 1000):
        got = state.last_before(log, ["error_enabled"], span, 3).select("channel_id", "seq", "before_error_enabled").collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_state_feeds_the_channels(spark):
    table = spark.createDataFrame([("a", False, True, True, True), ("gone", False, True, True, True)], "channel_id string, is_stopped boolean, monitor_in_enabled boolean, monitor_out_enabled boolean, error_enabled boolean")
    log = spark.createDataFrame([event("a", 1, "add"), event("a", 2, "update", mon_out=False)], LOG)
    rows = state.apply_state(table, state.current_state(log)).collect()
    assert [(r.channel_id, r.monitor_out_enabled) for r in rows] == [("a", False)]
