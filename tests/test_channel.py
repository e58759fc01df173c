"""Channels in batch and as a stream, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tripleloom import Mapping, TriplesMap, po, reference, template
from tripleloom.operators.dryrun import SAMPLES, apply_by_id, dry_run
from tripleloom.plans import mapping_queries as q
from tripleloom.sources import messages as src
from tripleloom.streaming import channel
from tripleloom.vocab import XSD

EX = "http://example.com/"
M = Mapping("m", (TriplesMap("t", template(EX + "{id}"), (po(EX + "v", reference("v")),)),))
ROW = {
    "channel_id": "c1", "input_topic": "in", "output_topic": "out", "output_broker": "KAFKA",
    "monitor_in_topic": "mi", "monitor_in_broker": "MQTT", "monitor_out_topic": "mo", "monitor_out_broker": "KAFKA",
    "error_topic": "err", "error_broker": "KAFKA", "mapping_id": "m", "is_stopped": False,
    "monitor_in_enabled": True, "monitor_out_enabled": True, "error_enabled": True,
}
GOOD, BAD = '{"id":"1","v":"x"}', '{"id":"1"'


def channels(spark, *rows):
    names = [f.split(" ")[0] for f in channel.CHANNEL_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**ROW, **r}[n] for n in names) for r in rows], channel.CHANNEL_SCHEMA)


def inbox(spark, *payloads, topic="in"):
    rows = [(str(i), topic, None, p) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "msg_id string, topic string, key string, payload string")
    return df.withColumn("ts", F.timestamp_millis(F.lit(1234567)))


def sent(spark, messages, *rows, **more):
    out = channel.records(channel.annotate(messages, channels(spark, *rows), {"m": M}, more.get("transformations")))
    return sorted((r.sink, r.topic, r.key, r.value) for r in out.collect())


def test_records_of_good_and_bad_messages(spark):
    doc = f'<{EX}1> <{EX}v> "x" .\n'
    failure = "Failure(MalformedMessage: not a well-formed JSON document)"
    assert sent(spark, inbox(spark, GOOD, BAD), {}) == [
        ("error", "err", "c1", failure),
        ("monitor_in", "mi", None, "@in:1234567"),
        ("monitor_in", "mi", None, "@in:1234567"),
        ("monitor_out", "mo", "c1", "@in:1234567"),
        ("output", "out", "c1", doc),
    ]


def test_switches_and_absent_topics(spark):
    df = inbox(spark, GOOD, BAD)
    off = {"monitor_in_enabled": False, "monitor_out_enabled": False, "error_enabled": False}
    none = {"monitor_in_topic": None, "monitor_out_topic": None, "error_topic": None}
    # side topics come and go, the main flow does not change
    assert [r[0] for r in sent(spark, df, off)] == ["log", "output"]
    assert [r[0] for r in sent(spark, df, none)] == ["log", "output"]
    assert sent(spark, df, {"is_stopped": True}) == []
    assert [(r[0], r[2]) for r in sent(spark, df, {"output_broker": "MQTT", **off})] == [("log", None), ("output", None)]


def test_several_channels_on_one_topic(spark):
    df = inbox(spark, GOOD).unionByName(inbox(spark, GOOD, topic="nobody reads this"))
    rows = [{}, {"channel_id": "c2", "output_topic": "out2"}, {"channel_id": "c3", "mapping_id": "gone"}, {"channel_id": "c4", "input_topic": "x"}]
    got = sent(spark, df, *rows)
    assert [r[1] for r in got if r[0] == "output"] == ["out", "out2"]
    assert [r[3] for r in got if r[0] == "error"] == ["Failure(NoSuchMapping: gone)"]


def test_identity_keeps_payloads_and_order(spark):
    payloads = ["z", "a\nb", " ", "", "{}", "żółw", "10", "9"]
    df = inbox(spark, *payloads).withColumn("mapping_id", F.lit("identity"))
    rows = channel.transform(df, {}, {"identity": lambda c: c}).collect()
    assert [r.doc for r in rows] == payloads
    assert {r.error for r in rows} == {None}


def test_python_transformation_captures_failures(spark):
    df = inbox(spark, "1", "x", "3").withColumn("mapping_id", F.lit("double"))
    double = channel.python_transformation(lambda text: str(2 * int(text)))
    rows = channel.transform(df, {}, {"double": double}).orderBy("msg_id").collect()
    assert [r.doc for r in rows] == ["2", None, "6"]
    assert rows[1].error.startswith("ValueError")


def test_failures_are_counted_by_channel(spark):
    rows = [{}, {"channel_id": "c2", "error_topic": None}, {"channel_id": "c3", "error_enabled": False}, {"channel_id": "c4", "mapping_id": "gone"}]
    out = channel.records(channel.annotate(inbox(spark, GOOD, BAD, BAD), channels(spark, *rows), {"m": M}))
    found = {r.channel_id: (r.failures, r.failures_without_topic) for r in channel.failure_counts(out).collect()}
    assert found == {"c1": (2, 0), "c2": (2, 2), "c3": (2, 2), "c4": (3, 0)}
    assert {r.value for r in out.where("sink = 'log'").collect()} == {"Failure(MalformedMessage: not a well-formed JSON document)"}


def placed(spark, *rows):
    """Channels with addresses of their own."""
    places = [r.pop("output_address", None) for r in rows]
    df = channels(spark, *rows)
    named = F.create_map(*[F.lit(x) for r, a in zip(rows, places, strict=True) for x in (r.get("channel_id", "c1"), a)])
    return df.withColumns({"output_address": named[F.col("channel_id")], "monitor_out_address": F.lit(None).cast("string"), "error_address": F.lit("e:1")})


def test_each_record_at_its_channels_address(spark, tmp_path):
    rows = [{"output_address": "one:1"}, {"channel_id": "c2", "output_address": "two:2"}, {"channel_id": "c3", "output_broker": "MQTT", "output_address": "tcp://m:1"}]
    sent = channel.records(channel.annotate(inbox(spark, GOOD, BAD), placed(spark, *rows), {"m": M}))
    got = {}

    def send(df, address):
        # the folder is partitioned by address, so a write reads its own part
        assert "address" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
        got[address] = sorted((r.topic, r.key) for r in df.collect())

    written = channel.write_records(channel.addressed(sent, "rest:9"), str(tmp_path / "a"), 0)
    channel.send_records(written, send)
    assert got == {"one:1": [("out", "c1")], "two:2": [("out", "c2")], "e:1": [("err", f"c{i}") for i in (1, 2, 3)], "rest:9": [("mo", f"c{i}") for i in (1, 2, 3)]}
    # by topic: one that isn't named stops the batch
    written = channel.write_records(channel.addressed(sent, {"err": "x:1"}), str(tmp_path / "b"), 0)
    with pytest.raises(ValueError, match="mo"):
        channel.send_records(written, send)
    assert {r.address for r in channel.addressed(sent, {"mo": "x:1"}).where("sink = 'monitor_out'").collect()} == {"x:1"}


def test_failures_are_observed_while_they_are_written(spark, tmp_path):
    rows = [{}, {"channel_id": "c2", "error_topic": None}, {"channel_id": "c3", "mapping_id": "gone"}]
    sent = channel.records(channel.annotate(inbox(spark, GOOD, BAD, BAD), channels(spark, *rows), {"m": M}))
    totals, group = [], "observed"
    spark.sparkContext.setJobGroup(group, group)
    written = channel.write_records(sent, str(tmp_path / "w"), 0, totals.append)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("plain", "plain")
    channel.write_records(sent, str(tmp_path / "p"), 0)
    assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup("plain"))  # no job beside the write
    spark.sparkContext._jsc.clearJobGroup()
    counts = channel.failure_counts(written).agg(F.sum("failures"), F.sum("failures_without_topic")).first()
    assert totals == [{"failures": counts[0], "failures_without_topic": counts[1]}] == [{"failures": 7, "failures_without_topic": 2}]


def test_many_python_transformations_cross_once(spark):
    df = inbox(spark, "1", "x", "3", None).withColumn("mapping_id", F.element_at(F.array(*map(F.lit, ["a", "b", "c", "a"])), F.col("msg_id").cast("int") + 1))
    given = {"a": channel.python_transformation(lambda t: t * 2), "b": channel.python_transformation(lambda t: str(int(t))), "c": F.upper}
    out = channel.transform(df, {}, given)
    assert [(r.doc, (r.error or "")[:10]) for r in out.orderBy("msg_id").collect()] == [("11", ""), (None, "ValueError"), ("3", ""), (None, "NullMessag")]
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_dry_run(spark):
    catalog = spark.createDataFrame(
        [("json", None), ("xml", None), ("csv", None), ("json", ""), ("xml", "{}"), ("csv", ""), ("none", None)], "mapping_id string, sample string"
    )
    got = dry_run(catalog, {"json": q.FLAT, "xml": q.PARTS, "csv": q.SUPPLIERS}, sample="sample").collect()
    assert [(r.mapping_id, r.ok) for r in got] == [
        ("json", True), ("xml", True), ("csv", True), ("json", False), ("xml", False), ("csv", False), ("none", False),
    ]
    assert got[5].error == "java.lang.IllegalArgumentException: Empty input is not allowed!"
    assert set(SAMPLES) == {"JSON", "XML", "CSV"}


def test_a_row_only_meets_its_own_mapping(spark):
    """Formats and mappings mix in one batch; JSON-LD and Turtle side by side."""
    from dataclasses import replace

    rows = [("1", "a", GOOD), ("2", "b", GOOD), ("3", "x", "<part key='7'/>"), ("4", "x", GOOD)]
    df = spark.createDataFrame(rows, "msg_id string, mapping_id string, payload string")
    got = apply_by_id(df, {"a": M, "b": replace(M, output_format="JSONLD"), "x": q.PARTS}, "mapping_id", "payload", "msg_id").collect()
    assert got[0].doc.startswith("<") and json.loads(got[1].doc)[0]["@id"] == EX + "1"
    assert "part/7" in got[2].doc and got[3].error.startswith("MalformedMessage")


def test_mappings_as_data_write_what_compiled_ones_write(spark):
    """Random mappings over random messages: missing values, arrays, odd numbers, texts that need encoding, indexes, clashing names."""
    import random

    from tripleloom import iri, literal
    from tripleloom.operators import rulesets
    from tripleloom.operators.mapping import documents

    random.seed(8)
    paths = ["a", "b", "A", "n.x", "n.y.z", "l", "l[0]", "l[1].x", "t", "n", "gone", "n.gone"]
    values = ['"x y"', '"é/ü \\"q\\" \\n"', "1.50", "7", "true", "null", "[]", '"[]"', '["a","b c",2.0,null]', '["a"]', '"[a]"', '{"x":1.0}', "-2e3", '""', "[[1],2]"]

    def term():
        path = random.choice(paths)
        return random.choice([
            reference(path), reference(path, XSD + "integer"), reference(path, lang="en"), reference(path, term_type="iri"), literal('say "' + path),
            iri(EX + path), template(EX + "{a}/{" + path + "}"), template("{" + path + "} and {b}", "literal"),
        ])

    def subject():
        return random.choice([iri(EX + "s"), template(EX + "{a}"), template(EX + "{n.x}/{b}"), template(EX + "{l[0]}")])

    mappings = {}
    for i in range(40):
        maps = tuple(
            TriplesMap(f"t{k}", subject(), tuple(po(EX + f"p{j % 3}", *[term() for _ in range(2)]) for j in range(3)), (EX + "C",) * (k % 2), random.choice(["$", "$", "$.n", "$.l[0]"]))
            for k in range(2)
        )
        mappings[f"m{i}"] = Mapping(f"m{i}", maps, expand_arrays=i % 5 > 0)
    assert all(rulesets.as_data(m) for m in mappings.values())
    payloads = [
        '{"a":%s,"b":%s,"A":%s,"n":{"x":%s,"y":{"z":%s}},"l":[%s,{"x":%s}],"t":%s}' % tuple(random.choices(values, k=8)) for _ in range(60)
    ] + ["{}", "[]", "3", '"x"', "null", '{"n":[1,2],"l":{"x":1}}', "{"]
    rows = [(f"{i}-{m}", m, p) for i, p in enumerate(payloads) for m in mappings]
    df = spark.createDataFrame(rows, "msg_id string, mapping_id string, payload string")
    got = {r.msg_id: (r.doc, r.error) for r in apply_by_id(df, mappings, "mapping_id", "payload", "msg_id").collect()}
    for name, m in mappings.items():
        want = documents(df.where(F.col("mapping_id") == name), m).collect()
        assert {r.msg_id: got[r.msg_id] for r in want} == {r.msg_id: (r.doc, r.error) for r in want}, m


def test_a_mapping_that_cannot_be_compiled_is_its_channels_error(spark):
    bad = Mapping("bad", (TriplesMap("t", template(EX + "{id}"), (po(EX + "v", reference("a[?(@.x)]")),)),))
    rows = [("1", "bad", GOOD), ("2", "m", GOOD)]
    df = spark.createDataFrame(rows, "msg_id string, mapping_id string, payload string")
    got = {r.msg_id: r for r in apply_by_id(df, {"bad": bad, "m": M}, "mapping_id", "payload", "msg_id").collect()}
    assert got["1"].doc is None and got["1"].error.startswith("MappingError") and got["2"].error is None and got["2"].doc


def test_500_mappings_make_one_plan(spark):
    import time
    from dataclasses import replace

    def plan(n):
        df = spark.createDataFrame([("1", "m1", GOOD)], "msg_id string, mapping_id string, payload string")
        start = time.perf_counter()
        out = apply_by_id(df, {f"m{i}": replace(M, id=f"m{i}") for i in range(n)}, "mapping_id", "payload", "msg_id")
        return len(out._jdf.queryExecution().optimizedPlan().toString()), time.perf_counter() - start, out.first().doc

    (few, _, a), (many, seconds, b) = plan(2), plan(500)
    assert a == b and a and many < 1.2 * few and seconds < 5


def test_channels_run_mappings_with_joins(spark):
    """Their documents are those of documents(); a failing message stays in its channel."""
    from test_mapping import JOINED, ONE_CHILD

    from tripleloom.operators.mapping import documents

    payload = json.dumps({"first": {"pk": 2, "c": "x"}, "lines": [{"ln": i, "pk": i % 3, "c": "x"} for i in range(9)], "parts": [{"k": i % 4, "n": f"n{i}", "c": "x"} for i in range(8)]})
    mappings = {"m": M, "j": JOINED, "o": ONE_CHILD}
    rows = [("1", "j", payload), ("2", "o", payload), ("3", "j", "{"), ("4", "m", GOOD)]
    df = spark.createDataFrame(rows, "msg_id string, mapping_id string, payload string")
    got = {r.msg_id: r for r in apply_by_id(df, mappings, "mapping_id", "payload", "msg_id").collect()}
    for i, mapping in (("1", JOINED), ("2", ONE_CHILD)):
        assert got[i].doc == documents(df.where(F.col("msg_id") == i), mapping).first().doc and EX + "part/" in got[i].doc
    assert got["3"].doc is None and got["3"].error.startswith("MalformedMessage") and got["4"].error is None


# --- sources ------------------------------------------------------------------------------------


def test_kafka_options():
    source = src.TopicSource("t", "KAFKA", servers="h:9092", group_id="g", buffer_size=10)
    assert src.kafka_source_options(source, True) == {
        "kafka.bootstrap.servers": "h:9092", "subscribe": "t", "kafka.group.id": "g", "startingOffsets": "latest", "maxOffsetsPerTrigger": "10",
    }
    assert src.kafka_source_options(source, False)["startingOffsets"] == "earliest"
    assert src.kafka_sink_options("h:1") == {"kafka.bootstrap.servers": "h:1"}


def test_only_kafka_records_go_to_kafka(spark):
    rows = channel.records(channel.annotate(inbox(spark, GOOD), channels(spark, {}), {"m": M}))
    assert sorted(r.topic for r in src.to_kafka(rows).collect()) == ["mo", "out"]


@pytest.mark.parametrize("file_format", ["parquet", "json"])
def test_file_topics(spark, tmp_path, file_format):
    path = str(tmp_path / "topic")
    both = inbox(spark, GOOD, BAD, topic="a/b").unionByName(inbox(spark, GOOD, topic="c"))
    both.write.format(file_format).save(path)
    source = src.TopicSource("a/b", path=path, file_format=file_format)
    assert sorted(r.payload for r in src.read_messages(spark, source).collect()) == sorted([GOOD, BAD])
    assert src.read_messages(spark, src.TopicSource(path=path, file_format=file_format)).count() == 3
    assert src.read_messages(spark, source, streaming=True).isStreaming


def test_equal_lines_of_a_text_topic_are_messages_of_their_own(spark, tmp_path):
    """However the file is split: lines keep their order, and no two share a position."""
    path = tmp_path / "lines"
    path.mkdir()
    for name, n in (("a", 4000), ("b", 30), ("c", 1)):
        (path / f"{name}.txt").write_text("".join("tick\n" if i % 3 else f"{i}\n" for i in range(n)) + "\n" * (name == "b"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1000b", "37b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = src.read_messages(spark, src.TopicSource("t", path=str(path), file_format="text")).collect()
            assert len(rows) == 4032 == len({r.msg_id for r in rows})
            for name, n in (("a", 4000), ("b", 31), ("c", 1)):
                lines = [r.payload for r in sorted((r for r in rows if r.part.endswith(f"{name}.txt")), key=lambda r: r.position)]
                assert lines[:n] == ["tick" if i % 3 else str(i) for i in range(n)][: 30 if name == "b" else n] + [""] * (name == "b")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_text_topics(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.txt").write_text(f"{GOOD}\n{BAD}\n")
    rows = src.read_messages(spark, src.TopicSource("t", path=str(tmp_path / "in"), file_format="text")).collect()
    assert sorted(r.payload for r in rows) == sorted([GOOD, BAD] * 2)
    assert len({r.msg_id for r in rows}) == 4 and {r.topic for r in rows} == {"t"}


def test_unknown_broker_is_refused(spark):
    with pytest.raises(ValueError):
        src.read_messages(spark, src.TopicSource("t", "AMQP"))


# --- streaming ----------------------------------------------------------------------------------


def drop_files(spark, path, first, n):
    """Message files appear one by one, as a topic would fill."""
    for i in range(first, first + n):
        rows = [(f"{i}-{k}", "in", None, GOOD if k % 3 else BAD) for k in range(6)]
        df = spark.createDataFrame(rows, "msg_id string, topic string, key string, payload string")
        df.withColumn("ts", F.timestamp_millis(F.lit(i))).coalesce(1).write.mode("append").parquet(path)


def written(spark, path):
    return sorted((r.sink, r.msg_id, r.channel_id, r.value) for r in spark.read.parquet(path).collect())


def test_stream_equals_batch_over_restarts_and_switches(spark, tmp_path):
    inputs, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    table = str(tmp_path / "channels")
    source = src.TopicSource(path=inputs, buffer_size=1)

    def run():
        query = channel.run_channels(
            src.read_messages(spark, source, streaming=True), lambda: spark.read.parquet(table), {"m": M}, out, checkpoint
        )
        query.awaitTermination()
        return query

    def batch():
        return sorted(
            (r.sink, r.msg_id, r.channel_id, r.value)
            for r in channel.records(channel.annotate(src.read_messages(spark, source), channels(spark, {}), {"m": M})).collect()
        )

    drop_files(spark, inputs, 0, 2)
    channels(spark, {}).write.parquet(table)
    query = run()
    # one file per micro-batch: the intake is bounded
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [6, 6]
    assert written(spark, out) == batch()
    # a second run goes on where the first stopped: nothing lost, nothing twice
    drop_files(spark, inputs, 2, 1)
    run()
    assert written(spark, out) == batch()
    run()
    assert written(spark, out) == batch()
    # a switch thrown between micro-batches holds for the next one
    channels(spark, {"monitor_in_enabled": False, "error_enabled": False}).write.mode("overwrite").parquet(table)
    before = written(spark, out)
    drop_files(spark, inputs, 3, 1)
    run()
    new = [r for r in written(spark, out) if r not in before]
    assert {r[0] for r in new} == {"output", "monitor_out", "log"} and {r[1].split("-")[0] for r in new} == {"3"}


def test_ended_streams_are_logged(spark, tmp_path):
    """A stream that finishes and one that fails each leave an event for the state log."""
    import time

    from tripleloom.operators import state

    inputs = str(tmp_path / "in")
    drop_files(spark, inputs, 0, 1)
    rows = []
    log = channel.CompletionLog(lambda df: rows.extend(df.collect()), lambda name: spark.createDataFrame([(f"{name}-channel",)], "channel_id string"))
    spark.streams.addListener(log)
    try:
        for name, load in (("good", lambda: channels(spark, {})), ("bad", lambda: 1 / 0)):
            stream = src.read_messages(spark, src.TopicSource(path=inputs), streaming=True)
            query = channel.run_channels(stream, load, {"m": M}, str(tmp_path / name), str(tmp_path / f"cp-{name}"), query_name=name)
            try:
                query.awaitTermination()
            except Exception as e:  # noqa: BLE001
                assert name == "bad" and "ZeroDivisionError" in str(e)
        for _ in range(100):
            if len(rows) == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    schema = (
        "channel_id string, seq long, action string, is_stopped boolean, monitor_in_enabled boolean, "
        "monitor_out_enabled boolean, error_enabled boolean, error string"
    )
    added = [{**r.asDict(), "seq": 1, "action": "add", "error": None} for r in rows]
    names = [f.split(" ")[0] for f in schema.split(", ")]
    events = spark.createDataFrame([tuple(r[n] for n in names) for r in added + rows], schema)
    now = {r.channel_id: (r.is_stopped, r.error) for r in state.current_state(events).collect()}
    assert now["good-channel"] == (True, None)
    assert now["bad-channel"][0] and "ZeroDivisionError" in now["bad-channel"][1]


def test_repeated_micro_batch_leaves_the_same_records(spark, tmp_path):
    """A batch run again after a lost executor overwrites its own folder."""
    out = str(tmp_path / "out")
    df = channel.records(channel.annotate(inbox(spark, GOOD, BAD), channels(spark, {}), {"m": M}))
    for _ in range(2):
        channel.write_records(df, out, 7)
    assert len(written(spark, out)) == df.count()


def test_records_keep_message_order(spark, tmp_path):
    """Offsets compare as numbers; partitions and channels stay apart."""
    rows = [(f"in/{part}/{n}", "in", None, json.dumps({"id": f"{part}-{n}", "v": "x"}), str(part), n) for n in range(1200, 7, -1) for part in (2, 10)]
    df = spark.createDataFrame(rows, "msg_id string, topic string, key string, payload string, part string, position bigint")
    df = df.withColumn("ts", F.timestamp_millis(F.lit(1234567))).repartition(3)
    both = channels(spark, {}, {"channel_id": "c2", "output_topic": "out2"})
    sent = channel.records(channel.annotate(df, both, {"m": M}))
    out = str(tmp_path / "out")
    channel.write_records(sent, out, 0)
    files = sorted((tmp_path / "out" / "batch_id=0" / "sink=output").glob("address=*/*.parquet"))
    seen = []
    for file in files:
        own = [(r.channel_id, r.part, r.position) for r in spark.read.parquet(str(file)).coalesce(1).collect()]
        assert own == sorted(own)
        seen += own
    assert len(seen) == 2 * len(rows) and len(set(seen)) == len(seen)
    ranks = {(r.channel_id, r.part, r.position): r["rank"] for r in channel.ranked(sent.where("sink = 'output'"), 100).collect()}
    for c in ("c1", "c2"):
        order = sorted((p, n) for x, p, n in seen if x == c)
        assert [ranks[(c, *x)] for x in order] == list(range(1, len(rows) + 1))


def test_python_transformation_sees_its_own_rows_only(spark):
    df = inbox(spark, "1", "x", "3", None).withColumn("mapping_id", F.expr("if(payload = 'x', 'other', 'double')"))
    double = channel.python_transformation(lambda text: str(2 * int(text)))  # would fail on the other row
    rows = channel.transform(df, {}, {"double": double, "other": lambda c: c}).orderBy("msg_id").collect()
    assert [(r.doc, r.error) for r in rows[:3]] == [("2", None), ("x", None), ("6", None)]
    assert rows[3].doc is None and rows[3].error



def test_the_plan_does_not_grow_with_the_mappings(spark):
    """240 mappings of five shapes make the plan of ten, whichever shapes they have; so does a catalog of rule documents."""
    from tripleloom.operators import rulesets
    from tripleloom.plans import channel_queries as cq

    def nodes(mappings):
        df = inbox(spark, GOOD).withColumn("mapping_id", F.lit("m0"))
        return channel.transform(df, mappings)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert all(rulesets.as_data(m) for m in cq.shapes(10).values())
    assert nodes(cq.shapes(240)) == nodes(cq.shapes(10))
    assert all(rulesets.as_data(m) for m in cq.xml_shapes(4).values())
    assert nodes(cq.shapes(10) | cq.xml_shapes(240)) == nodes(cq.shapes(10) | cq.xml_shapes(2))


def test_csv_and_iterating_mappings_as_data_write_what_compiled_ones_write(spark):
    import random

    from tripleloom import blank
    from tripleloom.operators import rulesets
    from tripleloom.operators.mapping import documents

    random.seed(5)
    names = ["a", "b", "c d", "e"]

    def subject(tm):
        return random.choice([template(EX + "{a}"), blank(), blank("n {a} {b}"), template(EX + "{a}/{e}")])

    mappings = {}
    for i in range(24):
        fmt, iterator = random.choice([("CSV", ""), ("JSON", "$.l[*]"), ("JSON", "$[*].l[*]"), ("JSON", "$.l[1]"), ("JSON", "$")])
        maps = tuple(
            TriplesMap(f"t{k}", subject(k), tuple(po(EX + f"p{j}", reference(random.choice(names)), template("{a} {" + random.choice(names) + "}", "literal")) for j in range(2)), (EX + "C",) * (k % 2), iterator)
            for k in range(2)
        )
        mappings[f"m{i}"] = Mapping(f"m{i}", maps, fmt, random.choice(["TTL", "JSONLD"]))
    assert all(rulesets.as_data(m) for m in mappings.values())
    item = ['{"a":"x \\"y\\"","b":1.50,"c d":["q","r",null],"e":"é"}', '{"a":["u","v"],"b":null,"c d":"[z]"}', "null", "3", '{"b":[1,1]}']
    csv = ['a,b,c d,e\n1,"x ""q""",[r],é\n2,,\n', "a,a,e\n1,2,3\n", "b\n1\n\n2\n", "a"]
    jsons = [f'{{"l":[{item[0]},{item[1]}],"a":"k"}}', f'{{"l":[{",".join(item)}]}}', f'[{{"l":[{item[1]}]}},{{"l":{item[0]}}},7]', "{}", "[]", item[0], item[1], "{"]
    rows = [(f"{n}-{m}", m, p) for m, v in mappings.items() for n, p in enumerate(csv if v.input_format == "CSV" else jsons)]
    df = spark.createDataFrame(rows, "msg_id string, mapping_id string, payload string")
    got = {r.msg_id: (r.doc, r.error) for r in apply_by_id(df, mappings, "mapping_id", "payload", "msg_id").collect()}
    for name, m in mappings.items():
        want = documents(df.where(F.col("mapping_id") == name), m).collect()
        assert {r.msg_id: got[r.msg_id] for r in want} == {r.msg_id: (r.doc, r.error) for r in want}, m


def test_xml_mappings_as_data_write_what_compiled_ones_write(spark):
    """Numbers and lists as texts, empty, blank and repeated elements, attributes, character data, comments, malformed texts."""
    from tripleloom import blank
    from tripleloom.operators import rulesets
    from tripleloom.operators.mapping import documents

    a = TriplesMap("p", template(EX + "{@key}"), (po(EX + "has", reference("attr/value")), po(EX + "n", reference("note"))), iterator="/part")
    b = TriplesMap("p", template(EX + "{b}"), (po(EX + "t", reference("c/@t")), po(EX + "c", reference("c"))), iterator="/r/i")
    c = TriplesMap("p", template(EX + "{part/@key}"), (po(EX + "has", reference("part/attr/value")), po(EX + "d", reference("r/i/b"))), iterator="")
    d = TriplesMap("p", blank("{b}"), (po(EX + "x", template(EX + "{b}/{c}")), po(EX + "y", reference("."))), iterator="/r/i")
    e = TriplesMap("q", template(EX + "k/{@kind}"), (po(EX + "v", reference("value")),), (EX + "C",), iterator="/part/attr")
    mappings = {f"{n}{form}": Mapping(f"{n}{form}", maps, "XML", form) for n, maps in (("a", (a, e)), ("b", (b,)), ("c", (c,)), ("d", (d, e))) for form in ("TTL", "JSONLD")}
    assert all(rulesets.as_data(m) for m in mappings.values())
    texts = [
        '<?xml version="1.0"?>\n<part key="1"><attr kind="x y"><value>007</value></attr><attr kind=\'2\'><value>1.10</value><value>true</value></attr><note/></part>',
        '<part key=""><attr><value/></attr><attr kind="z">\n <value> </value>\n <value>[1]</value>\n</attr><note>{"a":1}</note></part>',
        '<r><i><b>1</b><c t="07">x</c><c>y</c></i><i><b>2 &amp; "q"</b><c t="">  sp </c></i></r>',
        '<r><i><b><![CDATA[1.50]]></b><c t="a>b">x &lt; y</c></i><i><b>null</b><c t="1"/></i><i/><i><b>z</b><b>z</b><c/></i></r>',
        "<r><!-- > c --><i><b>é\n你</b><c>1<!-- x -->2</c></i></r>", "<r>text</r>", "<r/>", '<part><attr kind="1">mix<value>v</value>tail</attr></part>',
        "<R><I><B>case</B></I></R>", '<r><i><b>a<![CDATA[b<!-- c -->]]>c</b><c>a="3"</c></i></r>', "<r><i><b>$1</b><c>\\</c></i></r>", "<r><i><b>x</b>", "no", "", None,
    ]
    rows = [(f"{n}-{m}", m, p) for m in mappings for n, p in enumerate(texts)]
    df = spark.createDataFrame(rows, "msg_id string, mapping_id string, payload string")
    got = {r.msg_id: (r.doc, r.error) for r in apply_by_id(df, mappings, "mapping_id", "payload", "msg_id").collect()}
    for name, m in mappings.items():
        want = documents(df.where(F.col("mapping_id") == name), m).collect()
        assert {r.msg_id: got[r.msg_id] for r in want} == {r.msg_id: (r.doc, r.error) for r in want}, name
    assert got["10-bTTL"][0].endswith('"\\\\" .\n')  # a backslash alone is escaped
    # a comment doesn't cut the text around it
    assert '<http://' in got["4-bTTL"][0] and '"12"' in got["4-bTTL"][0]


def test_a_catalog_of_rule_documents(spark):
    """Documents whose nodes have the same names, one broken, one that has to be compiled, none of them on the driver."""
    from tripleloom.sources import ntriples, rules

    documents_ = {"a": q.FLAT, "b": q.ORDERS, "c": q.CONDITIONAL, "d": q.SUPPLIERS, "e": q.SEVERAL}
    lines = [(k, x) for k, m in documents_.items() for x in rules.to_ntriples(m)] + [("broken", "_:x <http://www.w3.org/ns/r2rml#template> \"y\" .")]
    triples = ntriples.parse_lines(spark.createDataFrame(lines, "mapping_id string, line string"), "line", "mapping_id")
    formats = spark.createDataFrame([("b", "JSONLD")], "mapping_id string, output_format string")
    catalog = rules.load_catalog(triples, formats)
    found = {r.mapping_id: r for r in catalog.collect()}
    assert {k: (r.input_format, r.output_format, r.is_data) for k, r in found.items() if k != "broken"} == {
        "a": ("JSON", "TTL", True), "b": ("JSON", "JSONLD", True), "c": ("JSON", "TTL", False), "d": ("CSV", "TTL", True), "e": ("JSON", "TTL", True),
    }
    assert found["broken"].problem.startswith("MappingError")
    payload = '{"event_id":5,"user_id":1,"event_type":"x","tag":["u","v"],"part":"p"}'
    df = inbox(spark, payload, payload, payload, "event,x").withColumn("mapping_id", F.element_at(F.array(*map(F.lit, "aec")), (F.col("msg_id").cast("int") % 3 + 1)))
    got = {r.msg_id: r for r in channel.transform(df, catalog).collect()}
    want = {r.msg_id: r for r in channel.transform(df, {k: documents_[k] for k in "ae"}).collect()}
    assert got["0"].doc == want["0"].doc and got["1"].doc == want["1"].doc and "p" in got["1"].doc
    assert got["2"].error == "MappingError: this mapping has to be compiled" and got["3"].error.startswith("MalformedMessage")
    again = rules.mappings_of(catalog, "c", "broken")
    assert list(again) == ["c"]
    assert channel.transform(df.where("mapping_id = 'c'"), again).first().doc
