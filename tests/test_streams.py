"""Streams give what the batch operators give."""

import json

from pyspark.sql import functions as F

from msgloom.operators import conversation, events
from msgloom.queries import flows
from msgloom.queries.messages import messages
from msgloom.streaming import streams
from msgloom.streaming.mail import MailSource


def streamed(spark, df, path, make, mode="append", parts=2, order="seq"):
    """Rows of ``make(stream)`` when ``df`` arrives as files in order; one batch a file."""
    bounds = [r[0] for r in df.select(F.col(order)).orderBy(order).collect()]
    step = -(-len(bounds) // parts)
    for k in range(parts):
        chunk = bounds[k * step : (k + 1) * step]
        df.where(F.col(order).between(chunk[0], chunk[-1])).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    rows = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = make(stream).writeStream.outputMode(mode).foreachBatch(lambda batch, number: rows.extend((number, r) for r in batch.collect())).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination(180)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert query.exception() is None
    return rows


def sample(spark, sf_dir):
    return messages(spark, sf_dir).where("event_id < 300").orderBy("seconds", "seq").withColumn("order_id", F.monotonically_increasing_id())


def test_gate_and_buffer(spark, sf_dir, tmp_path):
    rows = sample(spark, sf_dir)
    channels = spark.createDataFrame([("sms", True), ("kakaotalk", True), ("gmail", False)], "channel string, enabled boolean")
    plain = rows.select("event_id", "channel", F.col("body").alias("message"), "received_at", "order_id")
    got = {r.event_id for _, r in streamed(spark, plain, tmp_path / "gate", lambda s: streams.gated(s, channels), order="order_id")}
    assert got == {r.event_id for r in conversation.gate(plain, channels).collect()}

    batch = conversation.with_context(conversation.suppress_repeats(rows.where(F.trim("body") != "")))
    want = {r.event_id: [[t.time, t.sender, t.message] for t in r.context] for r in batch.collect()}
    got = {r.event_id: json.loads(r.context) for _, r in streamed(spark, rows, tmp_path / "buffer", streams.with_context, order="order_id")}
    assert got == want


def test_buffer_takes_every_message(spark, sf_dir, tmp_path):
    rows = sample(spark, sf_dir)
    assert rows.where("trim(body) = ''").count()
    batch = conversation.with_context(conversation.suppress_repeats(rows))
    want = {r.event_id: [[t.time, t.sender, t.message] for t in r.context] for r in batch.collect()}
    got = {r.event_id: json.loads(r.context) for _, r in streamed(spark, rows, tmp_path / "buffer", streams.buffered, order="order_id")}
    assert got == want
    assert len(flows.t2_buffer_stream(spark, sf_dir).collect()) == conversation.suppress_repeats(messages(spark, sf_dir)).count()


def test_insert_or_ignore_and_merge(spark, tmp_path):
    day = 86_400_000
    rows = [("k", f"d{k % 4}", f"r{k % 3}", ("회의", "점심", "면접")[k % 3], "s", "t", f"key{k % 20}", "PENDING", day + k * day // 2, k) for k in range(60)]  # the epoch itself counts as late
    df = spark.createDataFrame(rows, "channel string, start string, room string, base_title string, sender string, title string, event_key string, status string, created_at long, seq long")
    want = {(r.event_key, r.base_title, r.merged) for r in events.merge_events(df).collect()}
    latest = {}
    with streams.rocksdb(spark):
        for _, r in streamed(spark, df, tmp_path / "merge", streams.merged_events, mode="update"):
            latest[r.channel, r.start, r.event_key, r.created_at] = (r.event_key, r.base_title, r.merged)
    assert set(latest.values()) == want

    timed = df.withColumn("at", F.timestamp_millis("created_at"))
    got = [r.event_key for _, r in streamed(spark, timed, tmp_path / "keys", lambda s: streams.insert_or_ignore(s, "at", "365 days"))]
    assert sorted(got) == sorted({f"key{k}" for k in range(20)})


def test_pull_and_export(spark, tmp_path):
    mails = spark.createDataFrame([(1, 10, "a"), (2, 20, " "), (3, 30, "c")], "id long, internal_millis long, body string")
    pulled = streams.pull_new(mails, F.lit(5))
    assert [r.id for r in pulled.collect()] == [1, 3] and streams.next_mark(pulled, 5) == 30
    assert streams.next_mark(streams.pull_new(mails, F.lit(30)), 30) == 30
    run = streams.export_batch(spark, f"{tmp_path}/ledger", f"{tmp_path}/out")
    batch = spark.createDataFrame([(1, "ADDED"), (2, "PENDING")], "id long, status string")
    run(batch, 0)
    run(batch, 0)
    run(batch, 1)
    assert spark.read.json(f"{tmp_path}/out/batch=0").count() == 1
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/ledger").collect()} == {1}


def test_merge_state_ends_and_begins_with_a_stored_table(spark, tmp_path):
    """40 events in ten batches, a day apart in each, 20 days between batches: no more than two batches' events are ever kept."""
    day = 86_400_000
    columns = "channel string, start string, room string, base_title string, sender string, title string, event_key string, status string, created_at long, seq long"
    rows = [("k", f"d{k % 4}", "", f"t{k // 8}", "s", "t", f"key{k}", "PENDING", (1 + 20 * (k // 4) + k % 4) * day, k) for k in range(40)]
    df = spark.createDataFrame(rows, columns)
    want = {(r.event_key, r.base_title, r.merged) for r in events.merge_events(df).collect()}
    kept, latest = [], {}

    def run(frame, path, stored=None, parts=10):
        bounds = [r[0] for r in frame.select("seq").orderBy("seq").collect()]
        step = -(-len(bounds) // parts)
        for k in range(parts):
            frame.where(F.col("seq").between(bounds[k * step], bounds[min(len(bounds), (k + 1) * step) - 1])).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        with streams.rocksdb(spark):
            made = streams.merged_events(stream, stored=stored)
            query = made.writeStream.outputMode("update").foreachBatch(lambda batch, n: latest.update({r.event_key: (r.event_key, r.base_title, r.merged) for r in batch.collect()})).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination(180)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert query.exception() is None
        kept.extend(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators)

    run(df, tmp_path / "all")
    assert set(latest.values()) == want
    most = max(kept)
    assert kept[-1] < most and kept[-1] <= 4 * 5  # events, timers and their index of what the last batches hold
    cut = 20
    latest.clear()
    stored = events.merge_events(df.where(F.col("seq") < cut))
    latest.update({r.event_key: (r.event_key, r.base_title, r.merged) for r in stored.collect()})
    run(df.where(F.col("seq") >= cut), tmp_path / "rest", stored, parts=2)
    assert set(latest.values()) == want


def test_merge_state_does_not_grow_with_starts(spark, tmp_path):
    """900 starts, some null, of owners that are few, large or null: no more entries than slots, and rows of later batches find those of earlier ones."""
    day = 86_400_000
    columns = "user_id long, channel string, start string, room string, base_title string, sender string, title string, event_key string, status string, created_at long, seq long"
    rows = [(None if k % 7 == 0 else k % 3, "k", f"d{k % 900}" if k % 11 else None, "", "점심", "s", "t", f"key{k}", "PENDING", day + k * 100_000, k) for k in range(1800)]
    df = spark.createDataFrame(rows, columns)
    state = lambda r: (r.user_id, r.channel, r.start, r.event_key, r.merged)
    want = {state(r) for r in events.merge_events(df, owner=("user_id",)).collect()}
    assert len(want) < 1800
    latest = {}
    with streams.rocksdb(spark):
        for _, r in streamed(spark, df, tmp_path / "merge", lambda s: streams.merged_events(s, ("user_id",), buckets=2), mode="update"):
            latest[r.event_key] = state(r)
    assert set(latest.values()) == want
    kept = spark.read.format("statestore").option("path", f"file://{tmp_path}/merge/state").option("stateVarName", "events").load()
    assert kept.count() <= 2 * streams.SLOTS


def test_mail_source_takes_each_mail_once(spark, tmp_path):
    """Three runs with one checkpoint; blank mails neither come nor move the mark."""
    spark.dataSource.register(MailSource)
    inbox = f"file://{tmp_path}/inbox"
    kinds = "mail_id long, internal_millis long, body string"

    def run(*mails):
        if mails:
            spark.createDataFrame(list(mails), kinds).write.mode("append").parquet(inbox)
        stream = spark.readStream.format("mail").option("path", inbox).option("since", 5).load()
        taken = []
        query = stream.writeStream.foreachBatch(lambda batch, number: taken.extend(r.mail_id for r in batch.collect())).option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        query.stop()
        assert query.exception() is None
        return sorted(taken)

    assert run((1, 5, "at the mark"), (2, 10, "a"), (3, 90, "  "), (4, 20, "b")) == [2, 4]
    assert run((5, 30, "c"), (6, 15, "came too late"), (7, 80, None)) == [5]
    assert run() == []
    assert run((8, 31, "d")) == [8]
