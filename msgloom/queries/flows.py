"""Queries over files and streams: what is written, read back or streamed must be what the batch rules say.

Tables are written to the shared folder, run through the source, sink or stream (which
takes what is there and stops), and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from msgloom import schemas
from msgloom.operators import conversation, curate, events, labels
from msgloom.queries.curation import JUDGED, P, judged, pairs, with_events
from msgloom.queries.frames import MAIL
from msgloom.queries.messages import GATE, REPEATS, ROUTED, M, detected, keyed_events, messages, routed
from msgloom.queries.registry import query
from msgloom.sources import io
from msgloom.sources.staging import discard, shared_folder, staged
from msgloom.streaming import streams
from msgloom.streaming.mail import SCHEMA, MailSource


def scenario(name: str = "event_id") -> Column:
    return F.concat(F.lit("s"), F.col(name).cast("string"))


def as_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled pairs; every seventh has no sender."""
    none = F.lit(None).cast("string")
    gold = F.to_json(F.struct("is_schedule", F.lit("t").alias("title")))
    return pairs(spark, sf_dir).select(
        scenario("doc_id").alias("scenario_id"), none.alias("received_at"), "channel", F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("sender"), "language", F.lit(None).cast(schemas.THREAD).alias("thread_context"), "message", gold.alias("gold"),
    )


@query(f"""{P} SELECT 's' || doc_id AS scenario_id, channel, CASE WHEN doc_id % 7 > 0 THEN source END AS sender, md5(text) AS message_md5, '{{"is_schedule":' || is_schedule || ',"title":"t"}}' AS gold FROM p""")
def s1_s2_pairs_written_and_read(spark, sf_dir):
    path = shared_folder(spark)
    io.write_pairs(as_pairs(spark, sf_dir), path)
    return io.read_pairs(spark, path).select("scenario_id", "channel", "sender", F.md5(F.col("message").cast("binary")).alias("message_md5"), "gold")


@query(f"{P} SELECT 's' || doc_id AS scenario_id, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'second' END AS run, CAST(1 AS BIGINT) AS rows FROM p")
def s3_resumed_append(spark, sf_dir):
    """A run that stopped after a third of its rows, and the run that goes on with all of them."""
    path = shared_folder(spark)
    rows = pairs(spark, sf_dir).select(scenario("doc_id").alias("scenario_id"), "doc_id")
    io.append_new(rows.where("doc_id % 3 = 0").select("scenario_id", F.lit("first").alias("run")), path, "scenario_id")
    io.append_new(rows.select("scenario_id", F.lit("second").alias("run")), path, "scenario_id")
    return spark.read.schema("scenario_id string, run string").json(path).groupBy("scenario_id", "run").agg(F.count("*").alias("rows"))


@query(f"{M} SELECT 'sms_' || event_id AS scenario_id, strftime(make_timestamp(seconds * 1000000) + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS received_at, 'sms' AS channel, sender, body AS message, CASE WHEN k % 10 = 0 THEN 'eval' ELSE 'train' END AS part FROM m")
def s4_sms_pairs(spark, sf_dir):
    split = F.when(F.col("k") % 10 == 0, "eval").otherwise("train")
    rows = io.sms_pairs(messages(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("seconds") * 1000).alias("date_millis"), "sender", "body", split.alias("split")))
    parts = [io.by_split(rows, name).withColumn("part", F.lit(name)) for name in ("train", "eval")]
    return parts[0].unionByName(parts[1])


@query(
    f"""{M}, c AS (SELECT event_id, channel, seconds, list({{'at': seconds, 's': sender || ' ' || body}}) OVER (PARTITION BY conversation ORDER BY seconds, seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before FROM m),
    t AS (SELECT event_id, CASE WHEN channel <> 'gmail' THEN list_transform(list_filter(before, lambda x: x.at >= seconds - 1800), lambda x: x.s) END AS turns FROM c)
    SELECT event_id, 'kakaotalk' AS channel, CASE WHEN len(turns) > 0 THEN array_to_string(turns, '|') END AS thread FROM t"""
)
def s6_chat_pairs(spark, sf_dir):
    rows = conversation.with_context(messages(spark, sf_dir)).select("event_id", F.col("context").alias("thread_context"))
    joined = F.array_join(F.transform("thread_context", lambda t: F.concat_ws(" ", t["sender"], t["message"])), "|")
    return io.chat_pairs(rows).select("event_id", "channel", joined.alias("thread"))


@query(f"{M} SELECT CASE WHEN k % 11 > 0 THEN 's' || event_id END AS scenario_id, CASE WHEN k % 11 > 0 THEN body END AS message, CASE WHEN k % 11 > 0 THEN 'ADDED' END AS feedback, CASE WHEN k % 11 = 0 THEN '{{\"broken\": ' || event_id END AS bad_line FROM m")
def s9_feedback_files(spark, sf_dir):
    """Feedback written as lines, some of them broken, with blank lines between."""
    path = shared_folder(spark)
    good = F.to_json(F.struct(scenario().alias("scenario_id"), F.col("body").alias("message"), F.lit("ADDED").alias("_feedback")))
    line = F.when(F.col("k") % 11 > 0, good).otherwise(F.concat(F.lit('{"broken": '), F.col("event_id").cast("string")))
    messages(spark, sf_dir).select(F.concat(line, F.lit("\n"))).write.text(path)
    return io.read_feedback(spark, path).select("scenario_id", "message", F.col("_feedback").alias("feedback"), "bad_line")


@query(f"{M}, {JUDGED} SELECT event_id, verdict, CASE WHEN verdict = 'reject' THEN 'rejected' ELSE 'accepted' END AS output FROM j")
def s10_split_outputs(spark, sf_dir):
    """Adopted and rejected rows, each written to a folder of its own."""
    path = shared_folder(spark)
    for name, part in zip(("accepted", "rejected"), io.split_outputs(judged(spark, sf_dir), F.nullif(F.col("verdict"), F.lit("reject")).isNotNull()), strict=True):
        part.select("event_id", "verdict").write.parquet(f"{path}/output={name}")
    return spark.read.parquet(path).select("event_id", "verdict", "output")


@query(f"{ROUTED} SELECT event_id AS id, status FROM r WHERE status = 'AUTO_ADDED' AND k % 3 > 0")
def s11_export_candidates(spark, sf_dir):
    rows = detected(spark, sf_dir).select(F.col("event_id").alias("id"), "status", "k")
    return io.export_candidates(rows, rows.where("k % 3 = 0")).select("id", "status")


@query(f"{M} SELECT event_id, title, date, 10 AS keys, 'event_id,events' AS columns FROM m")
def f15_stripped_meta(spark, sf_dir):
    """Events without confidence, rows without columns that begin with an underscore."""
    rows = with_events(spark, sf_dir).select("event_id", "events", F.col("k").alias("_k"), F.lit(1).alias("_source"))
    kept = curate.without_meta(rows.withColumn("events", curate.without_confidence(F.col("events"))))
    e = F.element_at("events", 1)
    keys = F.size(F.json_object_keys(F.to_json(e, {"ignoreNullFields": "false"})))
    return kept.select("event_id", e["title"].alias("title"), e["date"].alias("date"), keys.alias("keys"), F.lit(",".join(kept.columns)).alias("columns"))


# --- streams -----------------------------------------------------------------
def arriving(spark: SparkSession, rows: DataFrame, *order: str) -> DataFrame:
    """The rows as a stream of files in the given order."""
    path = shared_folder(spark)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def taken(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What an append stream gives, from its files."""
    path, state = shared_folder(spark), shared_folder(spark)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(f"{M} SELECT event_id, channel, body FROM m WHERE channel <> 'gmail' AND {GATE}")
def t1_gate_stream(spark, sf_dir):
    channels = spark.sql("SELECT * FROM VALUES ('sms', true), ('kakaotalk', true), ('gmail', false) AS c(channel, enabled)")
    rows = messages(spark, sf_dir).select("event_id", "channel", F.col("body").alias("message"), "received_at", "seconds")
    return taken(spark, streams.gated(arriving(spark, rows, "seconds"), channels)).select("event_id", "channel", F.col("message").alias("body"))


@query(
    f"""{REPEATS}, n AS (SELECT o.event_id, o.conversation, o.channel, o.seconds, o.seq, o.clock || ' ' || o.sender || ' ' || o.body AS said FROM f JOIN o ON o.event_id = f.event_id WHERE f.keep),
    c AS (SELECT event_id, channel, seconds, list({{'at': seconds, 's': said}}) OVER (PARTITION BY conversation ORDER BY seconds, seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before FROM n)
    SELECT event_id, CASE WHEN channel = 'gmail' THEN '' ELSE coalesce(array_to_string(list_transform(list_filter(before, lambda x: x.at >= seconds - 1800), lambda x: x.s), '|'), '') END AS context FROM c"""
)
def t2_buffer_stream(spark, sf_dir):
    """Messages without repeats, each with its context, by a stateful stream."""
    names = [c.split()[0] for c in streams.BUFFERED.split(", ")]
    got = taken(spark, streams.buffered(arriving(spark, messages(spark, sf_dir).select(*names), "seconds", "seq")))
    turns = F.from_json("context", "array<array<string>>")
    return got.select("event_id", F.array_join(F.transform(turns, lambda t: F.array_join(t, " ")), "|").alias("context"))


@query(f"{M} SELECT DISTINCT conversation || '|' || body AS event_key FROM m")
def t3_insert_or_ignore_stream(spark, sf_dir):
    """One row of each key that arrives within the delay, which is longer than the table here."""
    rows = messages(spark, sf_dir).select(F.concat_ws("|", "conversation", "body").alias("event_key"), F.timestamp_seconds("seconds").alias("at"))
    return taken(spark, streams.insert_or_ignore(arriving(spark, rows, "at"), "at", "365 days")).select("event_key")


@query()
def t4_merge_stream(spark, sf_dir):
    """Events merged as they arrive: the last state of each. Tests compare it with the batch form and a plain replay."""
    path, state, owner = shared_folder(spark), shared_folder(spark), ("user_id",)
    names = [c.split()[0] for c in streams.EVENTS.split(", ") if not c.startswith("merged")]
    rows = staged(keyed_events(spark, sf_dir).select(*owner, *names))  # ranges are found in one pass, files written in another
    stream = streams.merged_events(arriving(spark, rows, "created_at", "seq"), owner)
    discard(rows)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    with streams.rocksdb(spark):
        query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    seen = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(path)
    last = F.max_by(F.struct(*stream.columns), "batch").alias("row")
    return seen.groupBy(*owner, "channel", "start", "event_key", "created_at", "seq").agg(last).select("row.*")


@query(f"SELECT page_id AS mail_id, md5(url) AS body_md5, CAST(1000 * (SELECT max(page_id) FROM pages WHERE page_id % 5 > 0) AS BIGINT) AS next_mark FROM pages WHERE page_id > 20 AND page_id % 5 > 0")
def t5_mail_pull(spark, sf_dir):
    """Mails after a mark; every fifth has a blank body, which neither counts nor moves the mark."""
    body = F.when(F.col("page_id") % 5 > 0, F.col("url")).otherwise("  ")
    mails = MAIL.spark(spark, sf_dir).select(F.col("page_id").alias("mail_id"), (F.col("page_id") * 1000).alias("internal_millis"), body.alias("body"))
    pulled = streams.pull_new(mails, F.lit(20_000))
    mark = streams.next_mark(pulled, 20_000)
    return pulled.select("mail_id", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.lit(mark).cast("long").alias("next_mark"))


@query("SELECT page_id AS mail_id, md5(url) AS body_md5 FROM pages WHERE page_id > 20 AND page_id % 5 > 0")
def t5_mail_stream(spark, sf_dir):
    """The same mails by a source whose offset is the mark: they come in three runs of one stream, and each is taken once."""
    spark.dataSource.register(MailSource)
    inbox, state, out = (shared_folder(spark) for _ in range(3))
    body = F.when(F.col("page_id") % 5 > 0, F.col("url")).otherwise("  ")
    mails = MAIL.spark(spark, sf_dir).select(F.col("page_id").alias("mail_id"), (F.col("page_id") * 1000).alias("internal_millis"), body.alias("body"))
    low, high = mails.agg(F.min("internal_millis"), F.max("internal_millis")).first()
    cuts = [(low or 0) - 1, *(((low or 0) * (3 - k) + (high or 0) * k) // 3 for k in (1, 2)), high or 0]
    for after, until in zip(cuts, cuts[1:], strict=False):
        mails.where((F.col("internal_millis") > after) & (F.col("internal_millis") <= until)).write.mode("append").parquet(inbox)
        query = spark.readStream.format("mail").option("path", inbox).option("since", 20_000).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        query.processAllAvailable()
        query.stop()
    return spark.read.schema(SCHEMA).parquet(out).select("mail_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(f"{ROUTED} SELECT event_id AS id, status, CAST(1 AS BIGINT) AS times FROM r WHERE status = 'AUTO_ADDED'")
def t6_export_stream(spark, sf_dir):
    """Decided events exported by a stream that sees every event twice."""
    rows = detected(spark, sf_dir).select(F.col("event_id").alias("id"), "status")
    inbox, state, ledger, out = (shared_folder(spark) for _ in range(4))
    export = streams.export_batch(spark, ledger, out)
    for _ in range(2):
        rows.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        stream.writeStream.foreachBatch(export).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id long, status string").json(out).groupBy("id", "status").agg(F.count("*").alias("times"))


# --- plug-ins ----------------------------------------------------------------
@query(f"{M} SELECT event_id, event_id || ':' || length(body) AS output FROM m")
def g1_predictor(spark, sf_dir):
    """A predictor that the caller supplies: here one that answers with the length of the text."""
    rows = messages(spark, sf_dir).select("event_id", "body")
    return events.predict(rows, lambda batch: [f"{r['event_id']}:{len(r['body'])}" for r in batch]).select("event_id", "output")


@query(f"{M} SELECT event_id, CASE WHEN place IS NOT NULL THEN place || '!' END AS label, CASE WHEN place IS NULL THEN 'ValueError: no place' END AS error FROM m")
def g2_labeller(spark, sf_dir):
    """A labeller that the caller supplies and that fails on some rows."""

    def judge(row: dict) -> str:
        if row["place"] is None:
            raise ValueError("no place")
        return row["place"] + "!"

    return labels.label(messages(spark, sf_dir).select("event_id", "place"), judge).select("event_id", "label", "error")


@query(f"{ROUTED} SELECT event_id, status FROM r WHERE coalesce(status, '') <> 'PENDING'")
def f11_purge_status(spark, sf_dir):
    return events.purge_status(routed(spark, sf_dir), "PENDING").select("event_id", "status")
