"""Queries of the whole workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgloom.plans.assembly import assemble
from msgloom.plans.evaluation import run_evaluation
from msgloom.plans.message_flow import to_calendar, to_events, to_prompts
from msgloom.queries.curation import PREDICTED, gold_and_predictions, with_events
from msgloom.queries.messages import messages
from msgloom.queries.registry import query


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_events(spark, sf_dir)
    return rows.select(
        F.md5(F.concat_ws("|", "channel", "message", F.col("date"), F.col("is_schedule").cast("string")).cast("binary")).alias("pair_key"),
        F.when(F.col("k") < 3, "keep").otherwise("pool").alias("kind"), (F.col("k") % 2 == 0).alias("real"), (F.col("k") % 4).alias("source_ord"), F.col("event_id").alias("row_ord"),
        "event_id", "channel", "sender", "is_schedule", "events", "message", "thread_context",
    )


@query()
def workload_assembly(spark, sf_dir):
    """The flagship: a balanced set of up to 300 rows (the cap is the operator's own) out of all labelled messages."""
    final = assemble(labelled(spark, sf_dir), 300, 0.55)
    return final.select("event_id", "channel", "sender", "is_schedule", "message", "grounding", "difficulty")


def stored_events(said: DataFrame) -> DataFrame:
    """Messages to events, with a stand-in for the model that writes the labelled gold; every eleventh message comes off a screen, after the user's message before."""
    channels = said.sparkSession.sql("SELECT * FROM VALUES ('sms', true), ('kakaotalk', true), ('gmail', true) AS c(channel, enabled)")
    before = Window.partitionBy("user_id").orderBy("seconds", "seq")
    turn = F.struct(F.lag("clock").over(before).alias("time"), F.lag("sender").over(before).alias("sender"), F.lag("body").over(before).alias("message"))
    both = said.withColumn("thread_context", F.array(turn)).withColumns({"from_me": F.col("event_id") % 2 == 0, "counterpart": F.lit("박서준")})
    prompts = to_prompts(said.where("event_id % 11 > 0"), channels, "Find the schedule.", both.where("event_id % 11 = 0"))
    answer = F.to_json(F.struct("is_schedule", "title", "date", F.when(F.col("has_time"), F.struct("hour", "minute", "marker")).alias("time"), F.col("place").alias("location")))
    aliases = said.where("event_id % 50 = 0 AND place IS NOT NULL").select("sender", F.col("place").alias("token")).distinct()
    return to_events(prompts.withColumn("output", answer), aliases, F.lit("2024-01-15").cast("date"), owner=("user_id",))


@query()
def workload_message_flow(spark, sf_dir):
    """All messages to stored events. A test replays the whole flow."""
    return stored_events(messages(spark, sf_dir)).select("user_id", "channel", "start", "room", "base_title", "event_key", "status", "merged")


@query()
def workload_calendar_rows(spark, sf_dir):
    """The calendar rows at the end of the flow. A test replays them."""
    return to_calendar(stored_events(messages(spark, sf_dir))).select("user_id", "event_key", "row.*")


@query(
    f"""{PREDICTED}, f AS (SELECT event_id AS scenario_id, CASE WHEN NOT json_valid THEN 'json_parse_error' ELSE 'score_low' END AS reason FROM e WHERE NOT json_valid OR NOT status_match OR title_f1 < 0.7 OR time_f1 < 1 ORDER BY event_id LIMIT 200)
    SELECT f.*, round((SELECT count(*) FILTER (status_match) / count(*) FROM e), 6) AS is_schedule_acc FROM f"""
)
def workload_evaluation(spark, sf_dir):
    """The failures for the next plan, beside the accuracy of the round."""
    metrics, failed = run_evaluation(*gold_and_predictions(spark, sf_dir))
    accuracy = metrics.select(F.round("is_schedule_acc", 6).alias("is_schedule_acc"))
    # one row on the right
    return failed.select("scenario_id", "reason").join(F.broadcast(accuracy))
