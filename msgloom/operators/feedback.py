"""User feedback and older rows turned into labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgloom import schemas
from msgloom.functions.text import drop_personlike_location
from msgloom.functions.tokens import derive_time, number, parse_date, parse_time, received_date, relativize_date, resolve_when

GOLD = f"struct<has_schedule:boolean,schedule_status:string,is_schedule:boolean,events:array<{schemas.EVENT}>>"


def gold_for(edited_json: Column, status: Column, model_json: Column) -> Column:
    """Gold JSON of a decided event: the user's edit, a negative for a dismissal, the model's own for an addition; else null."""
    edited = F.when(F.try_parse_json(edited_json).isNotNull(), edited_json)
    own = F.when(F.try_parse_json(model_json).isNotNull(), F.to_json(sanitised(F.from_json(model_json, GOLD))))
    negative = F.lit('{"schedule_status":"no","events":[]}')
    return F.when(edited_json.isNotNull(), edited).when(status == "DISMISSED", negative).when(status.isin("ADDED", "AUTO_ADDED"), own)


def sanitised(gold: Column) -> Column:
    """Gold whose events have no place that is an attendee's name."""
    return gold.withField("events", F.transform(gold["events"], lambda e: e.withField("location", drop_personlike_location(e["location"], e["attendees"]))))


def feedback_pairs(df: DataFrame) -> DataFrame:
    """Feedback rows (message, received_at, feedback, gold JSON) with gold struct, methods, review and skip_reason.

    Dates of edited positives become tokens; ``review`` marks those that the message does not
    write so. Rows with bad gold or a bad received_at get a skip_reason and no gold.
    """
    gold = F.when(F.try_parse_json("gold").isNotNull(), F.from_json("gold", GOLD))
    labelled = gold["has_schedule"].isNotNull() | gold["schedule_status"].isNotNull() | gold["is_schedule"].isNotNull()
    positive = F.coalesce(gold["has_schedule"], gold["schedule_status"].isin("yes", "pending"), gold["is_schedule"], F.lit(False))
    received = received_date(F.col("received_at"))
    edited = (F.col("feedback") == "EDITED") & positive
    skip = F.when(~F.coalesce(labelled, F.lit(False)), "bad_gold").when(edited & received.isNull(), "bad_received_at")
    rows = df.withColumns({"_gold": gold, "_edited": F.coalesce(edited, F.lit(False)), "_received": received, "skip_reason": skip})
    told = F.transform("_gold.events", lambda e: relativize_date(F.col("_received"), e["date"], F.col("message")))
    rows = rows.withColumn("_told", F.when(F.col("_edited") & F.col("skip_reason").isNull(), told))
    events = F.when(F.col("_told").isNotNull(), F.zip_with("_gold.events", "_told", lambda e, t: e.withField("date", t["value"]))).otherwise(F.col("_gold.events"))
    methods = F.coalesce(F.transform("_told", lambda t: t["method"]), F.array().cast("array<string>"))
    rows = rows.withColumns({"methods": methods, "gold": F.when(F.col("skip_reason").isNull(), F.col("_gold").withField("events", events))})
    return rows.withColumn("review", F.arrays_overlap("methods", F.array(F.lit("canonical"), F.lit("absolute-kept")))).drop("_gold", "_edited", "_received", "_told")


def feedback_report(df: DataFrame) -> DataFrame:
    """Counts by kind of feedback, by date method and by reason of skipping: section, name, rows."""
    entry = lambda section, name: F.struct(F.lit(section).alias("section"), name.alias("name"))
    kept = F.when(F.col("skip_reason").isNull(), entry("feedback", F.col("feedback"))).otherwise(entry("skipped", F.col("skip_reason")))
    entries = F.concat(F.array(kept), F.transform("methods", lambda m: entry("method", m)))
    # the outer form, as the other makes the optimiser compute the methods once more in a filter
    rows = df.select(entries.alias("entries")).select(F.explode_outer("entries").alias("e")).select("e.*")
    return rows.groupBy("section", "name").agg(F.count(F.lit(1)).alias("rows"))


def tokens_from_absolute(df: DataFrame) -> DataFrame:
    """Rows (message, received_at, events with start, end, all_day) with outcome, date, time and end_time.

    The token and time read from the message count only if resolving them gives the stored
    start and end again.
    """
    event = F.try_element_at("events", F.lit(1))
    start, end = event["start"], event["end"]
    whole = F.coalesce(event["all_day"], F.lit(False)) | ~F.coalesce(F.contains(start, F.lit("T")), F.lit(False))
    end_time = F.when(F.contains(end, F.lit("T")), derive_time(number(end, r"^.{11}(\d{2})"), number(end, r"^.{14}(\d{2})")))
    none = F.lit(None).cast(schemas.TIME)
    rows = df.withColumns({"date": parse_date(F.col("message")), "_clock": parse_time(F.col("message")), "_end": end_time})
    by_day = resolve_when(F.col("received_at"), F.col("date"), none, none)["start"]
    by_time = resolve_when(F.col("received_at"), F.col("date"), F.col("_clock"), F.col("_end"))
    same_day = F.coalesce(F.substring(by_day, 1, 10) == F.substring(start, 1, 10), F.lit(False))
    same_time = F.coalesce(by_time["start"] == start, F.lit(False)) & (F.coalesce(end, F.lit("")).isin("") | F.coalesce(by_time["end"] == end, F.lit(False)))
    outcome = (
        F.when(F.coalesce(F.size("events"), F.lit(0)) != 1, "multi_event")
        .when(F.col("date").isNull(), "no_date_token")
        .when(whole, F.when(same_day, "ok_allday").otherwise("date_mismatch"))
        .when(F.col("_clock").isNull(), "no_time")
        .when(same_time, "ok")
        .otherwise("roundtrip_fail")
    )
    rows = rows.withColumn("outcome", outcome)
    ok = F.col("outcome") == "ok"
    return rows.withColumns({"time": F.when(ok, F.col("_clock")), "end_time": F.when(ok, F.col("_end")), "date": F.when(F.col("outcome").startswith("ok"), F.col("date"))}).drop("_clock", "_end")
