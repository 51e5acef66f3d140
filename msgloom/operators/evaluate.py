"""Scoring predictions against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgloom import schemas
from msgloom.functions import fixed
from msgloom.functions.similarity import location_score, title_score
from msgloom.functions.text import is_yes, json_block
from msgloom.functions.tokens import let, resolve_when
from msgloom.operators.events import millis_of

#: The label is read as text, so that "yes" and true are told from a number.
PREDICTED = f"struct<is_schedule:string,title:string,date:string,time:{schemas.TIME},end_time:{schemas.TIME},location:string,description:string>"


def time_match(a: Column, b: Column) -> Column:
    """Both missing, the same date if either is a date only, else at most five minutes apart."""
    return let(lambda a, b: let(_times_match, a=a, b=b, at=millis_of(a), bt=millis_of(b)), a=a, b=b)


def _times_match(a: Column, b: Column, at: Column, bt: Column) -> Column:
    dates_only = ~F.contains(a, F.lit("T")) | ~F.contains(b, F.lit("T"))
    same = F.when(dates_only, F.substring(a, 1, 10) == F.substring(b, 1, 10)).otherwise(F.abs(at - bt) <= 1000 * fixed.TIME_TOLERANCE_SECONDS)
    return F.when(at.isNull() & bt.isNull(), True).when(at.isNull() | bt.isNull(), False).otherwise(same)


def score(gold: DataFrame, predictions: DataFrame, key: str = "scenario_id", output: str = "output") -> DataFrame:
    """Gold rows (flat gold struct, received_at) with the scores of their predictions; a missing one is a parse error."""
    # scoring costs more than this exchange, which a join of two large sides makes anyhow
    rows = gold.repartition(key).join(predictions.select(key, output).repartition(key), key, "left")
    rows = rows.withColumn("_answer", let(_answer, block=json_block(F.col(output))))
    rows = rows.withColumns({"pred": F.col("_answer.pred"), "json_valid": F.coalesce("_answer.valid", F.lit(False))})
    g, p = F.col("gold"), F.col("pred")
    when = lambda r: resolve_when(F.col("received_at"), r["date"], r["time"], r["end_time"])["start"]
    rows = rows.withColumns({"gold_has": F.coalesce(g["is_schedule"], F.lit(False)), "pred_has": is_yes(p["is_schedule"]), "gold_start": when(g), "pred_start": when(p)})
    valid = lambda s: F.when(F.col("json_valid"), s)
    # equal tokens resolve to equal times, so only the others are resolved for the score
    tokens_equal = g["date"].eqNullSafe(p["date"]) & g["time"].eqNullSafe(p["time"]) & g["end_time"].eqNullSafe(p["end_time"])
    same_time = F.when(tokens_equal, True).otherwise(time_match(when(g), when(p)))
    return rows.withColumns(
        {
            "status_match": F.col("json_valid") & (F.col("gold_has") == F.col("pred_has")),
            "title_f1": valid(title_score(g["title"], p["title"])),
            "time_f1": valid(same_time.cast("double")),
            "loc_f1": valid(location_score(g["location"], p["location"])),
        }
    ).drop("_answer")


def _answer(block: Column) -> Column:
    """Whether the text is JSON, and its fields if so."""
    valid = F.try_parse_json(block).isNotNull()
    return F.struct(valid.alias("valid"), F.when(valid, F.from_json(block, PREDICTED)).alias("pred"))


def metrics(scored: DataFrame) -> DataFrame:
    """A6-A8 in one aggregation: rates over all rows, detection by class, quality on true positives that have a title."""
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    valid, gold, pred = F.col("json_valid"), F.col("gold_has"), F.col("pred_has")
    hit = valid & gold & pred & (F.coalesce(F.col("gold.title"), F.lit("")) != "")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / n
    on_hits = lambda c: F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0.0)) / F.greatest(F.lit(1), F.count_if(hit))
    base = scored.agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(valid) / n).alias("json_valid_rate"),
        (F.count_if("status_match") / n).alias("is_schedule_acc"),
        total(F.col("title_f1")).alias("title_f1_avg"),
        total(F.col("time_f1")).alias("time_match_rate"),
        total(F.col("loc_f1")).alias("location_f1_avg"),
        F.count_if(gold).alias("n_pos"),
        F.count_if(~gold).alias("n_neg"),
        (F.count_if(valid & gold & pred) / F.greatest(F.lit(1), F.count_if(gold))).alias("recall_pos"),
        (F.count_if(valid & ~gold & ~pred) / F.greatest(F.lit(1), F.count_if(~gold))).alias("specificity_neg"),
        F.count_if(valid & ~gold & pred).alias("overfire_count"),
        F.count_if(gold & ~(valid & pred)).alias("missed_count"),
        F.count_if(hit).alias("tp_n"),
        on_hits("title_f1").alias("tp_title_avg"),
        on_hits("time_f1").alias("tp_time_acc"),
        on_hits("loc_f1").alias("tp_loc_avg"),
    )
    fields = (F.col("title_f1_avg") + F.col("time_match_rate") + F.col("location_f1_avg")) / 3
    return base.withColumn("final_score", 0.25 * F.col("json_valid_rate") + 0.30 * F.col("is_schedule_acc") + 0.45 * fields)


def failures(scored: DataFrame) -> DataFrame:
    """rows that did not parse, mislabelled or scored low, with the reason."""
    low = ~F.col("status_match") | (F.col("title_f1") < 0.7) | (F.col("time_f1") < 1.0)
    reason = F.when(~F.col("json_valid"), "json_parse_error").when(F.coalesce(low, F.lit(False)), "score_low")
    return scored.withColumn("reason", reason).where("reason IS NOT NULL")


def next_round(failed: DataFrame, key: str = "scenario_id", most: int = 200) -> DataFrame:
    """the failures that the next plan is made from, the first ``most`` by id."""
    return failed.withColumn("reason", F.coalesce("reason", F.lit("score_low"))).orderBy(key).limit(most)


def audit(scored: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Over-fired, missed and hit rows with their rounded scores."""
    gold, pred = F.col("gold_has"), F.col("json_valid") & F.col("pred_has")
    section = F.when(~gold & pred, "overfired").when(gold & ~pred, "missed").when(gold & pred, "hit")
    rounded = [F.round(c, 3).alias(c) for c in ("title_f1", "time_f1", "loc_f1")]
    return scored.withColumn("section", section).where("section IS NOT NULL").select("section", key, F.col("gold.title").alias("gold_title"), F.col("pred.title").alias("pred_title"), "gold_start", "pred_start", *rounded)
