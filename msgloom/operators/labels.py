"""Verdicts and labels that come from outside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from msgloom.functions.text import blank, location_grounded, normal


def not_done(df: DataFrame, *done: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key none of the earlier outputs has."""
    for out in done:
        df = df.join(out.select(key).distinct(), key, "left_anti")
    return df


def deficit(plan: DataFrame, made: DataFrame, batch: int = 10) -> DataFrame:
    """Scenarios that lack rows, with what they need and how many calls of ``batch`` that takes."""
    counts = made.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("produced"))
    rows = plan.join(counts, "scenario_id", "left").withColumn("produced", F.coalesce("produced", F.lit(0).cast("long")))
    need = F.col("count") - F.col("produced")
    return rows.where(need > 0).withColumn("need", need).withColumn("batches", F.ceil(F.col("need") / batch).cast("int"))


def batches(todo: DataFrame, batch: int = 10) -> DataFrame:
    """One row a call: scenario_id, call and size."""
    calls = todo.select("scenario_id", "need", F.explode(F.sequence(F.lit(1), F.col("batches"))).alias("call"))
    return calls.select("scenario_id", "call", F.least(F.lit(batch).cast("long"), F.col("need") - (F.col("call") - 1) * batch).alias("size"))


def progress(plan: DataFrame, made: DataFrame) -> DataFrame:
    """Rows made, planned, and their ratio."""
    total = plan.agg(F.sum("count").alias("target"))
    return made.agg(F.count(F.lit(1)).alias("produced")).join(F.broadcast(total)).withColumn("share", F.col("produced") / F.greatest(F.lit(1), F.col("target")))


def apply_verdicts(pairs: DataFrame, verdicts: DataFrame, key: str = "key") -> DataFrame:
    """Pairs with verdict and gold: accepted as they are, fixed with the fixed gold; anything else rejects."""
    v = verdicts.select(key, F.col("verdict").alias("_verdict"), "fixed_gold")
    rows = pairs.join(v, key, "left")
    fixes = (F.col("_verdict") == "fix") & F.col("fixed_gold").isNotNull()
    verdict = F.when(F.col("_verdict") == "accept", "accept").when(fixes, "fix").otherwise("reject")
    return rows.withColumn("gold", F.when(fixes, F.col("fixed_gold")).otherwise(F.col("gold"))).withColumn("verdict", verdict).drop("_verdict", "fixed_gold")


def apply_status(pairs: DataFrame, labels: DataFrame, key: str = "key") -> DataFrame:
    """Pairs (status, events) after a three-way label.

    No empties the events; yes or pending with events is set; without events the row stays a
    no and is flagged; a failed label changes nothing.
    """
    rows = pairs.join(labels.select(key, "label", "error"), key, "left")
    failed = F.col("error").isNotNull() | F.col("label").isNull()
    has = F.coalesce(F.size("events") > 0, F.lit(False))
    status = F.when(failed, F.col("status")).when(F.col("label") == "no", "no").when(has, F.col("label")).otherwise("no")
    flag = ~failed & F.col("label").isin("yes", "pending") & ~has
    events = F.when(~failed & (F.col("label") == "no"), F.slice("events", 1, 0)).otherwise(F.col("events"))
    return rows.select(*(c for c in pairs.columns if c not in ("status", "events")), status.alias("status"), events.alias("events"), F.coalesce(flag, F.lit(False)).alias("flagged"))


def guard_relabel(location: Column, attendees: Column, new_location: Column, new_attendees: Column, text: Column) -> Column:
    """Struct of location, attendees and dropped after a relabelling.

    A place is only filled in, and only if the text holds it; of old and new attendees those
    that the text holds stay; dropped are old ones that it does not.
    """
    nobody = F.array().cast("array<string>")
    place = F.when(~blank(location), location).when(~blank(new_location) & location_grounded(new_location, text), new_location)
    everyone = F.array_union(F.coalesce(attendees, nobody), F.coalesce(new_attendees, nobody))
    said = normal(text)
    kept = F.filter(everyone, lambda a: ~blank(a) & F.contains(said, normal(a)))
    return F.struct(place.alias("location"), kept.alias("attendees"), F.array_except(F.coalesce(attendees, nobody), kept).alias("dropped"))


def verdict_totals(df: DataFrame) -> DataFrame:
    """Rows by verdict and their percentage."""
    counts = df.groupBy("verdict").agg(F.count(F.lit(1)).alias("rows"))
    # a handful of verdicts
    return counts.withColumn("percent", 100 * F.col("rows") / F.sum("rows").over(Window.partitionBy()))


def relabel_changes(df: DataFrame) -> DataFrame:
    """Places filled in, attendees added and dropped, rows changed; of old and new columns."""
    nobody = F.array().cast("array<string>")
    old, new = F.coalesce("old_attendees", nobody), F.coalesce("new_attendees", nobody)
    filled = blank(F.col("old_location")) & ~blank(F.col("new_location"))
    added, dropped = F.size(F.array_except(new, old)), F.size(F.array_except(old, new))
    return df.agg(F.count_if(filled).alias("filled"), F.sum(added).alias("added"), F.sum(dropped).alias("dropped"), F.count_if(filled | (added > 0) | (dropped > 0)).alias("changed"))


def label(df: DataFrame, judge: Callable[[dict], str], output: str = "label") -> DataFrame:
    """``df`` with the text that ``judge`` gives for each row; an exception goes into ``error`` and fails nothing."""
    schema = StructType([*df.schema.fields, StructField(output, StringType()), StructField("error", StringType())])

    def one(row: dict) -> tuple[str | None, str | None]:
        try:
            return judge(row), None
        except Exception as error:  # noqa: BLE001  whatever the caller's judge raises
            return None, f"{type(error).__name__}: {error}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [one(r) for r in part.to_dict("records")]
            yield part.assign(**{output: [a for a, _ in got], "error": [b for _, b in got]})

    return df.mapInPandas(run, schema)
