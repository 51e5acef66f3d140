"""Choosing training rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from msgloom.functions import fixed, substrings
from msgloom.functions.text import blank, has_surface_cue, normal, said_text, thread_text
from msgloom.functions.tokens import received_date, resolve_date
from msgloom.sources.staging import discard, staged

#: Golden texts that are searched in one pass, and groups in which a stratum is ranked first.
PART_TEXTS = 1 << 20
SALTS = 64


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in the given order; the exchange carries the key's hash."""
    rows = df.withColumn("_key", F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")))
    first = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_key", "_rank")


def append_missing(base: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """``base`` and the rows of ``new`` whose key it lacks, each key once."""
    fresh = keep_first(new, F.col(key), *order).join(base.select(key).distinct(), key, "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def pool_minus_keep(pool: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Pool rows whose key is not among the kept ones."""
    return pool.join(keep.select(key).distinct(), key, "left_anti")


def leaks(train: DataFrame, golden: DataFrame, train_text: str = "message", golden_text: str = "message") -> DataFrame:
    """Training rows whose normalised text is one of the golden set's; anti-joining them removes them."""
    marks = golden.select(F.xxhash64(normal(F.col(golden_text))).alias("_hash"), normal(F.col(golden_text)).alias("_text")).distinct()
    rows = train.withColumns({"_hash": F.xxhash64(normal(F.col(train_text))), "_text": normal(F.col(train_text))})
    return rows.join(marks, ["_hash", "_text"], "left_semi").drop("_hash", "_text")


def occurrences(train: DataFrame, golden: DataFrame, train_text: str = "message", golden_text: str = "message", least: int = 8) -> DataFrame:
    """Training rows in whose normalised text one of the golden set's occurs anywhere.

    Golden texts of fewer than ``least`` characters, which stand in other texts by chance,
    count where they are the whole text. The others are searched all at once by hashes of
    their blocks (``functions.substrings``), of which a task holds about 60 bytes a golden
    text; more than PART_TEXTS are dealt to parts, each in a pass over the training rows that
    are left. Null and blank golden texts occur nowhere.
    """

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield substrings.digests(batch.column(0).to_pylist(), least)

    marks = golden.select(normal(F.col(golden_text)).alias("_text")).where("_text <> ''").mapInArrow(marked, substrings.DIGESTS)
    marks = staged(marks.distinct())
    parts = max(1, -(-marks.count() // PART_TEXTS))
    part = F.pmod(F.xxhash64("short", "high"), F.lit(parts))
    rows = train.withColumn("_found", F.lit(False))
    for k in range(parts):
        held = train.sparkSession.sparkContext.broadcast(marks.where(part == k).toArrow())
        before, found = rows, F.col("_found")
        rows = before.withColumn("_found", found | F.coalesce(holds_any(held)(F.when(~found, normal(F.col(train_text)))), F.lit(False)))
        if k + 1 < parts:
            rows = staged(rows, before)
    discard(marks)
    return rows.where("_found").drop("_found")


def holds_any(marks):
    """A function of a text column: whether one of the broadcast texts (rows of ``substrings.DIGESTS``) occurs in it."""

    @F.pandas_udf(BooleanType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = substrings.Search(marks.value)
        for said in batches:
            yield pd.Series(search([(t or "").encode() for t in said]))

    return run


def agreed_negatives(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Generated negatives that an independent label confirms and no flag marks."""
    return rows.join(labels.select(key, "label", "flag"), key).where((F.col("label") == F.lit("no")) & F.col("flag").isNull()).drop("label", "flag")


def is_date_leak(events: Column, message: Column, thread: Column) -> Column:
    """a turn of a thread whose gold date is absolute though no text names a day."""
    absolute = F.exists(events, lambda e: F.coalesce(e["date"], F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}"))
    return F.coalesce((F.size(thread) > 0) & absolute & ~F.concat(F.coalesce(message, F.lit("")), thread_text(thread)).rlike(fixed.EXPLICIT_DAY), F.lit(False))


def without_confidence(events: Column) -> Column:
    """events without their confidence."""
    return F.transform(events, lambda e: e.dropFields("confidence"))


def without_meta(df: DataFrame) -> DataFrame:
    """without the columns whose names begin with an underscore."""
    return df.select(*(c for c in df.columns if not c.startswith("_")))


def without_boilerplate(events: Column) -> Column:
    """F16: events with stock descriptions set to null."""
    stock = lambda d: reduce(lambda a, b: a | b, (F.contains(d, F.lit(t)) for t in fixed.BOILERPLATE))
    return F.transform(events, lambda e: e.withField("description", F.when(~F.coalesce(stock(e["description"]), F.lit(False)), e["description"])))


def raised_confidence(is_schedule: Column, events: Column) -> Column:
    """clear events (date, hour and title there) of positives get a confidence of at least CLEAR_CONFIDENCE."""
    def raised(e: Column) -> Column:
        clear = is_schedule & e["date"].isNotNull() & e["time"]["hour"].isNotNull() & ~blank(e["title"]) & (e["confidence"] < fixed.CLEAR_CONFIDENCE)
        return e.withField("confidence", F.when(F.coalesce(clear, F.lit(False)), F.lit(fixed.CLEAR_CONFIDENCE)).otherwise(e["confidence"]))

    return F.transform(events, raised)


def grounding(is_schedule: Column, events: Column, message: Column, thread: Column) -> Column:
    """Share of the titles, places, organisers and attendees that the message or thread holds; 1 for negatives and nothing to check."""
    said = F.lower(said_text(message, thread))

    def words_in(value: Column) -> Column:
        words = F.filter(F.split(value, r"[\s,·/]+"), lambda w: F.length(w) >= 2)
        return F.contains(said, F.lower(value)) | F.exists(words, lambda w: F.contains(said, F.lower(w)))

    def checks(e: Column) -> Column:
        fields = F.array(*(F.when(~blank(e[f]), words_in(e[f])) for f in ("title", "location", "organizer")))
        people = F.transform(F.coalesce(e["attendees"], F.array().cast("array<string>")), lambda a: F.when(~blank(a), F.contains(said, F.lower(a))))
        return F.array_compact(F.concat(fields, people))

    every = F.flatten(F.transform(events, checks))
    hits = F.size(F.filter(every, lambda x: x))
    share = F.when(F.size(every) > 0, hits / F.size(every)).otherwise(1.0)
    return F.when(F.coalesce(is_schedule, F.lit(False)) & events.isNotNull(), share).otherwise(1.0)


def difficulty(is_schedule: Column, events: Column, message: Column, thread: Column) -> Column:
    """How near a row is to the edge: relative dates, bare hours, threads, short texts, no place."""
    e = F.try_element_at(events, F.lit(1))
    points = lambda condition, value: F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0.0)
    date = e["date"]
    relative = date.isNotNull() & ~F.substring(date, 1, 4).rlike(r"^\d+$") & ~F.contains(date, F.lit("월"))
    bare = e["time"].isNotNull() & e["time"]["marker"].isNull() & F.coalesce(e["time"]["hour"], F.lit(0)).between(1, 12)
    positive = (
        points(F.size(thread) > 0, 2.0)
        + F.when(date.isNull(), 1.0).otherwise(points(relative, 1.5))
        + points(bare, 1.0)
        + points(F.length(F.coalesce(message, F.lit(""))) < 20, 1.0)
        + points(F.coalesce(e["location"], F.lit("")) == "", 0.3)
    )
    return F.when(F.coalesce(is_schedule, F.lit(False)), positive).otherwise(F.when(has_surface_cue(message, thread), 1.0).otherwise(0.0))


def priority(seed: int, key: str = "pair_key") -> list[Column]:
    """Order within positives (grounded ones, difficulty, grounding) and negatives (difficulty); ties by a hash of key and seed."""
    positive = lambda c: F.desc(F.when(F.col("is_schedule"), c))
    return [positive(F.col("grounding") >= 0.6), F.desc("difficulty"), positive(F.col("grounding")), hash_order(F.col(key), seed)]


def hash_order(key: Column, seed: int) -> Column:
    """A repeatable shuffle."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def shuffled(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """All rows in the order of their hash, with shuffle_key and place from 1 on; ``key`` must be unique.

    Rows are dealt by ranges of the hash's first three digits, of which 4,096 counts at most
    are summed up; a row's place is that sum and its number among its range.
    """
    rows = df.withColumn("shuffle_key", hash_order(key, seed)).withColumn("_range", F.substring("shuffle_key", 1, 3))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = counts.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy("shuffle_key"))
    numbered = rows.repartitionByRange("_range").withColumn("_number", number)
    return numbered.join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_number")).drop("_range", "_number", "_before")


def first_of_classes(rows: DataFrame, need: dict[bool, int], label: str, *order: Column) -> tuple[DataFrame, int]:
    """The first ``need`` rows of each class in this order, and how many they are.

    Rows are dealt to tasks by ranges of the order, whose bounds Spark takes from a sample, and
    staged. Their counts by range and class, a few numbers a task, reach the driver. Ranges
    before a class's border are taken whole, only the border's own range is numbered: no task
    holds more than a range, however many rows are asked for.
    """
    dealt = staged(rows.repartitionByRange(F.col(label), *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(label, "_range").count().collect()
    whole, numbered, taken = F.lit(False), F.lit(False), 0
    number, most = F.col("_number"), F.lit(0)
    for value, wanted in need.items():
        left, border = wanted, None
        for part, rows_there in sorted((r["_range"], r["count"]) for r in counts if r[label] == value):
            if rows_there > left:
                border = part
                break
            left -= rows_there
        mine = F.col(label) == value
        taken += wanted if border is not None else wanted - left
        whole = whole | (mine if border is None else mine & (F.col("_range") < border))
        if border is not None and left:
            numbered = numbered | (mine & (F.col("_range") == border))
            most = F.when(mine, left).otherwise(most)
    in_range = Window.partitionBy(label, "_range").orderBy(*order)
    border_rows = dealt.where(numbered).withColumn("_number", F.row_number().over(in_range)).where(number <= most).drop("_number")
    return dealt.where(whole).unionByName(border_rows).drop("_range"), taken


def first_rows(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in this order, none of whose steps is a single task's."""
    return first_of_classes(rows.withColumn("_all", F.lit(True)), {True: n}, "_all", *order)[0].drop("_all")


def capped_selection(rows: DataFrame, cap: int, negative_share: float, seed: int = 0) -> DataFrame:
    """About ``cap`` rows with this share of negatives.

    ``rows`` are keyed (pair_key) with kind (keep or pool), real, is_schedule, grounding and
    difficulty. All kept rows stay; each class is filled from the pool in order of priority;
    a shortage is filled from what is left; a surplus loses synthetic rows, never real ones.
    Only counts reach the driver, and picks go by ranges of their order, so the cap may be of
    any size. The rows, which several picks read, are staged first, so they should be narrow.
    """
    rows = staged(rows)
    keep, pool = rows.where("kind = 'keep'"), rows.where("kind = 'pool'")
    n_keep, n_keep_pos = keep.agg(F.count(F.lit(1)), F.count_if("is_schedule")).first()
    want_neg = int(round(cap * negative_share))
    need = {True: max(0, cap - want_neg - n_keep_pos), False: max(0, want_neg - (n_keep - n_keep_pos))}
    picked, n_picked = first_of_classes(pool, need, "is_schedule", *priority(seed))
    chosen, total = keep.unionByName(picked), n_keep + n_picked
    by_hash = hash_order(F.col("pair_key"), seed)
    if total < cap:
        left = pool.join(chosen.select("pair_key"), "pair_key", "left_anti")
        chosen = chosen.unionByName(first_rows(left, cap - total, by_hash))
    elif total > cap:
        spare = first_rows(chosen.where(~F.col("real")), total - cap, by_hash)
        chosen = chosen.join(spare.select("pair_key"), "pair_key", "left_anti")
    return chosen


def quota(df: DataFrame, stratum: Column, quotas: dict[str, int], *order: str | Column) -> DataFrame:
    """The first rows of each stratum, up to its quota; a stratum without one gives none.

    One scan serves all strata: rows are ranked in SALTS groups of each first, so a large
    stratum is sorted by many tasks, and what is left of these by one.
    """
    if not quotas:
        return df.limit(0)
    most = F.element_at(F.create_map(*(F.lit(x) for item in quotas.items() for x in item)), F.col("_stratum"))
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = df.withColumn("_stratum", stratum).where(F.col("_stratum").isin(*quotas))
    rows = rows.withColumns({"_most": most, "_salt": F.pmod(F.spark_partition_id(), F.lit(SALTS))})
    for group in (("_stratum", "_salt"), ("_stratum",)):
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*by))).where(F.col("_place") <= F.col("_most"))
    return rows.drop("_stratum", "_most", "_salt", "_place")


def breakdown(df: DataFrame) -> DataFrame:
    """A1: positives, negatives and their share by channel, and in all (channel null)."""
    yes = F.coalesce(F.col("is_schedule"), F.lit(False))
    return df.rollup("channel").agg(F.count_if(yes).alias("positives"), F.count_if(~yes).alias("negatives"), F.count(F.lit(1)).alias("total"), (F.count_if(~yes) / F.count(F.lit(1))).alias("negative_share"))


def cue_shortcut(df: DataFrame) -> DataFrame:
    """A10: how much a date or time cue alone tells: P(positive | cue), base rate, cue rates, unresolved dates."""
    cue, yes = F.col("cue"), F.col("is_schedule")
    lost = yes & F.col("date").isNotNull() & resolve_date(received_date(F.col("received_at")), F.col("date")).isNull()
    ratio = lambda a, b: F.count_if(a) / F.greatest(F.lit(1), F.count_if(b))
    return df.agg(
        ratio(cue & yes, cue).alias("positive_given_cue"),
        ratio(yes, F.lit(True)).alias("base_rate"),
        ratio(cue & yes, yes).alias("cue_rate_positive"),
        ratio(cue & ~yes, ~yes).alias("cue_rate_negative"),
        F.count_if(lost).alias("unresolved"),
    )


def grounding_by_choice(df: DataFrame) -> DataFrame:
    """Mean grounding of chosen and cut rows."""
    return df.groupBy("selected").agg(F.avg("grounding").alias("grounding"), F.count(F.lit(1)).alias("rows"))
