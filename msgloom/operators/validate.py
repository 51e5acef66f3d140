"""Checking labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgloom.functions import fixed
from msgloom.functions.text import blank
from msgloom.functions.tokens import let, received_date, resolve_date


def _is(json: Column, opening: str) -> Column:
    """Whether JSON text is an object or an array; null stays null."""
    return F.regexp_replace(json, r"^\s+", "").startswith(opening)


def _defect(condition: Column, code: str, detail: Column | str = "") -> Column:
    """A struct of code and detail where the condition holds, else null."""
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(code).alias("code"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail")))


def _texts(json: Column, *names: str) -> Column:
    """The named values of a JSON object as texts in one struct: of one parse."""
    return F.from_json(json, "struct<" + ",".join(f"{n}:string" for n in names) + ">")


def issues(raw: Column) -> Column:
    """Defects of a row given as JSON text: an array of structs of code and detail.

    The text is needed since a typed read would hide wrong types. Each object is parsed
    once, into texts. An absent value and a JSON null are alike, but for keys that must be
    there.
    """
    return let(_row_issues, row=_texts(raw, "message", "gold", "received_at", "channel"), keys=F.json_object_keys(raw))


def _row_issues(row: Column, keys: Column) -> Column:
    is_object = row["gold"].isNull() & ~F.array_contains(keys, "gold") | _is(row["gold"], "{")
    absent = F.array(*(_defect(~F.array_contains(keys, name), "MISSING_FIELD", name) for name in ("message", "gold", "received_at", "channel")), _defect(~is_object, "GOLD_NOT_DICT"))
    gold = lambda absent, is_object, received, gold: F.array_compact(F.concat(absent, F.when(is_object, let(_gold_issues, gold=gold, received=received)).otherwise(_none())))
    return let(gold, absent=absent, is_object=is_object, received=received_date(row["received_at"]), gold=_texts(row["gold"], "schedule_status", "events"))


def _none() -> Column:
    return F.array().cast("array<struct<code:string,detail:string>>")


def _gold_issues(gold: Column, received: Column) -> Column:
    status, text = gold["schedule_status"], gold["events"]
    list_ok = text.isNull() | _is(text, "[")

    def of_gold(events: Column, status: Column, list_ok: Column, received: Column) -> Column:
        count = F.coalesce(F.size(events), F.lit(0))
        detected = F.coalesce(status.isin("yes", "pending"), F.lit(False))
        own = F.array(
            _defect(~F.coalesce(status.isin("yes", "pending", "no"), F.lit(False)), "HAS_SCHEDULE_BAD", F.coalesce(status, F.lit("null"))),
            _defect(~list_ok, "EVENTS_NOT_LIST"),
            _defect(list_ok & (detected != (count > 0)), "HAS_EVENTS_MISMATCH", F.concat_ws(" ", F.coalesce(status, F.lit("null")), count.cast("string"))),
        )
        return F.concat(own, F.coalesce(F.when(list_ok, F.flatten(F.transform(events, lambda e: _event_issues(e, received)))), _none()))

    return let(of_gold, events=F.from_json(text, "array<string>"), status=status, list_ok=list_ok, received=received)


def _event_issues(event: Column, received: Column) -> Column:
    fields = ("title", "date", "time", "all_day", "attendees")
    checked = let(_of_event, own=F.json_object_keys(event), e=_texts(event, *fields), received=received)
    return F.when(~F.coalesce(_is(event, "{"), F.lit(False)), F.array(_defect(F.lit(True), "EVENT_NOT_DICT"))).otherwise(checked)


def _of_event(own: Column, e: Column, received: Column) -> Column:
    title, date, time, guests = (e[n] for n in ("title", "date", "time", "attendees"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, fixed.EVENT_KEYS)), own))
    whole_day = F.coalesce(e["all_day"] == "true", F.lit(False))
    placed = F.array(
        _defect(F.size(missing) > 0, "EVENT_MISSING_KEYS", F.array_join(missing, ",")),
        _defect(blank(title), "EMPTY_TITLE"),
        _defect(~blank(title) & (F.length(title) > fixed.TITLE_LIMIT), "TITLE_TOO_LONG", F.length(title).cast("string")),
        _defect(date.isNotNull() & resolve_date(received, date).isNull(), "DATE_UNRESOLVABLE", date),
        _defect(date.isNull() & time.isNull() & ~whole_day, "UNPLACEABLE_EVENT"),
        _defect(time.isNotNull() & ~_is(time, "{"), "TIME_NOT_DICT", time),
        _defect(guests.isNotNull() & ~_is(guests, "["), "ATTENDEES_NOT_LIST", guests),
    )
    return F.concat(placed, F.when(_is(time, "{"), let(_time_issues, clock=_texts(time, "hour", "marker"))).otherwise(_none()))


def _time_issues(clock: Column) -> Column:
    hour, marker = clock["hour"], clock["marker"]
    number = F.when(hour.rlike(r"^-?\d+$"), hour.try_cast("int"))
    return F.array(
        _defect(~F.coalesce(number.between(0, 23), F.lit(False)), "TIME_HOUR_RANGE", F.coalesce(hour, F.lit("null"))),
        _defect(marker.isNotNull() & ~marker.isin(*fixed.MARKERS), "BAD_MARKER", marker),
        _defect((number >= 13) & marker.isin(*fixed.AFTERNOON_MARKERS, *fixed.MORNING_MARKERS), "MARKER_ON_24H", F.concat_ws(" ", hour, marker)),
    )


def has_abolished_keys(gold: Column) -> Column:
    """Gold JSON with a key of an older generation."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(gold), F.array(*map(F.lit, fixed.ABOLISHED_KEYS))), F.lit(False))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """A2: rows by class and the share of each; the total is a sum over the classes, so rows are read once."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))


def defect_counts(df: DataFrame, found: str = "issues") -> DataFrame:
    """A3: how often each code occurs and in how many rows."""
    codes = F.transform(found, lambda i: i["code"])
    # the outer form, as the other makes the optimiser compute the issues once more in a filter
    each = df.select(codes.alias("codes")).select("codes", F.explode_outer(F.array_distinct("codes")).alias("code"))
    times = F.size(F.filter("codes", lambda c: c == F.col("code")))
    return each.groupBy("code").agg(F.sum(times).alias("times"), F.count(F.lit(1)).alias("rows")).where("code IS NOT NULL")


def flagged(df: DataFrame, found: str = "issues", width: int = 80) -> DataFrame:
    """A3: rows with defects, their message cut to ``width`` for the report."""
    return df.where(F.size(found) > 0).withColumn("message", F.substring("message", 1, width))


def repeated_messages(df: DataFrame) -> DataFrame:
    """A4: kinds of messages that occur more than once and the rows beyond the first; blank ones left out."""
    kinds = df.where(~blank(F.col("message"))).groupBy(F.trim("message").alias("message")).count().where("count > 1")
    return kinds.agg(F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus"))


def attendee_frequency(df: DataFrame, top: int = 15) -> DataFrame:
    """A5: the most frequent attendees, with their share of all mentions and the count of distinct names."""
    names = df.select(F.explode("attendees").alias("attendee")).where(~blank(F.col("attendee")))
    counts = names.groupBy("attendee").agg(F.count(F.lit(1)).alias("times"))
    total = counts.agg(F.sum("times").alias("_all"), F.count(F.lit(1)).alias("distinct_names"))
    best = counts.orderBy(F.desc("times"), "attendee").limit(top)
    return best.join(F.broadcast(total)).select("attendee", "times", (F.col("times") / F.col("_all")).alias("share"), "distinct_names")


def cross_tab(df: DataFrame, rows: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``rows`` by the given values of ``column``."""
    return df.groupBy(rows).agg(*(F.count_if(F.col(column) == v).alias(str(v)) for v in values))


def length_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """Message lengths in equal bins from the shortest to the longest, closed on the right."""
    size = F.length(F.coalesce("message", F.lit("")))
    ends = df.agg(F.min(size).alias("lo"), F.max(size).alias("hi"))
    place = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((size - F.col("lo")) * bins / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))))).cast("int")
    return df.join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def outcomes(df: DataFrame) -> DataFrame:
    """Outcomes of a conversion."""
    return df.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


def successes_by_prefix(df: DataFrame) -> DataFrame:
    """Accepted rows by id without its trailing number."""
    return df.where(F.col("outcome").startswith("ok")).groupBy(F.regexp_replace("scenario_id", r"[_-]?\d+$", "").alias("prefix")).agg(F.count(F.lit(1)).alias("rows"))


def unresolved(df: DataFrame) -> DataFrame:
    """Positives whose date token does not resolve."""
    lost = F.col("is_schedule") & F.col("date").isNotNull() & resolve_date(received_date(F.col("received_at")), F.col("date")).isNull()
    return df.where(F.coalesce(lost, F.lit(False)))


def require_resolved(df: DataFrame) -> DataFrame:
    """``df``, or an error if any of its tokens does not resolve; asked before a write."""
    n = unresolved(df).count()
    if n:
        raise ValueError(f"{n} rows have date tokens that do not resolve")
    return df


def plan_balance(plan: DataFrame) -> DataFrame:
    """Shares of the planned rows against their least ones: name, share, target, ok."""
    total = F.greatest(F.lit(1), F.sum("count"))
    share = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)) / total
    checks = [("no_schedule", F.col("edge_case") == "no_schedule", 0.25), ("multi_event", F.col("edge_case") == "multi_event", 0.05), ("recurring", F.col("edge_case") == "recurring", 0.03), ("past_time", F.col("edge_case") == "past_time", 0.03)]
    checks += [(f"language_{k}", F.col("language") == k, t) for k, t in (("ko", 0.60), ("en", 0.25), ("mixed", 0.15))]
    found = plan.agg(F.array(*(F.struct(F.lit(n).alias("name"), share(c).alias("share"), F.lit(t).alias("target")) for n, c, t in checks)).alias("checks"))
    rows = found.select(F.explode("checks").alias("c")).select("c.*")
    close = F.when(F.col("name").startswith("language_"), F.abs(F.col("share") - F.col("target")) <= 0.1).otherwise(F.col("share") >= F.col("target"))
    return rows.withColumn("ok", close)


def misaligned(df: DataFrame, text: str = "text", prompt: str = "prompt") -> DataFrame:
    """Training texts that do not begin with their prompt followed by a JSON object."""
    rest = F.ltrim(F.substr(F.col(text), F.length(prompt) + 1, F.length(text)))
    return df.where(~F.coalesce(F.col(text).startswith(F.col(prompt)) & rest.startswith("{"), F.lit(False)))
