"""Schedule events."""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from msgloom.functions import fixed
from msgloom.functions.text import blank, compose_title, is_physical, roster, stripped, unless_blank
from msgloom.functions.tokens import let, resolve_when
from msgloom.sources.staging import staged


def resolved_event(received_at: Column, sender: Column, gold: Column) -> Column:
    """The finished event of a flat record: absolute times, tagged title, no place that repeats the title."""
    return let(_event, when=resolve_when(received_at, gold["date"], gold["time"], gold["end_time"]), sender=sender, gold=gold)


def _event(when: Column, sender: Column, gold: Column) -> Column:
    place = unless_blank(gold["location"])
    repeats = stripped(place) == stripped(F.coalesce(gold["title"], F.lit("")))
    return F.struct(
        compose_title(gold["title"], sender).alias("title"),
        when["start"].alias("start"),
        when["end"].alias("end"),
        when["all_day"].alias("all_day"),
        F.when(~F.coalesce(repeats, F.lit(False)), place).alias("location"),
        gold["description"].alias("description"),
    )


def millis_of(iso: Column) -> Column:
    """Epoch milliseconds of ISO text; text without an offset is read in the default zone."""
    zoned = F.when(iso.rlike(r"([+-]\d{2}:?\d{2}|Z)$"), iso).otherwise(F.concat(F.when(F.length(iso) == 10, F.concat(iso, F.lit("T00:00:00"))).otherwise(iso), F.lit(fixed.DEFAULT_ZONE)))
    return F.unix_millis(F.try_to_timestamp(zoned))


def calendar_row(event: Column, attendees: Column, recurrence: Column) -> Column:
    """The row that a calendar stores; null without a readable start.

    An end is an hour after the start unless given; a whole day is midnight to midnight in
    UTC; a recurring event has a duration instead of an end; online places are no location.
    """
    return let(_calendar_row, event=event, attendees=attendees, recurrence=recurrence, start=millis_of(event["start"]), end=millis_of(event["end"]))


def _calendar_row(event: Column, attendees: Column, recurrence: Column, start: Column, end: Column) -> Column:
    day = F.unix_date(F.try_to_date(F.substring(event["start"], 1, 10), "yyyy-MM-dd")).cast("long") * 86_400_000
    names = F.filter(attendees, lambda a: ~blank(a))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit(fixed.PLACE_LINE), stripped(unless_blank(event["location"]))),
        F.when(F.size(names) > 0, F.concat(F.lit(fixed.ATTENDEES_LINE), F.array_join(names, ", "))),
        stripped(unless_blank(event["description"])),
    )
    recurs, whole = recurrence.isNotNull(), event["all_day"]
    return F.when(
        start.isNotNull(),
        F.struct(
            event["title"].alias("title"),
            F.when(is_physical(event["location"]), event["location"]).alias("location"),
            F.nullif(lines, F.lit("")).alias("description"),
            F.when(whole & ~recurs, day).otherwise(start).alias("start_millis"),
            F.when(~recurs, F.when(whole, day + 86_400_000).otherwise(F.coalesce(end, start + 3_600_000))).alias("end_millis"),
            F.when(recurs, F.lit("PT1H")).alias("duration"),
            (whole & ~recurs).alias("all_day"),
        ),
    )


def route(is_schedule: Column, title: Column, start: Column, today: Column) -> Column:
    """AUTO_ADDED for a titled event from ``today`` on, PENDING for any other, null for none."""
    day = F.try_to_date(F.substring(start, 1, 10), "yyyy-MM-dd")
    strict = ~blank(title) & ~blank(start) & (day >= today)
    return F.when(is_schedule, F.when(F.coalesce(strict, F.lit(False)), "AUTO_ADDED").otherwise("PENDING"))


def purge_past_pending(events: DataFrame, today: Column) -> DataFrame:
    """without pending events that start before ``today``; those without a start stay."""
    past = (F.col("status") == "PENDING") & (F.substring("start", 1, 10) < today.cast("string"))
    return events.where(~F.coalesce(past, F.lit(False)))


def purge_status(events: DataFrame, status: str) -> DataFrame:
    return events.where(~F.coalesce(F.col("status") == status, F.lit(False)))


def apply_actions(events: DataFrame, actions: DataFrame) -> DataFrame:
    """events after a log of actions (id, action, at); the latest of an id counts.

    registered_at is the action's time for registered events and null for others.
    """
    last = actions.groupBy("id").agg(F.max_by("action", F.struct("at", "action")).alias("action"), F.max("at").alias("at"))
    status = F.when(F.col("action") == "ADD", "ADDED").when(F.col("action").isin("DISMISS", "UNDO"), "DISMISSED").when(F.col("action") == "UNREGISTER", "PENDING")
    joined = events.join(last, "id", "left").withColumn("_new", status)
    registered = F.when(F.col("_new").isNull(), F.col("registered_at")).when(F.col("_new").isin("ADDED", "AUTO_ADDED"), F.col("at"))
    return joined.withColumn("registered_at", registered).withColumn("status", F.coalesce("_new", "status")).drop("_new", "action", "at")


def correct_location(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """No location where the sender has it marked as not a place (aliases: sender, token)."""
    marks = aliases.select(stripped(F.col("sender")).alias("_sender"), stripped(F.col("token")).alias("_token"), F.lit(True).alias("_marked")).distinct()
    joined = events.join(marks, (stripped(events["sender"]) == F.col("_sender")) & (stripped(events["location"]) == F.col("_token")), "left")
    return joined.withColumn("location", F.when(F.col("_marked").isNull(), F.col("location"))).drop("_sender", "_token", "_marked")


def learn_aliases(before: DataFrame, after: DataFrame, known: DataFrame) -> DataFrame:
    """Known marks and those of edits that cleared a place."""
    old = before.where(~blank(F.col("location"))).select("id", "sender", stripped(F.col("location")).alias("token"))
    cleared = after.where(blank(F.col("location"))).select("id")
    return known.select("sender", "token").union(old.join(cleared, "id", "left_semi").select("sender", "token")).distinct()


_DAY = 86_400_000
_PLACE = ("channel", "start", "room", "base_title", "created_at", "id")


def _latest_before(rows: DataFrame, key: str, marks: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each name in ``marks``, the latest (created_at, id) of the rows with its key, other than itself, that has the mark and is no younger.

    Rows of a key are dealt by the day they were created, so a key that holds many of them
    is spread; what an earlier day has reaches the later ones as one row a day.
    """
    at = F.struct("created_at", "id")
    parts = ("channel", "_start", key, "_day")
    earlier = Window.partitionBy(*parts).orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    together = Window.partitionBy(*parts, "created_at")
    own_day = {}
    for name, mark in marks.items():
        peer = F.max(F.when(mark, F.col("id"))).over(together)
        own_day[name] = F.when(peer > F.col("id"), F.struct(F.col("created_at"), peer.alias("id"))).otherwise(F.last(F.when(mark, at), ignorenulls=True).over(earlier))
    days = rows.groupBy(*parts).agg(*(F.max(F.when(mark, at)).alias(f"_day_{name}") for name, mark in marks.items()))
    before = Window.partitionBy("channel", "_start", key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*parts, *(F.max(f"_day_{name}").over(before).alias(f"_before_{name}") for name in marks))
    found = rows.withColumns(own_day).join(days, list(parts))
    return found.withColumns({name: F.coalesce(name, f"_before_{name}") for name in marks}).drop(*(f"_before_{name}" for name in marks))


def mergeable(events: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """For each new event the latest stored one it may merge into: new_id and id.

    Same channel, same start (null meets null), not dismissed, at most MERGE_DAYS old, and the
    same room or, with no contradicting room, the same base title. Without ``new`` the
    stored events are asked against each other. Ids are distinct, null channels meet none.
    """
    live = F.coalesce(F.col("status") != "DISMISSED", F.lit(False))
    if new is None:
        rows = events.select(*_PLACE, live.alias("_stored"), F.lit(True).alias("_asks"))
    else:
        both = new.select(*_PLACE, F.lit(False).alias("_stored"), F.lit(True).alias("_asks")).unionByName(events.select(*_PLACE, live.alias("_stored"), F.lit(False).alias("_asks")))
        # an event in both frames is one row
        rows = both.groupBy(*_PLACE).agg(F.max("_stored").alias("_stored"), F.max("_asks").alias("_asks"))
    # a null start is a value of its own
    start = F.coalesce(F.concat(F.lit("="), "start"), F.lit("none"))
    rows = staged(rows.where("channel IS NOT NULL").withColumns({"_start": start, "_day": F.floor(F.col("created_at") / _DAY)}))
    stored, roomless = F.col("_stored"), blank(F.col("room"))
    by_room = _latest_before(rows.where(~roomless), "room", {"met": stored}).where("_asks").select("id", F.lit(1).alias("in_room"), "created_at", "met")
    titled = _latest_before(rows.where(~blank(F.col("base_title"))), "base_title", {"met": stored, "met_roomless": stored & roomless}).where("_asks")
    # in a room of its own a title meets that of no room; that of the same room is found by the room
    by_title = titled.select("id", F.lit(0).alias("in_room"), "created_at", F.when(roomless, F.col("met")).otherwise(F.col("met_roomless")).alias("met"))
    near = by_room.unionByName(by_title).where(F.col("created_at") - F.col("met.created_at") <= fixed.MERGE_DAYS * _DAY)
    return near.groupBy(F.col("id").alias("new_id")).agg(F.max(F.struct("in_room", "met")).alias("best")).select("new_id", F.col("best.met.id").alias("id"))


def better_base(old: str, new: str) -> str:
    """The fuller of two base titles: a specific one before a general one, else the older."""
    if not new.strip():
        return old
    if not old.strip() or (old in fixed.GENERIC_TITLES and new not in fixed.GENERIC_TITLES):
        return new
    return old


class Fold:
    """Stored events of one owner, channel and start, into which later ones are taken in order of arrival.

    Only events that are young enough to match are held; of older ones the keys.
    """

    def __init__(self, stored: list[dict]) -> None:
        self.live: deque[dict] = deque()
        self.keys: set[str] = set()
        self.by_room: dict[str, dict] = {}
        self.by_title: dict[str, list[dict]] = {}
        for row in sorted(stored, key=arrival):
            self.store(row)

    def store(self, row: dict) -> None:
        self.keys.add(row["event_key"])
        self.live.append(row)
        if row["status"] != "DISMISSED":
            if (row["room"] or "").strip():
                self.by_room[row["room"]] = row
            self.by_title.setdefault(row["base_title"] or "", []).append(row)

    def aged(self, now: int) -> Iterator[dict]:
        """Takes out the events that are too old to match anything that arrives from ``now`` on."""
        while self.live and now - self.live[0]["created_at"] > fixed.MERGE_DAYS * _DAY:
            row = self.live.popleft()
            if self.by_room.get(row["room"]) is row:
                del self.by_room[row["room"]]
            for title in {row["base_title"] or "", row.get("_first_title", row["base_title"]) or ""}:
                kept = [r for r in self.by_title.get(title, []) if r is not row]
                if kept:
                    self.by_title[title] = kept
                else:
                    self.by_title.pop(title, None)
            row.pop("_first_title", None)
            yield row

    def newest_titled(self, base: str) -> dict | None:
        """The newest stored event that has this base title now; those that have changed it never get it again."""
        rows = self.by_title.get(base, [])
        while rows and (rows[-1]["base_title"] or "") != base:
            rows.pop()
        return rows[-1] if rows else None

    def take(self, row: dict) -> dict | None:
        """The event that the row made or changed; None if it is one that is stored already."""
        room, base = row["room"] or "", row["base_title"] or ""
        recent = lambda r: r is not None and row["created_at"] - r["created_at"] <= fixed.MERGE_DAYS * _DAY
        target = self.by_room.get(room) if room.strip() else None
        if not recent(target):
            target = self.newest_titled(base) if base.strip() else None
            if not recent(target) or (room.strip() and (target["room"] or "").strip() and target["room"] != room):
                target = None
        if target is not None:
            target["merged"] += 1
            best = better_base(target["base_title"] or "", base)
            if best != (target["base_title"] or "") and best.strip():
                target.setdefault("_first_title", target["base_title"])
                target["base_title"], target["title"] = best, best.strip()
                insort(self.by_title.setdefault(best, []), target, key=arrival)
            return target
        if row["event_key"] in self.keys:
            return None
        made = {**row, "merged": 0}
        self.store(made)
        return made


def arrival(row: dict) -> tuple[int, int]:
    return row["created_at"], row["seq"]


def fold_events(rows: list[dict], stored: list[dict]) -> set[str]:
    """Takes rows of one owner, channel and start, in order of arrival, into the list of stored events; the keys of those made or changed."""
    fold, touched = Fold(stored), set()
    for row in rows:
        event = fold.take(row)
        if event is not None:
            touched.add(event["event_key"])
    stored[:] = [{k: v for k, v in r.items() if k != "_first_title"} for r in fold.live]
    return touched


#: Columns that an event may have besides, as it was stored first.
CARRIED = {"attendees": "array<string>", "end": "string", "all_day": "boolean", "location": "string", "description": "string"}
EVENT_COLUMNS = "channel string, start string, room string, base_title string, sender string, title string, event_key string, status string, created_at long, seq long"


def merge_events(events: DataFrame, stored: DataFrame | None = None, owner: tuple[str, ...] = ()) -> DataFrame:
    """Events (columns of EVENT_COLUMNS) merged into ``stored`` ones: all events that are stored then.

    Each event, in order of arrival, joins the newest stored one of its room, else of its base
    title, else is stored unless its key is. Joining changes a title at most, never the time
    it counts from. ``merged`` counts what an event took in; the columns of CARRIED that are given stay
    those of the event that was stored. ``stored`` has the columns of the result.

    Matches need the same channel and start (null is a start like any other) and the same
    owner: ``owner`` names the columns that say whose store an event belongs to (a device, a
    user). The rows of one such store, channel and start are read in order as a stream, of
    which a task holds the events that are young enough to match; it is for the owner to keep
    that many small. An event without room and title can match none and is stored.
    """
    extra = "".join(f", `{c}` {kind}" for c, kind in CARRIED.items() if c in events.columns)
    kinds = StructType([events.schema[c] for c in owner])
    schema = StructType(kinds.fields + StructType.fromDDL(f"{EVENT_COLUMNS}, merged long{extra}").fields)
    names = [*schema.names]
    rows = events.select(*(c for c in names if c != "merged"), F.lit(0).cast("long").alias("merged"), F.lit(1).alias("_new"))
    if stored is not None:
        rows = rows.unionByName(stored.select(*names, F.lit(0).alias("_new")))
    group = [*owner, "channel", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, now, held = Fold([]), None, []
        shape = to_arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[c] for c in group)
                if key != now:
                    held += fold.live
                    fold, now = Fold([]), key
                if row.pop("_new"):
                    held += fold.aged(row["created_at"])
                    fold.take(row)
                else:
                    fold.store(row)
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in held], shape)
            held = []
        yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in fold.live], shape)

    in_order = rows.repartition(*group).sortWithinPartitions(*group, "_new", "created_at", "seq")
    return in_order.mapInArrow(run, schema)


def with_roster_title(events: DataFrame, author: str = "sender") -> DataFrame:
    """W4's first step: attendees with the message's numbered names, and the title composed anew where there are any; ``author`` is whom titles name."""
    names = roster(F.coalesce("message", F.lit("")))
    everyone = F.array_distinct(F.filter(F.concat(F.coalesce("attendees", F.array().cast("array<string>")), names), lambda a: ~blank(a)))
    retitled = F.when((F.size(names) > 0) & ~blank(F.col("base_title")), compose_title(F.col("base_title"), F.col(author))).otherwise(F.col("title"))
    return events.withColumn("title", retitled).withColumn("attendees", everyone)


def day_summary(events: DataFrame, day: Column, exported: DataFrame | None = None) -> DataFrame:
    """Per channel what was registered on ``day``, what is open from it on, and what no export has taken."""
    day_start = F.unix_date(day).cast("long") * 86_400_000
    registered = F.col("status").isin("ADDED", "AUTO_ADDED") & F.col("registered_at").between(day_start, day_start + 86_399_999)
    is_open = (F.col("status") == "PENDING") & (F.col("start").isNull() | (F.substring("start", 1, 10) >= day.cast("string")))
    waiting = F.col("status").isin("ADDED", "AUTO_ADDED", "DISMISSED") & ~F.coalesce(F.col("exported"), F.lit(False))
    return events.groupBy("channel").agg(F.count_if(registered).alias("registered"), F.count_if(is_open).alias("open"), F.count_if(waiting).alias("waiting"), (F.count_if(waiting) >= 10).alias("may_export"))


def predict(df: DataFrame, infer, output: str = "output") -> DataFrame:
    """G1: ``df`` with the text that ``infer(rows as dicts) -> texts`` gives for each batch."""
    schema = StructType([*df.schema.fields, StructField(output, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{output: list(infer(batch.to_dict("records")))})

    return df.mapInPandas(run, schema)
