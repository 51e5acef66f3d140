"""Messages to events: buffer, gates of both ways, prompt, prediction, resolution, route, merge, calendar rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgloom import schemas
from msgloom.functions.keys import event_key
from msgloom.functions.text import blank, json_block, unless_blank, user_block
from msgloom.operators import conversation, events
from msgloom.sources.io import normal_gold, prompt_text


def to_prompts(messages: DataFrame, channels: DataFrame, system: str, scraped: DataFrame | None = None) -> DataFrame:
    """Messages that pass their gate, with context and prompt.

    Received ones (``messages``) go through the buffer: blank ones and those of channels that
    are off never enter it; of the rest repeats go (W2) and each has the turns before it (W3);
    the gate (F4) asks for a cue in the message. Messages read off a screen (``scraped``, in
    both ways) bring their ``thread_context`` and pass if it holds the cue (F5), so a plain
    "yes" counts; they may have ``from_me`` and ``counterpart``, which received ones get as
    false and null. The columns are those of ``messages``, context, gate columns and these two.
    """
    heard = messages.join(channels.where("enabled").select("channel"), "channel", "left_semi").where(~blank(F.col("body")))
    rows = conversation.with_context(conversation.suppress_repeats(heard))
    rows = rows.withColumnRenamed("context", "thread_context").withColumn("message", F.col("body"))
    passed = conversation.gate(rows, channels).withColumns({"from_me": F.lit(False), "counterpart": F.lit(None).cast("string")})
    if scraped is not None:
        own = scraped.withColumn("message", F.col("body"))
        mine = F.coalesce("from_me", F.lit(False)) if "from_me" in own.columns else F.lit(False)
        other = F.col("counterpart") if "counterpart" in own.columns else F.lit(None).cast("string")
        own = own.withColumns({"from_me": mine, "counterpart": other})
        passed = passed.unionByName(conversation.two_way(own, channels).select(*passed.columns))
    block = user_block(F.col("channel"), F.col("received_at"), F.col("sender"), F.col("message"), F.col("thread_context"))
    return passed.withColumn("prompt", prompt_text(F.lit(system), block))


def to_events(predicted: DataFrame, aliases: DataFrame, today: Column, owner: tuple[str, ...] = (), stored: DataFrame | None = None) -> DataFrame:
    """Stored events of predictions (output, message): parsed, resolved, corrected, routed, with the roster's names, and merged into ``stored`` ones of the same ``owner``."""
    answer = json_block(F.col("output"))
    gold, given = normal_gold(answer), F.from_json(answer, schemas.ANY_GOLD)
    attendees = F.coalesce(given["attendees"], F.try_element_at(given["events"], F.lit(1))["attendees"])
    rows = predicted.withColumns({"gold": gold, "attendees": attendees}).where("gold.is_schedule")
    # the title of what I wrote names the other side, or nobody
    author = F.when(F.col("from_me"), unless_blank(F.col("counterpart"))).otherwise(F.col("sender")) if "from_me" in rows.columns else F.col("sender")
    rows = rows.withColumn("author", author).withColumn("event", events.resolved_event(F.col("received_at"), F.col("author"), F.col("gold")))
    created = (F.col("seconds") * 1000).alias("created_at")
    place_of = F.coalesce("author", "sender")
    flat = rows.select(*owner, "channel", F.col("sender").alias("from"), "author", place_of.alias("sender"), "room", "seq", created, "received_at", "message", "attendees", F.coalesce("gold.title", F.lit("")).alias("base_title"), "event.*")
    flat = events.correct_location(flat, aliases)
    flat = flat.withColumn("event_key", event_key(F.col("channel"), F.col("received_at"), F.col("start"), F.col("title")))
    routed = flat.withColumn("status", events.route(F.lit(True), F.col("title"), F.col("start"), today))
    named = events.with_roster_title(routed, "author").withColumn("sender", F.col("from")).drop("from", "author")
    return events.merge_events(named, stored, owner)


def to_calendar(stored: DataFrame) -> DataFrame:
    """D11 for the events that enter the calendar at once: ``stored`` with ``row``, those with a readable start."""
    event = F.struct("title", "start", "end", "all_day", "location", "description")
    added = stored.where(F.col("status") == "AUTO_ADDED")
    return added.withColumn("row", events.calendar_row(event, F.col("attendees"), F.lit(None).cast("string"))).where("row IS NOT NULL")
