"""Keys, and forms of the received time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgloom.functions import fixed


def joined(*parts: Column) -> Column:
    """Parts joined by a bar; a missing part counts as empty text."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def judgement_key(message: Column, received_at: Column) -> Column:
    return F.md5(joined(message, received_at).cast("binary"))


def pair_key(channel: Column, message: Column, gold: Column) -> Column:
    """Key of a labelled pair; ``gold`` is JSON text with sorted keys, or a struct written so."""
    return F.md5(joined(channel, message, gold).cast("binary"))


def sorted_json(struct: Column, fields: list[str]) -> Column:
    """JSON of the fields in ascending order, nulls written."""
    return F.to_json(F.struct(*(struct[f].alias(f) for f in sorted(fields))), {"ignoreNullFields": "false"})


def event_key(channel: Column, received_at: Column, start: Column, title: Column) -> Column:
    return joined(channel, received_at, start, F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s+|\s+$", ""))


def conversation_key(channel: Column, room: Column, sender: Column) -> Column:
    in_room = F.concat(channel, F.lit(":room:"), room)
    return F.when(F.coalesce(room, F.lit("")).rlike(r"\S"), in_room).otherwise(F.concat(channel, F.lit(":"), F.coalesce(sender, F.lit(""))))


def iso_of(millis: Column, zone: str = fixed.DEFAULT_ZONE_NAME, offset: str = fixed.DEFAULT_ZONE) -> Column:
    """Epoch milliseconds as local ISO text with offset."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (millis / 1000).cast("decimal(18,6)")))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def clock_of(millis: Column, zone: str = fixed.DEFAULT_ZONE_NAME) -> Column:
    """Epoch milliseconds as local HH:mm."""
    return F.substring(iso_of(millis, zone), 12, 5)


def thread_json(thread: Column) -> Column:
    """A thread as JSON text; null without turns."""
    return F.when(F.size(thread) > 0, F.to_json(thread))
