"""Messages of a conversation.

W3 deals a room to tasks by time slices that overlap by the age of a context. W5's lists hold
distinct names, so a giant room streams through its task. W2 decides most rows by their
neighbour; runs of repeats within seconds go through a fold that holds one time, whatever
their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgloom.functions import fixed
from msgloom.functions.text import blank, has_cue, is_completed, is_payment
from msgloom.functions.tokens import let, received_date

#: Length of the slices by which a room is dealt.
SLICE_HOURS = 6


def ingest_gate(message: Column, received_at: Column, enabled: Column) -> Column:
    """text there, channel on, a cue, no completed or payment notice."""
    # bound once, since a filter below a projection takes the whole expressions of its columns in
    return F.coalesce(enabled, F.lit(False)) & let(lambda m, d: ~blank(m) & has_cue(m) & ~is_completed(m) & ~is_payment(m, d), m=message, d=received_date(received_at))


def two_way_gate(message: Column, received_at: Column, enabled: Column, thread: Column) -> Column:
    """as F4, but the cue may stand in any turn of the thread."""
    in_thread = F.coalesce(F.exists(thread, lambda t: has_cue(t["message"])), F.lit(False))
    said = let(lambda m, d, t: ~blank(m) & (has_cue(m) | t) & ~is_completed(m) & ~is_payment(m, d), m=message, d=received_date(received_at), t=in_thread)
    return F.coalesce(enabled, F.lit(False)) & said


def gate(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """F4 over a frame: ``channels`` says which are on; mail keeps no thread."""
    rows = messages.join(channels, "channel", "left")
    kept = rows.where(ingest_gate(F.col("message"), F.col("received_at"), F.col("enabled")))
    if "thread_context" in kept.columns:
        kept = kept.withColumn("thread_context", F.when(F.col("channel") != "gmail", F.col("thread_context")))
    return kept.drop("enabled")


def two_way(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """F5 over a frame whose messages bring their ``thread_context``."""
    rows = messages.join(channels, "channel", "left")
    return rows.where(two_way_gate(F.col("message"), F.col("received_at"), F.col("enabled"), F.col("thread_context"))).drop("enabled")


def suppress_repeats(df: DataFrame, conversation: str = "conversation", time: str = "seconds", order: str = "seq", same: tuple[str, ...] = ("sender", "body"), seconds: int = fixed.REPEAT_SECONDS) -> DataFrame:
    """Without messages that repeat the last kept one within ``seconds``.

    A repeat is measured against the last *kept* one, so in a chain every kept message is at
    least ``seconds`` after the one kept before it. A message that differs from the one before
    it, or comes ``seconds`` after it, is kept whatever came earlier. Only runs of two or more
    that this does not decide are folded: their rows are read in order as a stream, of which
    the time of the last kept one is held, so a sender that repeats itself for days costs no
    more a row than any other. A message without a time is kept and no later one is measured
    against it.
    """
    in_order = Window.partitionBy(conversation).orderBy(time, order)
    differs = F.lag(F.lit(True)).over(in_order).isNull()
    for c in same:
        differs = differs | ~F.lag(c).over(in_order).eqNullSafe(F.col(c))
    decided = differs | F.coalesce(F.col(time) - F.lag(time).over(in_order) >= seconds, F.lit(False))
    marked = df.withColumn("_new", F.when(decided, 1).otherwise(0))
    marked = marked.withColumns({"_run": F.sum("_new").over(in_order), "_next": F.lead("_new", 1, 1).over(in_order)})
    alone = (F.col("_new") == 1) & (F.col("_next") == 1)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last = None, None
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in (conversation, "_run", time))
            for room, number, at in zip(*columns, strict=True):
                if (room, number) != run:
                    run, last = (room, number), None
                kept = at is None or last is None or at - last >= seconds
                keep.append(kept)
                if kept and at is not None:
                    last = at
            yield batch.filter(pa.array(keep, pa.bool_()))

    # the runs of a giant room are dealt to several tasks
    repeated = marked.where(~alone).repartition(conversation, "_run").sortWithinPartitions(conversation, "_run", time, order)
    return marked.where(alone).unionByName(repeated.mapInArrow(fold, marked.schema)).drop("_new", "_run", "_next")


def with_context(df: DataFrame, conversation: str = "conversation", time: str = "seconds", order: str = "seq", turns: int = fixed.CONTEXT_TURNS, minutes: int = fixed.CONTEXT_MINUTES, hours: int = SLICE_HOURS) -> DataFrame:
    """The turns before each message, ``turns`` at most and ``minutes`` old at most, oldest first; mail has none.

    ``clock`` (HH:mm), sender and body of each are given. A room is dealt to tasks by slices of
    ``hours``. The messages of a slice's last ``minutes`` go to the next slice as well, where
    they are context only, so a message finds all that may be its context. A message without a
    time has no context and is none; those of a room form a slice.
    """
    span, reach = max(3600 * hours, 60 * minutes), 60 * minutes
    at = F.floor(F.col(time) / span)
    place = lambda number, own: F.struct(number.alias("slice"), F.lit(own).alias("own"))
    late = F.col(time) - at * span >= span - reach
    places = F.when(late, F.array(place(at, True), place(at + 1, False))).otherwise(F.array(place(at, True)))
    rows = df.withColumn("_place", F.explode(places))
    before = Window.partitionBy(conversation, "_place.slice").orderBy(time, order).rowsBetween(-turns, -1)
    seen = F.collect_list(F.struct(F.col(time).alias("at"), F.col("clock").alias("time"), F.col("sender"), F.col("body").alias("message"))).over(before)
    rows = rows.withColumn("_seen", seen).where("_place.own")
    recent = F.filter("_seen", lambda t: t["at"] >= F.col(time) - reach)
    context = F.when(F.col("channel") == "gmail", F.array().cast(THREAD)).otherwise(F.transform(recent, lambda t: F.struct(t["time"].alias("time"), t["sender"].alias("sender"), t["message"].alias("message"))))
    return rows.withColumn("context", context).drop("_place", "_seen")


THREAD = "array<struct<time:string,sender:string,message:string>>"


def with_roster(df: DataFrame, conversation: str = "conversation", order: str = "step", earlier: int = 3) -> DataFrame:
    """Step k of a conversation with the distinct names of steps 1 to k and the last messages before it."""
    so_far = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(conversation).orderBy(order).rowsBetween(-earlier, -1)
    # a name counts where it stands first, so a list never holds more than the distinct names
    is_first = F.row_number().over(Window.partitionBy(conversation, "name").orderBy(order)) == 1
    names = F.collect_list(F.when(F.col("_first"), F.col("name"))).over(so_far)
    # one exchange serves all three windows
    rows = df.repartition(conversation).withColumn("_first", is_first)
    return rows.withColumn("attendees", names).drop("_first").withColumn("earlier", F.collect_list("message").over(before))


def first_seen(df: DataFrame, room: str = "room", signature: tuple[str, ...] = ("from_me", "body"), order: tuple[str, ...] = ("seconds", "seq")) -> DataFrame:
    """The first row of each signature in a room.

    A plain minimum, not a window, so a signature that fills a room is combined on the map side.
    """
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(room, *signature).agg(first).select("row.*")
