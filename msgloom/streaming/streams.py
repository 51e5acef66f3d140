"""The ingestion steps on Structured Streaming.

The gates are the batch functions. State is small and bounded: the last CONTEXT_TURNS + 1
messages of a conversation, which time out with the context's age, and the events of a
(channel, start) that are young enough to merge, which a timer ends by periods. Rows of a batch are put in order of time;
rows later than a watermark are up to the caller's watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, StructField, StructType

from msgloom.functions import fixed
from msgloom.functions.text import blank
from msgloom.operators.conversation import gate
from msgloom.operators.events import EVENT_COLUMNS, arrival, fold_events
from msgloom.sources.io import export_candidates

BUFFERED = "event_id long, conversation string, channel string, sender string, body string, seconds long, seq long, clock string"
EVENTS = f"{EVENT_COLUMNS}, merged long"
#: Milliseconds after which an event can match none.
PERIOD = fixed.MERGE_DAYS * 86_400_000
LIFETIME = PERIOD + 1
#: Keys of the merging state, and slots of each: a key's rows of a batch are one task's at once, a slot is read whole.
BUCKETS = 1024
SLOTS = 16


def gated(stream: DataFrame, channels: DataFrame) -> DataFrame:
    """Messages (channel, message, received_at) that pass the gate; ``channels`` is a static frame."""
    return gate(stream, channels)


def buffer_step(rows: list[dict], kept: list[dict], seconds: int = fixed.REPEAT_SECONDS, turns: int = fixed.CONTEXT_TURNS, minutes: int = fixed.CONTEXT_MINUTES) -> list[dict]:
    """Takes messages of one conversation in order into ``kept``; those that repeat none, each with its context."""
    out = []
    for row in rows:
        last = kept[-1] if kept else None
        if last and (row["sender"], row["body"]) == (last["sender"], last["body"]) and row["seconds"] - last["seconds"] < seconds:
            continue
        before = [k for k in kept[-turns:] if row["seconds"] - k["seconds"] <= 60 * minutes] if row["channel"] != "gmail" else []
        out.append({**row, "context": json.dumps([[k["clock"], k["sender"], k["body"]] for k in before], ensure_ascii=False)})
        kept.append({k: row[k] for k in ("sender", "body", "seconds", "clock")})
        del kept[: -(turns + 1)]
    return out


def buffered(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Messages without repeats, each with its context as JSON; columns as in BUFFERED.

    Every message enters the buffer, blank ones too.
    Messages later than ``delay`` behind the newest are dropped; a conversation's buffer goes
    when none of its messages can be context any more.
    """
    names = [c.split()[0] for c in BUFFERED.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values(["seconds", "seq"])
        out = buffer_step(rows[names].to_dict("records"), kept)
        state.update((json.dumps(kept, ensure_ascii=False),))
        state.setTimeoutTimestamp(1000 * (kept[-1]["seconds"] + 60 * fixed.CONTEXT_MINUTES) + 1)
        yield pd.DataFrame(out, columns=[*names, "context"])

    timed = stream.select(*names, F.timestamp_seconds("seconds").alias("at")).withWatermark("at", delay)
    return timed.groupBy("conversation").applyInPandasWithState(step, f"{BUFFERED}, context string", "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def with_context(stream: DataFrame, delay: str = "1 day", channels: DataFrame | None = None) -> DataFrame:
    """The message flow's way into the buffer (``buffered``): blank messages never enter it.

    Nor do those of channels that the static frame ``channels`` (channel, enabled) does not
    have on, if it is given.
    """
    stream = stream.where(~blank(F.col("body")))
    if channels is not None:
        stream = stream.join(channels.where("enabled").select("channel"), "channel", "left_semi")
    return buffered(stream, delay)


def insert_or_ignore(stream: DataFrame, time: str, delay: str, key: str = "event_key") -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


class Merging(StatefulProcessor):
    """Events young enough to match: a key is a bucket of slots, an entry of its map the events of one slot and period, which a timer ends.

    A call to the state costs far more than an event, so there is one for each entry that rows
    touch, and none for single events or starts.
    """

    def __init__(self, names: list[str], group: list[str], values: StructType) -> None:
        self.names, self.group, self.values = names, group, values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "slot int, period int", self.values)

    def keep(self, slot: int, rows: list[dict], periods: set[int]) -> None:
        """Writes a slot's events of the given periods."""
        own: dict[int, list[tuple]] = {period: [] for period in periods}
        for row in rows:
            if period_of(row) in periods:
                own[period_of(row)].append(tuple(row[c] for c in self.names))
        for period, events in own.items():
            self.events.updateValue((slot, period), (events,))

    def end(self, periods: set[int]) -> None:
        for period in periods:
            self.handle.registerTimer((period + 1) * PERIOD + LIFETIME)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:  # noqa: N802, N803
        periods = {period_of(row) for row in initialState.rows}
        self.keep(initialState.slot, initialState.rows, periods)
        self.end(periods)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        held: dict[int, list[dict]] = {}
        for row in rows:
            held.setdefault(row.slot, []).append(row.row)
        stored: dict[int, list[dict]] = {slot: [] for slot in held}
        before = list(self.events.keys())  # in one call
        for at in before:
            if at[0] in held:
                stored[at[0]] += (dict(zip(self.names, event, strict=True)) for event in self.events.getValue(at)[0])
        place, made, new = itemgetter(*self.group), Row(*self.names), set()
        for slot, arrived in held.items():
            groups: dict[tuple, tuple[list[dict], list[dict]]] = {}
            for kind, own in enumerate((stored[slot], arrived)):
                for row in sorted(own, key=arrival):
                    groups.setdefault(place(row), ([], []))[kind].append(row)
            periods = set()
            for events, own in groups.values():
                touched = fold_events(own, events) if own else ()
                changed = [row for row in events if row["event_key"] in touched]
                periods |= {period_of(row) for row in changed}
                yield from (made(*(row[c] for c in self.names)) for row in changed)
            self.keep(slot, [row for events, _ in groups.values() for row in events], periods)
            new |= periods
        self.end(new - {period for _, period in before})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        for at in list(self.events.keys()):
            if (at[1] + 1) * PERIOD + LIFETIME <= expiredTimerInfo.getExpiryTimeInMs():
                self.events.removeKey(at)
        return iter(())

    def close(self) -> None:
        pass


def period_of(row: dict) -> int:
    return row["created_at"] // PERIOD


def merged_events(stream: DataFrame, owner: tuple[str, ...] = (), delay: str = "0 seconds", stored: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """T4: events made or changed by each batch, columns ``owner`` and EVENTS; the last row of an event_key holds.

    Owners, channels and starts are dealt by hash to ``buckets`` times SLOTS slots. State is a
    map of typed events by slot and period of MERGE_DAYS; a batch reads the slots that its rows
    touch and writes the periods that it changes there, so no owner's size matters and calls to
    the state don't grow with the starts. A slot should hold some hundred events: more buckets
    suit a larger state. A period leaves the state when the watermark, ``delay`` behind the
    newest ``created_at``, is more than MERGE_DAYS past its end, as nothing that may still
    arrive can match its events; rows later than the watermark are dropped. A key holds the
    time its message came, so a key that is forgotten with its event doesn't come again.
    ``stored``, a table of the result's columns, is the state that a first run begins with.
    Needs the RocksDB state store (``rocksdb``).
    """
    schema = StructType([stream.schema[c] for c in owner] + StructType.fromDDL(EVENTS).fields)
    values = StructType([StructField("events", ArrayType(schema))])
    group = [*owner, "channel", "start"]
    place = F.pmod(F.xxhash64(*group), F.lit(buckets * SLOTS)).cast("int")
    dealt = [(place / SLOTS).cast("int").alias("bucket"), (place % SLOTS).alias("slot")]
    cast = lambda df, *but: df.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields if f.name not in but))
    new = cast(stream, "merged").select(*dealt, F.struct("*").alias("row"), F.timestamp_millis("created_at").alias("arrived"))
    first = None
    if stored is not None:
        first = cast(stored).select(*dealt, F.struct("*").alias("row")).groupBy("bucket", "slot").agg(F.collect_list("row").alias("rows")).groupBy("bucket")
    return new.withWatermark("arrived", delay).groupBy("bucket").transformWithState(Merging(schema.names, group, values), schema, "Update", "EventTime", first)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, whose store alone holds maps and timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pull_new(mails: DataFrame, mark: Column, body: str = "body", at: str = "internal_millis") -> DataFrame:
    """T5: mails newer than the high-water mark whose body is not blank; ``next_mark`` of them advances it."""
    return mails.where((F.col(at) > mark) & F.coalesce(F.col(body).rlike(r"\S"), F.lit(False)))


def next_mark(pulled: DataFrame, mark: int, at: str = "internal_millis") -> int:
    newest = pulled.agg(F.max(at)).first()[0]
    return mark if newest is None else newest


def export_batch(spark: SparkSession, ledger_path: str, out_path: str):
    """A foreachBatch function that writes decided events no export has taken and appends their ids to the ledger.

    A batch that is run again writes its own folder over and finds its ids in the ledger
    under its own number, so nothing is exported twice or lost.
    """

    def run(batch: DataFrame, number: int) -> None:
        ledger = spark.createDataFrame([], "id long, batch long")
        try:
            ledger = spark.read.schema("id long, batch long").parquet(ledger_path)
        except Exception as error:  # noqa: BLE001  no ledger yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        fresh = export_candidates(batch, ledger.where(F.col("batch") != number))
        fresh.write.mode("overwrite").json(f"{out_path}/batch={number}")
        fresh.select("id", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(ledger_path)

    return run
