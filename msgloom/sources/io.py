"""Sources and sinks.

Time stamps stay text on reading: inferring them would lose the local offset.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from msgloom import schemas
from msgloom.functions import fixed
from msgloom.functions.keys import iso_of
from msgloom.functions.text import blank, is_yes, strip_html, stripped, unless_blank
from msgloom.functions.tokens import let
from msgloom.sources.staging import staged


def read_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Labelled pairs from JSON lines; blank lines give no row, gold stays JSON text."""
    rows = spark.read.schema("value string").text(path).where(~blank(F.col("value")))
    return rows.select(F.from_json("value", schemas.PAIR).alias("p")).select("p.*")


def write_pairs(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """JSON lines with nulls written; the count is what ``df`` observes under ``written``."""
    seen = df.observe("written", F.count(F.lit(1)).alias("rows"))
    seen.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return seen


def append_new(df: DataFrame, path: str, key: str) -> None:
    """S3: appends the rows whose key is not yet in the folder, so a restarted job goes on where it stopped."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(df.schema).json(path).select(key).distinct()
        df = df.join(done, key, "left_anti")
    except Exception as error:  # noqa: BLE001  the folder isn't there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def sms_pairs(df: DataFrame, prefix: str = "sms") -> DataFrame:
    """Exported messages (id, date_millis, sender, body, split) as pairs with a split column."""
    return df.select(
        F.concat(F.lit(f"{prefix}_"), F.col("id").cast("string")).alias("scenario_id"),
        iso_of(F.col("date_millis")).alias("received_at"),
        F.lit("sms").alias("channel"),
        "sender",
        F.col("body").alias("message"),
        "split",
    )


def by_split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split).drop("split")


def join_parts(df: DataFrame) -> DataFrame:
    """Parts (msg_id, part_no, body) of one delivery joined in order."""
    parts = F.sort_array(F.collect_list(F.struct("part_no", "body")))
    return df.groupBy("msg_id").agg(F.array_join(F.transform(parts, lambda p: F.coalesce(p["body"], F.lit(""))), "").alias("body"))


def chat_pairs(df: DataFrame) -> DataFrame:
    """Captured chat messages; an empty thread becomes null."""
    return df.withColumn("thread_context", F.when(F.size("thread_context") > 0, F.col("thread_context"))).withColumn("channel", F.lit("kakaotalk"))


@F.pandas_udf(StringType())
def _in_charset(data: pd.Series, charset: pd.Series) -> pd.Series:
    def text(raw: bytes | None, name: str) -> str | None:
        if raw is None:
            return None
        try:
            return raw.decode(name, "replace")
        except LookupError:  # a charset that does not exist
            return raw.decode("utf-8", "replace")

    return pd.Series([text(raw, name) for raw, name in zip(data, charset, strict=True)])


def decode_part(data: Column, charset: Column | None = None) -> Column:
    """Base64url as text of its charset (UTF-8 if null or unknown); empty if it is no base64, bad bytes become U+FFFD."""
    binary = F.try_to_binary(F.translate(data, "-_", "+/"), F.lit("base64"))
    plain = F.make_valid_utf8(binary.cast("string"))
    if charset is None:
        return F.coalesce(plain, F.lit(""))
    other = ~F.lower(charset).isin("utf-8", "utf8", "us-ascii")
    return F.coalesce(F.when(F.coalesce(other, F.lit(False)), _in_charset(F.when(other, binary), F.when(other, charset))).otherwise(plain), F.lit(""))


#: What the walk needs of a node of a payload; children stay text until their level.
NODE = "mimeType string, headers array<struct<name:string,value:string>>, body struct<data:string>, parts array<string>"


def mail_parts(mails: DataFrame) -> DataFrame:
    """Parts (mail_id, part_ord, mime, charset, data, subject) of nested mail payloads (mail_id, payload as JSON).

    The tree is walked level by level; ``part_ord`` is the path to a part, and paths sort in
    depth-first order. HTML comes after the parts below it, plain text ends its branch. A
    payload that is no JSON, or has no part with data, gives one part without any.
    """
    header = lambda name: F.get(F.filter("node.headers", lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]
    level = mails.select("mail_id", F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("subject"), F.from_json("payload", NODE).alias("node"))
    level = level.withColumn("subject", header("subject"))
    found, waiting = None, True
    while waiting:
        level = staged(level)
        mime = F.col("node.mimeType")
        charset = F.regexp_extract(header("content-type"), r"(?i)charset=[\"']?([A-Za-z0-9_.:-]+)", 1)
        own = F.when(mime == "text/html", F.concat("path", F.array(F.lit(2_147_483_647)))).otherwise(F.col("path"))
        here = level.select("mail_id", own.alias("part_ord"), mime.alias("mime"), F.nullif(charset, F.lit("")).alias("charset"), F.col("node.body.data").alias("data"), "subject")
        found = here if found is None else found.unionByName(here)
        ends = (mime == "text/plain") & (F.coalesce(F.col("node.body.data"), F.lit("")) != "")
        below = level.where(~F.coalesce(ends, F.lit(False))).select("mail_id", "path", "subject", F.posexplode("node.parts").alias("at", "text"))
        level = below.select("mail_id", F.concat("path", F.array("at")).alias("path"), "subject", F.from_json("text", NODE).alias("node"))
        waiting = not below.isEmpty()
    return found


def mail_text(parts: DataFrame) -> DataFrame:
    """Parts (mail_id, part_ord, mime, data, subject, and charset if known) as one body a mail.

    The first part in order with text counts: plain text as it is, HTML without its tags.
    ``part_ord`` is a number or a path of ``mail_parts``.
    """
    said = decode_part(F.col("data"), F.col("charset") if "charset" in parts.columns else None)
    said = parts.withColumn("said", said)
    text = F.when(F.col("mime") == "text/plain", F.col("said")).when(F.col("mime") == "text/html", strip_html(F.col("said")))
    rows = said.select("mail_id", "part_ord", "subject", text.alias("text"))
    first = F.min_by("text", F.when(~blank(F.col("text")), F.col("part_ord")))
    mails = rows.groupBy("mail_id").agg(F.max("subject").alias("subject"), first.alias("text"))
    body = F.concat(F.when(~blank(F.col("subject")), F.concat("subject", F.lit("\n"))).otherwise(""), F.coalesce("text", F.lit("")))
    return mails.select("mail_id", stripped(body).alias("body"))


def normal_gold(raw: Column) -> Column:
    """Gold JSON of any of the three generations as the flat record.

    The label is the first of the three flags that is there; fields are those at the top, or
    of the first event; older fields become lines of the description.
    """
    return let(_flat_gold, g=F.from_json(raw, schemas.ANY_GOLD), keys=F.json_object_keys(raw))


def _flat_gold(g: Column, keys: Column) -> Column:
    label = F.when(g["is_schedule"].isNotNull(), is_yes(g["is_schedule"])).when(g["schedule_status"].isNotNull(), F.lower(stripped(g["schedule_status"])) == "yes").otherwise(is_yes(g["has_schedule"]))
    flat = F.arrays_overlap(keys, F.array(F.lit("title"), F.lit("date"), F.lit("time")))
    event = F.try_element_at(g["events"], F.lit(1))
    use_event = ~F.coalesce(flat, F.lit(False)) & event.isNotNull()
    fields = ("title", "date", "time", "end_time", "location", "description", "attendees", "organizer", "recurrence")
    said = F.struct(*(F.when(use_event, event[name]).otherwise(g[name]).alias(name) for name in fields))
    return F.when(g.isNotNull(), let(_flat_record, label=label, said=said))


def _flat_record(label: Column, said: Column) -> Column:
    text = lambda name: F.nullif(said[name], F.lit(""))
    attendees = F.nullif(F.array_join(said["attendees"], ", "), F.lit(""))
    line = lambda lead, value: F.when(value.isNotNull(), F.concat(F.lit(lead), value))
    description = F.concat_ws("\n", text("description"), line(fixed.ATTENDEES_LINE, attendees), line(fixed.ORGANIZER_LINE, text("organizer")), line(fixed.RECURRENCE_LINE, text("recurrence")))
    return F.struct(
        label.alias("is_schedule"),
        text("title").alias("title"),
        text("date").alias("date"),
        said["time"].alias("time"),
        said["end_time"].alias("end_time"),
        text("location").alias("location"),
        F.nullif(description, F.lit("")).alias("description"),
    )


def read_feedback(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Feedback files but for review files; ``bad_line`` holds a line that does not parse."""
    rows = spark.read.text(paths).select("value", F.input_file_name().alias("file"))
    rows = rows.where(~F.col("file").rlike(r"_review\.jsonl$") & ~blank(F.col("value")))
    schema = f"{schemas.PAIR}, _feedback string, bad_line string"
    return rows.select("file", F.from_json("value", schema, {"columnNameOfCorruptRecord": "bad_line"}).alias("p")).select("file", "p.*")


def split_outputs(df: DataFrame, accepted: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; a null verdict rejects."""
    ok = F.coalesce(accepted, F.lit(False))
    return df.where(ok), df.where(~ok)


def export_candidates(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Decided events that no export has taken yet; appending their ids to the ledger marks them."""
    decided = events.where(F.col("status").isin("ADDED", "AUTO_ADDED", "DISMISSED"))
    return decided.join(ledger.select("id").distinct(), "id", "left_anti")


def chat_messages(system: Column, user: Column, gold: Column, folds_system: bool = False) -> Column:
    """Turns of a training conversation; without a system role its text opens the user's turn."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    if folds_system:
        return F.array(turn("user", F.concat(system, F.lit("\n\n"), user)), turn("assistant", gold))
    return F.array(turn("system", system), turn("user", user), turn("assistant", gold))


def chat_text(turns: Column) -> Column:
    """Turns in ChatML."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["content"], F.lit("<|im_end|>\n"))), "")


def prompt_text(system: Column, user: Column, think_prefill: bool = True) -> Column:
    """The same up to where the model goes on, with an empty think block."""
    start = F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return F.concat(start, F.lit("<think>\n\n</think>\n\n")) if think_prefill else start


def union_sources(sources: list[tuple[DataFrame, str, bool]]) -> DataFrame:
    """Sources (frame, kind, real) in order, with source_ord, kind and real; missing columns are null."""
    marked = [df.withColumns({"source_ord": F.lit(k), "kind": F.lit(kind), "real": F.lit(real)}) for k, (df, kind, real) in enumerate(sources)]
    out = marked[0]
    for df in marked[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def generated_rows(df: DataFrame, scenario_id: str = "scenario_id", text: str = "text") -> DataFrame:
    """Rows of a generator's output: back-ticks stripped, blank and # lines and bad JSON dropped, the scenario id filled in."""
    lines = df.select(scenario_id, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace(stripped(F.col("line")), "^`+|`+$", "")).where(~blank(F.col("line")) & ~F.col("line").startswith("#"))
    good = lines.where(F.try_parse_json(F.col("line")).isNotNull() & F.col("line").startswith("{"))
    parsed = good.select(F.col(scenario_id).alias("own_id"), "line_no", F.from_json("line", schemas.PAIR).alias("p"))
    return parsed.select("line_no", F.coalesce(unless_blank(F.col("p.scenario_id")), F.col("own_id")).alias("scenario_id"), *(F.col(f"p.{c}") for c in ("received_at", "channel", "sender", "message", "gold")))
