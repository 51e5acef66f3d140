"""Queries over messages: tokens, text rules, gates, conversations, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.functions import fixed, keys, text, tokens
from msgloom.operators import conversation, events
from msgloom.queries import duck
from msgloom.queries.frames import MAIL, MESSAGES, TURNS
from msgloom.queries.registry import query
from msgloom.sources import io
from msgloom.sources.staging import shared_folder
from msgloom.sources.store import merge_into_store, read_store

M = f"WITH m AS ({MESSAGES.sql})"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MESSAGES.spark(spark, sf_dir)


def clock(prefix: str = "") -> Column:
    """The time struct of a row that has one."""
    made = tokens.time_struct(F.col("hour"), F.col("minute"), F.col("marker"))
    return F.when(F.col("has_time"), made)


def gold() -> Column:
    none = F.lit(None).cast("struct<hour:int,minute:int,marker:string>")
    return F.struct(F.col("title"), F.col("date"), clock().alias("time"), none.alias("end_time"), F.col("place").alias("location"), F.lit(None).cast("string").alias("description"))


@query(f"{M}, t AS (SELECT event_id, recv, {duck.clean('date')} AS tok FROM m) SELECT event_id, CAST({duck.resolve_date('recv', 'tok')} AS DATE) AS resolved FROM t")
def d1_resolve_date(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", tokens.resolve_date(F.col("recv"), F.col("date")).alias("resolved"))


@query(f"{M} SELECT event_id, CASE WHEN has_time THEN {duck.resolve_time('hour', 'minute', 'marker', 'recv_minute')} END AS resolved FROM m")
def d2_resolve_time(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", tokens.resolve_time(clock(), F.col("recv_minute")).alias("resolved"))


WHEN = f"""{M}, t AS (SELECT *, {duck.clean('date')} AS tok FROM m),
d AS (SELECT *, CAST({duck.resolve_date('recv', 'tok')} AS DATE) AS found FROM t),
w AS (SELECT *, CASE WHEN found IS NULL AND date IS NULL AND has_time THEN recv ELSE found END AS on_day, {duck.resolve_time('hour', 'minute', 'marker', 'recv_minute')} AS on_time FROM d),
s AS (SELECT *, CASE WHEN has_time THEN strftime(on_day, '%Y-%m-%d') || 'T' || on_time || ':00+09:00' ELSE strftime(on_day, '%Y-%m-%d') END AS start, NOT has_time AS all_day FROM w)"""


@query(f"{WHEN} SELECT event_id, start, CASE WHEN has_time AND k % 2 = 0 THEN strftime(on_day, '%Y-%m-%d') || printf('T18:%02d:00+09:00', minute) END AS \"end\", all_day FROM s")
def d3_resolve_when(spark, sf_dir):
    """An end at six in the evening for even k."""
    end = F.when(F.col("k") % 2 == 0, tokens.time_struct(F.lit(6), F.col("minute"), F.lit("저녁")))
    when = tokens.resolve_when(F.col("received_at"), F.col("date"), clock(), end)
    return messages(spark, sf_dir).select("event_id", when.alias("w")).select("event_id", "w.start", "w.end", "w.all_day")


@query(f"{M} SELECT event_id, received_at || ' (' || substr('{fixed.WEEKDAYS}', CAST(isodow(recv) AS INT), 1) || ')' AS shown FROM m")
def d4_with_weekday(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", tokens.with_weekday(F.col("received_at")).alias("shown"))


@query(
    f"""WITH t AS ({TURNS.sql}), g AS (SELECT conv_id, max(turn) AS last, string_agg('[] ' || role || ': ' || text, chr(10) ORDER BY turn) FILTER (turn > 0) AS rest, max(text) FILTER (turn = 0) AS first FROM t GROUP BY conv_id)
    SELECT conv_id, '<채널: chat>' || chr(10) || '<수신시각: 2026-06-15T10:00:00+09:00 (월)>' || chr(10) || '<발신자: user>' || coalesce(chr(10) || '<대화내역>' || chr(10) || rest || chr(10) || '</대화내역>', '') || chr(10) || '<메시지>' || chr(10) || coalesce(first, '') || chr(10) || '</메시지>' AS block FROM g"""
)
def d5_user_block(spark, sf_dir):
    rows = TURNS.spark(spark, sf_dir)
    turn = F.when(F.col("turn") > 0, F.struct("turn", F.lit(None).cast("string").alias("time"), F.col("role").alias("sender"), F.col("text").alias("message")))
    threads = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("thread"), F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("first"))
    return threads.select("conv_id", text.user_block(F.lit("chat"), F.lit("2026-06-15T10:00:00+09:00"), F.lit("user"), F.col("first"), F.col("thread")).alias("block"))


def _guess(days: float, unit: str, step: int, least: int) -> str:
    n = f"CAST(round(ahead / {days}) AS INT) + ({step})"
    return f"CASE WHEN ahead >= {least} AND {n} >= 1 THEN ({n}) || '{unit}' END"


LETTER = f"substr('{fixed.WEEKDAYS}', CAST(isodow(target) AS INT), 1)"
GUESSES = [
    "CASE ahead " + " ".join(f"WHEN {n} THEN '{w}'" for w, n in fixed.DAY_WORDS.items()) + " END", "day(target) || '일'",
    *(f"'{w}' || {LETTER}" for w in fixed.WEEK_WORDS), *(f"'{w}'" for w in fixed.WEEKEND_WORDS), "CASE WHEN ahead >= 7 AND ahead % 7 = 0 THEN (ahead // 7) || '주후' END",
    *(_guess(30.0, "개월후", k, 28) for k in (-1, 0, 1)), *(_guess(365.0, "년후", k, 365) for k in (0, 1)), "CASE WHEN ahead >= 1 THEN ahead || '일후' END",
]
#: Token and method of every message's date, as ``told``.
TOLD_DATES = f"""{M}, t AS (SELECT *, {duck.clean('date')} AS tok FROM m), d AS (SELECT *, CAST({duck.resolve_date('recv', 'tok')} AS DATE) AS target, date_diff('day', recv, target) AS ahead FROM t),
    c AS (SELECT event_id, recv, target, body, u.p AS p, u.c AS c FROM d, LATERAL (SELECT unnest(range(1, {len(GUESSES) + 1})) AS p, unnest([{', '.join(GUESSES)}]) AS c) u WHERE target IS NOT NULL),
    v AS (SELECT event_id, p, c, strpos(replace(body, ' ', ''), c) > 0 AS said FROM c WHERE c IS NOT NULL AND CAST({duck.resolve_date('recv', 'c')} AS DATE) = target),
    f AS (SELECT event_id, arg_min(c, p) FILTER (said) AS in_message, arg_min(c, p) AS first_fit FROM v GROUP BY event_id),
    told AS (SELECT d.*, coalesce(in_message, first_fit, strftime(target, '%Y-%m-%d')) AS token, CASE WHEN target IS NULL THEN 'passthrough' WHEN in_message IS NOT NULL THEN 'message-match' WHEN first_fit IS NOT NULL THEN 'canonical' ELSE 'absolute-kept' END AS method FROM d LEFT JOIN f ON d.event_id = f.event_id)"""


@query(f"{TOLD_DATES} SELECT event_id, token, method FROM told")
def d6_relativize(spark, sf_dir):
    """The absolute dates of all messages, however far ahead, as tokens with the way they were found."""
    rows = messages(spark, sf_dir).withColumn("target", tokens.resolve_date(F.col("recv"), F.col("date")))
    told = tokens.relativize_date(F.col("recv"), F.col("target").cast("string"), F.col("body"))
    return rows.select("event_id", told.alias("told")).select("event_id", F.col("told.value").alias("token"), F.col("told.method").alias("method"))


def _first(pattern: str, build: str) -> str:
    return f"WHEN regexp_matches(body, '{pattern}') THEN {build.replace('$1', f"regexp_extract(body, '{pattern}', 1)").replace('$2', f"regexp_extract(body, '{pattern}', 2)")}"


@query(
    f"""{M} SELECT event_id, CASE {' '.join(f"WHEN strpos(body, '{w}') > 0 THEN '{w}'" for w in fixed.DAY_WORDS)}
    {_first('((?:이번|다음) ?주말)', "replace($1, ' ', '')")} {_first('(이번주|다음주|다다음주) ?([월화수목금토일])요일?', '$1 || $2')}
    {_first('([0-9]+) ?일 ?후', "$1 || '일후'")} {_first('([0-9]+) ?주 ?후', "$1 || '주후'")} {_first('([0-9]+) ?개월 ?후', "$1 || '개월후'")}
    {_first('([0-9]{1,2}) ?월 ?([0-9]{1,2}) ?일', "CAST($1 AS INT) || '월' || CAST($2 AS INT) || '일'")}
    {_first('(?:^|[^0-9])([0-9]{1,2})/([0-9]{1,2})(?:$|[^0-9])', "CAST($1 AS INT) || '/' || CAST($2 AS INT)")}
    {_first('([월화수목금토일])요일', "$1 || '요일'")} {_first('(?:^|[^0-9])([0-9]{1,2}) ?일(?:$|[^후간짜째])', "CAST($1 AS INT) || '일'")} END AS token FROM m"""
)
def d7_parse_date(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", tokens.parse_date(F.col("body")).alias("token"))


@query(
    f"""{M}, c AS (SELECT event_id, body, regexp_matches(body, '[0-9]{{1,2}} ?시') AS spoken, CASE {' '.join(f"WHEN strpos(body, '{w}') > 0 THEN '{w}'" for w in fixed.TEXT_MARKERS)} END AS marker FROM m)
    SELECT event_id, CAST(CASE WHEN spoken THEN regexp_extract(body, '([0-9]{{1,2}}) ?시', 1) ELSE nullif(regexp_extract(body, '([0-9]{{1,2}}):([0-9]{{2}})', 1), '') END AS INT) AS hour,
    CASE WHEN spoken THEN CASE WHEN regexp_matches(body, '[0-9]{{1,2}} ?시 ?반') THEN 30 ELSE coalesce(TRY_CAST(regexp_extract(body, '[0-9]{{1,2}} ?시 ?([0-9]{{1,2}})', 1) AS INT), 0) END ELSE TRY_CAST(regexp_extract(body, '([0-9]{{1,2}}):([0-9]{{2}})', 2) AS INT) END AS minute,
    CASE WHEN spoken OR regexp_matches(body, '[0-9]{{1,2}}:[0-9]{{2}}') THEN marker END AS marker FROM c"""
)
def d8_parse_time(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", tokens.parse_time(F.col("body")).alias("t")).select("event_id", "t.hour", "t.minute", "t.marker")


@query(f"{M} SELECT event_id, CASE WHEN hour % 24 = 0 THEN 12 ELSE hour % 24 END AS token_hour, CASE WHEN hour % 24 = 0 THEN '자정' WHEN hour % 24 < 12 THEN '오전' WHEN hour % 24 = 12 THEN '정오' END AS token_marker, CASE WHEN hour % 12 = 0 THEN 12 ELSE hour % 12 END AS form_hour, CASE WHEN hour % 24 < 12 THEN '오전' ELSE '오후' END AS form_marker FROM m")
def d9_derive_time(spark, sf_dir):
    h = F.col("hour") % 24
    rows = messages(spark, sf_dir).select("event_id", tokens.derive_time(h, F.col("minute")).alias("a"), tokens.edited_time(h, F.col("minute")).alias("b"))
    return rows.select("event_id", F.col("a.hour").alias("token_hour"), F.col("a.marker").alias("token_marker"), F.col("b.hour").alias("form_hour"), F.col("b.marker").alias("form_marker"))


NAME = f"trim(replace(sender, '{fixed.WEB_MARK}', ''))"
MACHINE = f"(strpos({NAME}, '@') > 0 OR regexp_full_match(regexp_replace({NAME}, '[-+() ]', '', 'g'), '[0-9]{{7,}}'))"
TAG = f"CASE WHEN sender IN ({duck.quoted(fixed.SELF_NAMES)}) OR {MACHINE} THEN NULL WHEN split_part({NAME}, ' ', 2) <> '' THEN split_part({NAME}, ' ', 1) || '(' || split_part({NAME}, ' ', 2) || ')' ELSE {NAME} END"
TITLE = f"CASE WHEN coalesce(title, '') = '' THEN '{fixed.DEFAULT_TITLE}' ELSE trim(title) END"
TITLED = f"CASE WHEN tag IS NOT NULL AND strpos(base, tag) = 0 THEN base || ' [' || tag || ']' ELSE base END"


@query(f"{WHEN}, n AS (SELECT *, {TAG} AS tag, {TITLE} AS base FROM s) SELECT event_id, {TITLED} AS title, start, all_day, CASE WHEN nullif(trim(place), '') IS NULL OR trim(place) = trim(coalesce(title, '')) THEN NULL ELSE place END AS location FROM n")
def d10_event_build(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", events.resolved_event(F.col("received_at"), F.col("sender"), gold()).alias("e")).select("event_id", "e.title", "e.start", "e.all_day", "e.location")


ONLINE = " OR ".join(f"strpos(lower(trim(place)), '{k}') > 0" for k in fixed.ONLINE_PLACES)


@query(
    f"""{WHEN}, e AS (SELECT *, nullif(trim(place), '') AS at_place, start IS NOT NULL AND (all_day OR substr(start, 12, 2) <> '24') AS ok, CAST(epoch_ms(CAST(on_day AS TIMESTAMP)) AS BIGINT) AS midnight FROM s),
    c AS (SELECT *, CASE WHEN all_day THEN midnight WHEN ok THEN CAST(midnight + (CAST(substr(start, 12, 2) AS BIGINT) * 60 + CAST(substr(start, 15, 2) AS BIGINT) - 540) * 60000 AS BIGINT) END AS millis FROM e)
    SELECT event_id, CASE WHEN ok AND at_place IS NOT NULL AND NOT ({ONLINE}) THEN place END AS location, CASE WHEN ok AND at_place IS NOT NULL THEN '{fixed.PLACE_LINE}' || at_place END AS description,
    CASE WHEN ok AND all_day AND recurs THEN millis - 32400000 WHEN ok THEN millis END AS start_millis, CASE WHEN ok AND NOT recurs THEN CASE WHEN all_day THEN millis + 86400000 WHEN k % 2 = 0 THEN millis + 3600000 ELSE millis END END AS end_millis,
    CASE WHEN ok AND recurs THEN 'PT1H' END AS duration, ok AND all_day AND NOT recurs AS all_day FROM (SELECT *, k % 10 = 7 AS recurs FROM c)"""
)
def d11_calendar_row(spark, sf_dir):
    """All messages; no end for even k, a recurring event for k that end in 7; without a readable start, as of a bare hour 24, the fields are null."""
    return calendar_rows(messages(spark, sf_dir)).select("event_id", *(f"r.{c}" for c in ("location", "description", "start_millis", "end_millis", "duration")), F.coalesce("r.all_day", F.lit(False)).alias("all_day"))


def calendar_rows(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("w", tokens.resolve_when(F.col("received_at"), F.col("date"), clock(), F.when(F.col("k") % 2 == 1, clock())))
    event = F.struct(F.col("title"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.all_day").alias("all_day"), F.col("place").alias("location"), F.lit(None).cast("string").alias("description"))
    row = events.calendar_row(event, F.array().cast("array<string>"), F.when(F.col("k") % 10 == 7, "weekly"))
    return rows.select("event_id", row.alias("r"))


@query(f"{M}, n AS (SELECT *, {TAG} AS tag, {TITLE} AS base FROM m) SELECT event_id, {TITLED} AS shown FROM n")
def d13_compose_title(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", text.compose_title(F.col("title"), F.col("sender")).alias("shown"))


@query(f"{M} SELECT event_id, {MACHINE} AS machine, split_part({NAME}, ' ', 1) AS name, nullif(split_part({NAME}, ' ', 2), '') AS affiliation FROM m")
def d14_d15_senders(spark, sf_dir):
    s = text.split_sender(F.col("sender"))
    return messages(spark, sf_dir).select("event_id", text.is_machine_sender(F.col("sender")).alias("machine"), s["name"].alias("name"), s["affiliation"].alias("affiliation"))


@query(f"{M} SELECT event_id, CASE WHEN length(trim(place)) >= 2 AND (strpos(trim(sender), trim(place)) > 0 OR strpos(trim(place), trim(sender)) > 0) THEN NULL ELSE place END AS location FROM m")
def d17_personlike_location(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", text.drop_personlike_location(F.col("place"), F.array("sender")).alias("location"))


@query(f"""{M} SELECT event_id, '{{"title":"' || coalesce(title, '') || '"}}' AS block FROM m""")
def d18_json_block(spark, sf_dir):
    """Answers with think blocks and fences around the JSON."""
    body = F.concat(F.lit('{"title":"'), F.coalesce("title", F.lit("")), F.lit('"}'))
    fence = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    k = F.col("k") % 4
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("ok ```x``` then "), fence)).when(k == 2, F.concat(F.lit("<think>\nhm ```{}``` </think>\n"), fence)).otherwise(F.concat(F.lit("<think></think> "), body))
    return messages(spark, sf_dir).select("event_id", text.json_block(answer).alias("block"))


LINK = "CASE WHEN strpos(lower(u), 'zoom.us') > 0 THEN '줌 링크' WHEN strpos(lower(u), 'naver.me') > 0 THEN '지도' ELSE '링크' END"


@query(f"""{M}, l AS (SELECT event_id, list_transform(regexp_extract_all(body, 'https?://[^ <>"'')\\]]+'), lambda x: regexp_replace(x, '[.,!?]+$', '')) AS urls FROM m) SELECT event_id, coalesce(array_to_string(list_transform(list_distinct_keep, lambda u: {LINK} || '=' || u), ' '), '') AS links FROM (SELECT event_id, list_filter(urls, lambda x, i: list_position(urls, x) = i) AS list_distinct_keep FROM l)""")
def d19_links(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", F.array_join(F.transform(text.links(F.col("body")), lambda x: F.concat_ws("=", x["label"], x["url"])), " ").alias("links"))


ROSTER = f"list_filter(list_transform(regexp_extract_all(body, '[0-9]{{1,2}} *[.)] *([가-힣]{{2,5}}|[A-Za-z][A-Za-z ]{{1,14}})', 1), lambda x: trim(x)), lambda x: x NOT IN ({duck.quoted(fixed.ROSTER_STOP)}) AND x <> '')"


@query(f"""{M}, l AS (SELECT event_id, {ROSTER} AS names FROM m) SELECT event_id, coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ','), '') AS roster FROM l""")
def d20_roster(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", F.array_join(text.roster(F.col("body")), ",").alias("roster"))


HTML = "regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g')"
for pattern, swap in (("<[^>]+>", " "), ("&nbsp;|&amp;|&lt;|&gt;|&#[0-9]+;", " "), ("[ \\t]+", " "), ("\\n{3,}", "\n\n")):
    HTML = f"regexp_replace({HTML}, '{pattern}', '{swap}', 'g')"


@query(f"SELECT page_id, md5(regexp_replace({HTML}, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')) AS text_md5 FROM pages")
def d21_strip_html(spark, sf_dir):
    return MAIL.spark(spark, sf_dir).select("page_id", F.md5(text.strip_html(F.col("html")).cast("binary")).alias("text_md5"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '홍 길동' WHEN 1 THEN 'p' || page_id || '@x.com' ELSE url END AS shown FROM pages")
def d22_clean_from(spark, sf_dir):
    address = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("@x.com"))
    k = F.col("page_id") % 3
    header = F.when(k == 0, F.concat(F.lit(' "홍 길동" <'), address, F.lit(">"))).when(k == 1, F.concat(F.lit(" <"), address, F.lit("> "))).otherwise(F.concat(F.col("url"), F.lit("  ")))
    return MAIL.spark(spark, sf_dir).select("page_id", text.clean_from(header).alias("shown"))


PERSONAL = f"((regexp_full_match({NAME}, '[가-힣]{{2,4}}') OR (regexp_full_match({NAME}, '[A-Za-z]+([ \\t][A-Za-z]+){{0,2}}') AND length({NAME}) BETWEEN 2 AND 20)) AND NOT regexp_matches({NAME}, '(?i){fixed.ORGANISATION}'))"


@query(f"{M}, b AS (SELECT event_id, sender FROM m UNION ALL SELECT -1 - event_id, 'Sender ' || event_type FROM m) SELECT event_id, {PERSONAL} AS personal FROM b")
def d24_personal_name(spark, sf_dir):
    """The senders, and names in Latin letters made of the kinds of events."""
    rows = messages(spark, sf_dir)
    latin = rows.select((-1 - F.col("event_id")).alias("event_id"), F.concat(F.lit("Sender "), "event_type").alias("sender"))
    return rows.select("event_id", "sender").union(latin).select("event_id", text.is_personal_name(F.col("sender")).alias("personal"))


@query(f"{M}, n AS (SELECT event_id, lower(regexp_replace(coalesce(place, ''), '[ \\t\\n]+', '', 'g')) AS p, lower(regexp_replace(body, '[ \\t\\n]+', '', 'g')) AS b FROM m) SELECT event_id, p AS place, p <> '' AND (strpos(b, p) > 0 OR (({' OR '.join(f"strpos(p, '{k}') > 0 OR strpos('{k}', p) > 0" for k in fixed.ONLINE_TOOLS)}) AND ({' OR '.join(f"strpos(b, '{k}') > 0" for k in fixed.ONLINE_TOOLS)}))) AS grounded FROM n")
def d27_d28_grounded_location(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", text.normal(F.col("place")).alias("place"), text.location_grounded(F.col("place"), F.col("body")).alias("grounded"))


@query(f"{M} SELECT event_id, md5(coalesce(body, '') || '|' || received_at) AS judgement_key, md5(channel || '|' || body || '|' || '{{\"date\":' || coalesce('\"' || date || '\"', 'null') || ',\"title\":' || coalesce('\"' || title || '\"', 'null') || '}}') AS pair_key, channel || '|' || received_at || '|' || recv || '|' || trim(coalesce(title, '')) AS event_key, CASE WHEN room <> '' THEN channel || ':room:' || room ELSE channel || ':' || sender END AS conversation_key FROM m")
def d36_keys(spark, sf_dir):
    m = messages(spark, sf_dir)
    gold_json = keys.sorted_json(F.struct("title", "date"), ["title", "date"])
    return m.select(
        "event_id",
        keys.judgement_key(F.col("body"), F.col("received_at")).alias("judgement_key"),
        keys.pair_key(F.col("channel"), F.col("body"), gold_json).alias("pair_key"),
        keys.event_key(F.col("channel"), F.col("received_at"), F.col("recv"), F.col("title")).alias("event_key"),
        keys.conversation_key(F.col("channel"), F.col("room"), F.col("sender")).alias("conversation_key"),
    )


@query(f"{M} SELECT event_id, strftime(make_timestamp(seconds * 1000000) + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS iso, strftime(make_timestamp(seconds * 1000000) + INTERVAL 9 HOUR, '%H:%M') AS clock FROM m")
def d41_s4_local_times(spark, sf_dir):
    millis = F.col("seconds") * 1000
    return messages(spark, sf_dir).select("event_id", keys.iso_of(millis).alias("iso"), keys.clock_of(millis).alias("clock"))


@query(f"{M} SELECT event_id, {duck.has_cue('body')} AS cue, {duck.is_completed('body')} AS completed, {duck.is_payment('body', 'recv')} AS payment, regexp_matches(body, '{fixed.SURFACE_CUES}') AS surface FROM m")
def f1_f2_f3_f14_predicates(spark, sf_dir):
    b = F.col("body")
    none = F.lit(None).cast("array<struct<message:string>>")
    return messages(spark, sf_dir).select("event_id", text.has_cue(b).alias("cue"), text.is_completed(b).alias("completed"), text.is_payment(b, F.col("recv")).alias("payment"), text.has_surface_cue(b, none).alias("surface"))


GATE = f"trim(body) <> '' AND {duck.has_cue('body')} AND NOT {duck.is_completed('body')} AND NOT {duck.is_payment('body', 'recv')}"


@query(f"{M} SELECT event_id, channel, body FROM m WHERE channel <> 'gmail' AND {GATE}")
def f4_ingest_gate(spark, sf_dir):
    channels = spark.sql("SELECT * FROM VALUES ('sms', true), ('kakaotalk', true), ('gmail', false) AS c(channel, enabled)")
    rows = messages(spark, sf_dir).select("event_id", "channel", F.col("body").alias("message"), "received_at")
    return conversation.gate(rows, channels).select("event_id", "channel", F.col("message").alias("body"))


@query(f"{M}, p AS (SELECT *, lag(body) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS earlier FROM m) SELECT event_id, trim(body) <> '' AND ({duck.has_cue('body')} OR {duck.has_cue('earlier')}) AND NOT {duck.is_completed('body')} AND NOT {duck.is_payment('body', 'recv')} AS passes FROM p")
def f5_two_way_gate(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("body").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = messages(spark, sf_dir).withColumn("earlier", before)
    thread = F.array(F.struct(F.col("earlier").alias("message")))
    return rows.select("event_id", conversation.two_way_gate(F.col("body"), F.col("received_at"), F.lit(True), thread).alias("passes"))


@query(f"{M} SELECT event_id, k % 4 IN (0, 1) AS flag FROM m")
def f6_flags(spark, sf_dir):
    value = F.element_at(F.array(F.lit("true"), F.lit(" YES "), F.lit("1"), F.lit(None)), (F.col("k") % 4 + 1).cast("int"))
    return messages(spark, sf_dir).select("event_id", text.is_yes(value).alias("flag"))


TODAY = "2024-01-15"
ROUTED = f"""{WHEN}, r AS (SELECT *, CASE WHEN is_schedule THEN CASE WHEN trim(coalesce(title, '')) <> '' AND substr(start, 1, 10) >= '{TODAY}' THEN 'AUTO_ADDED' ELSE 'PENDING' END END AS status FROM s)"""


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routed messages that are schedules: those with a status."""
    return routed(spark, sf_dir, messages(spark, sf_dir).where("is_schedule"))


def routed(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    none = F.lit(None).cast("struct<hour:int,minute:int,marker:string>")
    rows = (messages(spark, sf_dir) if rows is None else rows).withColumn("start", tokens.resolve_when(F.col("received_at"), F.col("date"), clock(), none)["start"])
    return rows.withColumn("status", events.route(F.col("is_schedule"), F.col("title"), F.col("start"), F.lit(TODAY).cast("date")))


@query(f"{ROUTED} SELECT event_id, start, status FROM r")
def f7_route(spark, sf_dir):
    return routed(spark, sf_dir).select("event_id", "start", "status")


@query(f"{ROUTED} SELECT channel, status, count(*) AS n FROM r WHERE status IS NOT NULL AND NOT (status = 'PENDING' AND coalesce(substr(start, 1, 10) < '{TODAY}', false)) GROUP BY ALL")
def f11_purge(spark, sf_dir):
    kept = events.purge_past_pending(detected(spark, sf_dir), F.lit(TODAY).cast("date"))
    return kept.groupBy("channel", "status").agg(F.count("*").alias("n"))


@query(f"{ROUTED}, a AS (SELECT user_id AS id, arg_max(k % 4, event_id) AS act, max(event_id) AS acted FROM m GROUP BY user_id) SELECT r.event_id, coalesce(CASE act WHEN 0 THEN 'ADDED' WHEN 1 THEN 'DISMISSED' WHEN 2 THEN 'DISMISSED' WHEN 3 THEN 'PENDING' END, r.status) AS status, CASE WHEN act = 0 THEN acted END AS registered_at FROM r LEFT JOIN a ON r.event_id = a.id WHERE r.status IS NOT NULL")
def f12_actions(spark, sf_dir):
    rows = detected(spark, sf_dir).select(F.col("event_id").alias("id"), "status", F.lit(None).cast("long").alias("registered_at"))
    action = F.element_at(F.array(*map(F.lit, ("ADD", "DISMISS", "UNDO", "UNREGISTER"))), (F.col("k") % 4 + 1).cast("int"))
    log = messages(spark, sf_dir).select(F.col("user_id").alias("id"), action.alias("action"), F.col("event_id").alias("at"))
    return events.apply_actions(rows, log).select(F.col("id").alias("event_id"), "status", "registered_at")


@query(f"""{ROUTED} SELECT channel, count(*) FILTER (status IN ('AUTO_ADDED') AND recv = DATE '{TODAY}') AS registered, count(*) FILTER (status = 'PENDING' AND (start IS NULL OR substr(start, 1, 10) >= '{TODAY}')) AS open, count(*) FILTER (status = 'AUTO_ADDED' AND k % 2 = 1) AS waiting, count(*) FILTER (status = 'AUTO_ADDED' AND k % 2 = 1) >= 10 AS may_export FROM r WHERE status IS NOT NULL GROUP BY channel""")
def a16_day_summary(spark, sf_dir):
    at = F.when(F.col("status") == "AUTO_ADDED", F.unix_date("recv").cast("long") * 86_400_000)
    rows = detected(spark, sf_dir).withColumns({"registered_at": at, "exported": F.col("k") % 2 == 0})
    return events.day_summary(rows, F.lit(TODAY).cast("date"))


REPEATS = f"""WITH RECURSIVE m AS ({MESSAGES.sql}),
o AS (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY seconds, seq) AS rn FROM m),
f AS (SELECT conversation, rn, event_id, sender, body, seconds, true AS keep, seconds AS last_at, sender AS last_sender, body AS last_body FROM o WHERE rn = 1
  UNION ALL SELECT o.conversation, o.rn, o.event_id, o.sender, o.body, o.seconds, NOT (o.body = f.last_body AND o.sender = f.last_sender AND o.seconds - f.last_at < 10),
  CASE WHEN o.body = f.last_body AND o.sender = f.last_sender AND o.seconds - f.last_at < 10 THEN f.last_at ELSE o.seconds END,
  CASE WHEN o.body = f.last_body AND o.sender = f.last_sender AND o.seconds - f.last_at < 10 THEN f.last_sender ELSE o.sender END,
  CASE WHEN o.body = f.last_body AND o.sender = f.last_sender AND o.seconds - f.last_at < 10 THEN f.last_body ELSE o.body END
  FROM f JOIN o ON o.conversation = f.conversation AND o.rn = f.rn + 1)"""


@query(f"{REPEATS} SELECT event_id FROM f WHERE keep")
def w2_repeat_suppress(spark, sf_dir):
    return conversation.suppress_repeats(messages(spark, sf_dir)).select("event_id")


@query(
    f"""{M}, c AS (SELECT event_id, channel, seconds, list({{'at': seconds, 's': clock || ' ' || sender || ' ' || body}}) OVER (PARTITION BY conversation ORDER BY seconds, seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before FROM m)
    SELECT event_id, CASE WHEN channel = 'gmail' THEN '' ELSE coalesce(array_to_string(list_transform(list_filter(before, lambda x: x.at >= seconds - 1800), lambda x: x.s), '|'), '') END AS context FROM c"""
)
def w3_context(spark, sf_dir):
    rows = conversation.with_context(messages(spark, sf_dir))
    return rows.select("event_id", F.array_join(F.transform("context", lambda t: F.concat_ws(" ", t["time"], t["sender"], t["message"])), "|").alias("context"))


@query(
    """WITH s AS (SELECT conv_id, turn, role, text, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS names, list(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM conversations)
    SELECT conv_id, turn, array_to_string(list_sort(list_distinct(names)), ',') AS attendees, coalesce(array_to_string(before, ','), '') AS earlier FROM s"""
)
def w5_roster(spark, sf_dir):
    rows = TURNS.spark(spark, sf_dir).select("conv_id", "turn", F.col("role").alias("name"), F.md5(F.col("text").cast("binary")).alias("message"))
    out = conversation.with_roster(rows, "conv_id", "turn")
    return out.select("conv_id", "turn", F.array_join(F.array_sort("attendees"), ",").alias("attendees"), F.array_join("earlier", ",").alias("earlier"))


@query(f"{M} SELECT room, body, min(event_id) AS event_id FROM m GROUP BY ALL")
def w11_first_seen(spark, sf_dir):
    rows = messages(spark, sf_dir).select("event_id", "room", "body")
    return conversation.first_seen(rows, signature=("body",), order=("event_id",)).select("room", "body", "event_id")


@query(f"{M} SELECT user_id AS msg_id, md5(string_agg(body, '' ORDER BY event_id)) AS body_md5 FROM m GROUP BY user_id")
def s5_join_parts(spark, sf_dir):
    parts = messages(spark, sf_dir).select(F.col("user_id").alias("msg_id"), F.col("event_id").alias("part_no"), "body")
    return io.join_parts(parts).select("msg_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("SELECT page_id AS mail_id, md5(url || chr(10) || trim(url)) AS body_md5 FROM pages")
def s7_mail_text(spark, sf_dir):
    """Three parts a mail: an undecodable one, a plain one, and the page itself, which comes too late."""
    pages = MAIL.spark(spark, sf_dir)
    part = lambda k, mime, data: F.struct(F.lit(k).alias("part_ord"), F.lit(mime).alias("mime"), data.alias("data"))
    coded = F.translate(F.base64(F.col("url").cast("binary")), "+/", "-_")
    parts = F.array(part(0, "text/plain", F.lit("%%%")), part(1, "text/plain", coded), part(2, "text/html", F.base64(F.col("html").cast("binary"))))
    rows = pages.select(F.col("page_id").alias("mail_id"), F.col("url").alias("subject"), F.explode(parts).alias("p")).select("mail_id", "subject", "p.*")
    return io.mail_text(rows).select("mail_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("SELECT page_id AS mail_id, md5(url || chr(10) || CASE page_id % 3 WHEN 0 THEN '회의 ' || chr(65533) ELSE trim(url) END) AS body_md5 FROM pages")
def s7_nested_mail(spark, sf_dir):
    """Nested payloads: the text lies two levels down, behind an attachment and before HTML; every third is in EUC-KR, with a byte that is none."""
    coded = F.translate(F.base64(F.col("url").cast("binary")), "+/", "-_")
    head = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    leaf = lambda mime, data, charset: F.to_json(F.struct(F.lit(mime).alias("mimeType"), F.array(head("Content-Type", F.concat(F.lit(f"{mime}; charset="), charset))).alias("headers"), F.struct(data.alias("data")).alias("body")))
    korean = F.col("page_id") % 3 == 0
    plain = leaf("text/plain", F.when(korean, F.lit("yLjAxyD_")).otherwise(coded), F.when(korean, F.lit('"EUC-KR"')).otherwise(F.lit("utf-8")))
    html = leaf("text/html", F.base64(F.col("html").cast("binary")), F.lit("utf-8"))
    branch = lambda kind, *parts: F.concat(F.lit(f'{{"mimeType":"{kind}","parts":['), F.concat_ws(",", *parts), F.lit("]}"))
    whole = branch("multipart/related", F.lit('{"mimeType":"image/png","body":{"data":"AAAA"}}'), branch("multipart/alternative", leaf("text/plain", F.lit("ICA="), F.lit("utf-8")), plain, html), html)
    payload = F.concat(F.lit('{"headers":'), F.to_json(F.array(head("Subject", F.col("url")))), F.lit(","), F.substring(whole, F.lit(2), F.length(whole)))
    mails = MAIL.spark(spark, sf_dir).select(F.col("page_id").alias("mail_id"), payload.alias("payload"))
    return io.mail_text(io.mail_parts(mails)).select("mail_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(
    f"""{M} SELECT event_id, is_schedule, nullif(title, '') AS title, CASE WHEN k % 3 = 0 THEN 'd' ELSE nullif(date, '') END AS date, CASE WHEN has_time THEN hour END AS hour, CASE WHEN has_time THEN marker END AS marker, CASE WHEN k % 3 > 0 AND has_time THEN minute END AS end_minute,
    nullif(place, '') AS location, '{fixed.ATTENDEES_LINE}' || sender || CASE WHEN k % 3 = 1 THEN chr(10) || '{fixed.ORGANIZER_LINE}' || sender ELSE '' END AS description FROM m"""
)
def s8_normal_gold(spark, sf_dir):
    """Gold in its three generations, by k; the second has an organiser, the older two an end."""
    k = F.col("k") % 3
    common = (F.col("title"), clock().alias("time"), F.col("place").alias("location"), F.array("sender").alias("attendees"))
    e = F.struct(*common, F.col("date"), clock().alias("end_time"), F.when(k == 1, F.col("sender")).alias("organizer"))
    status = F.when(F.col("is_schedule"), "yes").otherwise("pending")
    raw = F.when(k == 0, F.to_json(F.struct(F.col("is_schedule"), *common, F.lit("d").alias("date")))).when(k == 1, F.to_json(F.struct(status.alias("schedule_status"), F.array(e).alias("events")))).otherwise(F.to_json(F.struct(F.col("is_schedule").alias("has_schedule"), F.array(e).alias("events"))))
    rows = messages(spark, sf_dir).select("event_id", io.normal_gold(raw).alias("g"))
    return rows.select("event_id", "g.is_schedule", "g.title", "g.date", "g.time.hour", "g.time.marker", F.col("g.end_time.minute").alias("end_minute"), "g.location", "g.description")


@query(f"{M} SELECT event_id, md5('<|im_start|>system' || chr(10) || 'S' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || body || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '{{}}' || '<|im_end|>' || chr(10)) AS text_md5, true AS aligned FROM m")
def s12_s13_a21_chat_text(spark, sf_dir):
    from msgloom.operators.validate import misaligned

    full = io.chat_text(io.chat_messages(F.lit("S"), F.col("body"), F.lit("{}")))
    rows = messages(spark, sf_dir).select("event_id", full.alias("text"), io.prompt_text(F.lit("S"), F.col("body"), think_prefill=False).alias("prompt"))
    bad = misaligned(rows).select("event_id", F.lit(True).alias("bad"))
    return rows.join(bad, "event_id", "left").select("event_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("bad").isNull().alias("aligned"))


ALIASES = "al AS (SELECT sender, place AS token FROM m WHERE event_id % 50 = 0 AND trim(coalesce(place, '')) <> '' GROUP BY ALL)"


@query(f"{M}, {ALIASES} SELECT m.event_id, CASE WHEN al.token IS NULL THEN m.place END AS location FROM m LEFT JOIN al ON trim(m.sender) = trim(al.sender) AND trim(m.place) = trim(al.token)")
def j8_alias_correction(spark, sf_dir):
    rows = messages(spark, sf_dir)
    marks = rows.where("event_id % 50 = 0 AND trim(coalesce(place, '')) <> ''").select("sender", F.col("place").alias("token")).distinct()
    return events.correct_location(rows.withColumn("location", F.col("place")), marks).select("event_id", "location")


@query(f"{M} SELECT DISTINCT sender, trim(place) AS token FROM m WHERE trim(coalesce(place, '')) <> '' AND k % 10 = 0")
def j11_alias_table(spark, sf_dir):
    rows = messages(spark, sf_dir).select(F.col("event_id").alias("id"), "sender", F.col("place").alias("location"), "k")
    after = rows.withColumn("location", F.when(F.col("k") % 10 != 0, F.coalesce("location", F.lit("x"))))
    return events.learn_aliases(rows, after, rows.select("sender", F.col("location").alias("token")).limit(0))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detected(spark, sf_dir)
    return rows.select(F.col("event_id").alias("id"), "user_id", "channel", "sender", "start", "room", F.coalesce("title", F.lit("")).alias("base_title"), "title", "status", (F.unix_date("recv").cast("long") * 86_400_000 + F.col("recv_minute") * 60_000).alias("created_at"), F.col("event_id").alias("seq"))


@query(
    f"""{ROUTED}, e AS (SELECT event_id AS id, channel, start, room, coalesce(title, '') AS base, status, CAST(epoch_ms(CAST(recv AS TIMESTAMP)) AS BIGINT) + recv_minute * 60000 AS at FROM r WHERE status IS NOT NULL)
    SELECT n.id AS new_id, arg_max(o.id, (CASE WHEN n.room <> '' AND n.room = o.room THEN 1 ELSE 0 END) * 10000000000000000000000::HUGEINT + o.at::HUGEINT * 10000000 + o.id) AS id
    FROM e n JOIN e o ON n.channel = o.channel AND n.start IS NOT DISTINCT FROM o.start AND o.id <> n.id AND o.at <= n.at AND n.at - o.at <= 2592000000 AND o.status <> 'DISMISSED'
    AND ((n.room <> '' AND n.room = o.room) OR (trim(n.base) <> '' AND n.base = o.base AND (n.room = '' OR o.room = '' OR n.room = o.room))) GROUP BY n.id"""
)
def j9_mergeable(spark, sf_dir):
    return events.mergeable(stored(spark, sf_dir))


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir)
    return rows.withColumn("event_key", keys.event_key(F.col("channel"), F.col("created_at"), F.col("start"), F.col("title")))


@query()
def w4_event_store(spark, sf_dir):
    """All events in two runs into a store on disk, older ones first. Tests compare it with a plain replay."""
    rows, path = keyed_events(spark, sf_dir), shared_folder(spark)
    cut = F.lit(rows.agg(F.percentile_approx("created_at", 0.5)).first()[0])
    for day in (rows.where(F.col("created_at") <= cut), rows.where(F.col("created_at") > cut)):
        merge_into_store(day, path, ("user_id",), 16)
    stored = read_store(spark, path)
    return stored if stored is not None else events.merge_events(rows, owner=("user_id",))


@query()
def w4_merge_events(spark, sf_dir):
    """All events, each user's into a store of their own."""
    return events.merge_events(keyed_events(spark, sf_dir), owner=("user_id",))


@query(
    f"""{M}, l AS (SELECT *, {ROSTER} AS names FROM m), n AS (SELECT *, {TAG} AS tag, {TITLE} AS base FROM l)
    SELECT event_id, array_to_string(list_sort(list_distinct(list_concat([sender], names))), ',') AS attendees, CASE WHEN len(names) > 0 AND trim(coalesce(title, '')) <> '' THEN {TITLED} ELSE title END AS title FROM n"""
)
def u3_attendee_union(spark, sf_dir):
    """The whole of U3 and W4's first step: all messages, those with a roster too, and their titles."""
    rows = messages(spark, sf_dir).withColumns({"attendees": F.array("sender"), "base_title": F.coalesce("title", F.lit("")), "message": F.col("body")})
    return events.with_roster_title(rows).select("event_id", F.array_join(F.array_sort("attendees"), ",").alias("attendees"), "title")
