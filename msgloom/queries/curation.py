"""Queries over labelled pairs: curation, validation, labels, feedback, scoring, generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom import schemas
from msgloom.functions import fixed, tokens
from msgloom.functions.anonymize import first_pseudonym, mask_personal_data
from msgloom.functions.similarity import location_score, title_score
from msgloom.operators import curate, evaluate, feedback, generate, labels, validate
from msgloom.queries import duck
from msgloom.queries.frames import MESSAGES, PAIRS, PLAN
from msgloom.queries.messages import NAME, PERSONAL, TOLD_DATES, WHEN, M, clock, messages
from msgloom.queries.registry import query
from msgloom.sources import io

P = f"WITH p AS ({PAIRS.sql})"
L = f"WITH l AS ({PLAN.sql})"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PAIRS.spark(spark, sf_dir)


def event(date: Column | None = None) -> Column:
    """A row's event of the older kind."""
    return F.struct(
        F.col("title"), (F.col("date") if date is None else date).alias("date"), clock().alias("time"), F.lit(None).cast(schemas.TIME).alias("end_time"), F.lit(False).alias("all_day"),
        F.col("place").alias("location"), F.array("sender").alias("attendees"), F.lit(None).cast("string").alias("organizer"), F.when(F.col("k") % 3 == 0, "스레드 협의 확정 건").otherwise(F.col("body")).alias("description"),
        F.lit(None).cast("string").alias("recurrence"), (F.col("k") / 100).alias("confidence"),
    )


def with_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with one event each and the row's own body as the only turn of its thread for even k."""
    thread = F.when(F.col("k") % 2 == 0, F.array(F.struct(F.lit(None).cast("string").alias("time"), F.col("sender"), F.col("body").alias("message"), F.lit(None).cast("string").alias("received_at"))))
    return messages(spark, sf_dir).withColumns({"events": F.array(event()), "message": F.col("body"), "thread_context": thread})


@query(f"{P} SELECT doc_id, channel FROM (SELECT doc_id, channel, row_number() OVER (PARTITION BY channel, text, is_schedule ORDER BY doc_id) AS rn FROM p) WHERE rn = 1")
def w1_keep_first(spark, sf_dir):
    key = F.concat_ws("|", "channel", "message", F.col("is_schedule").cast("string"))
    return curate.keep_first(pairs(spark, sf_dir), key, "doc_id").select("doc_id", "channel")


@query(f"{P} SELECT channel, count(*) FILTER (is_schedule) AS positives, count(*) FILTER (NOT is_schedule) AS negatives, count(*) AS total, count(*) FILTER (NOT is_schedule) / count(*) AS negative_share FROM p GROUP BY ROLLUP (channel)")
def a1_breakdown(spark, sf_dir):
    return curate.breakdown(pairs(spark, sf_dir))


@query(f"{P}, c AS (SELECT lang, count(*) AS rows FROM p GROUP BY lang) SELECT lang, rows, rows / (SELECT count(*) FROM p) AS share FROM c")
def a2_class_counts(spark, sf_dir):
    return validate.class_counts(pairs(spark, sf_dir), "lang")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON text with planted defects, by k."""
    k = F.col("k") % 8
    status = F.when(k == 0, "maybe").when(k == 1, "no").otherwise("yes")
    time = F.when(k == 2, F.lit('{"hour":24,"minute":0,"marker":"오후"}')).when(k == 3, F.lit('{"hour":15,"minute":0,"marker":"오후"}')).when(k == 4, F.lit('"3시"')).otherwise(F.lit("null"))
    date = F.when(k == 5, F.lit('"someday"')).when(k == 6, F.lit("null")).otherwise(F.lit('"내일"'))
    title = F.when(k == 7, F.repeat(F.lit("가"), F.lit(61))).when(k == 6, "").otherwise("회의")
    events = F.concat(F.lit('[{"title":"'), title, F.lit('","date":'), date, F.lit(',"time":'), time, F.lit(',"end_time":null,"all_day":false,"location":null,"attendees":[],"organizer":null,"description":null,"recurrence":null}]'))
    row = F.concat(F.lit('{"message":"m","received_at":"2026-06-15T10:00:00+09:00","channel":"sms","gold":{"schedule_status":"'), status, F.lit('","events":'), events, F.lit("}}"))
    return messages(spark, sf_dir).select("event_id", F.col("body").alias("message"), row.alias("raw"))


DEFECTS = " UNION ALL ".join(
    f"SELECT event_id, '{code}' AS code FROM m WHERE k % 8 = {k}"
    for k, codes in {0: ("HAS_SCHEDULE_BAD", "HAS_EVENTS_MISMATCH"), 1: ("HAS_EVENTS_MISMATCH",), 2: ("TIME_HOUR_RANGE", "MARKER_ON_24H"), 3: ("MARKER_ON_24H",), 4: ("TIME_NOT_DICT",), 5: ("DATE_UNRESOLVABLE",), 6: ("EMPTY_TITLE", "UNPLACEABLE_EVENT"), 7: ("TITLE_TOO_LONG",)}.items()
    for code in codes
)


@query(f"{M}, d AS ({DEFECTS}) SELECT event_id, string_agg(code, ',' ORDER BY code) AS codes FROM d GROUP BY event_id")
def d35_issues(spark, sf_dir):
    rows = raw_rows(spark, sf_dir).withColumn("issues", validate.issues(F.col("raw")))
    return rows.select("event_id", F.array_join(F.array_sort(F.transform("issues", lambda i: i["code"])), ",").alias("codes")).where("codes <> ''")


@query(f"{M}, d AS ({DEFECTS}) SELECT code, count(*) AS times, count(DISTINCT event_id) AS rows FROM d GROUP BY code")
def a3_defects(spark, sf_dir):
    return validate.defect_counts(raw_rows(spark, sf_dir).withColumn("issues", validate.issues(F.col("raw"))))


@query(f"{P}, c AS (SELECT trim(text) AS t, count(*) AS n FROM p WHERE trim(text) <> '' GROUP BY ALL HAVING count(*) > 1) SELECT count(*) AS kinds, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM c")
def a4_repeated_messages(spark, sf_dir):
    return validate.repeated_messages(pairs(spark, sf_dir))


@query(f"{M}, c AS (SELECT sender AS attendee, count(*) AS times FROM m GROUP BY sender) SELECT attendee, times, times / (SELECT count(*) FROM m) AS share, (SELECT count(*) FROM c) AS distinct_names FROM c ORDER BY times DESC, attendee LIMIT 15")
def a5_attendee_frequency(spark, sf_dir):
    return validate.attendee_frequency(messages(spark, sf_dir).select(F.array("sender").alias("attendees")))


@query(f"{P}, s AS (SELECT coalesce(length(text), 0) AS n FROM p), e AS (SELECT min(n) AS lo, max(n) AS hi FROM s) SELECT CAST(greatest(1, least(20, ceil((n - lo) * 20 / greatest(1, hi - lo)))) AS INT) AS bin, count(*) AS rows FROM s, e GROUP BY bin")
def a12_length_histogram(spark, sf_dir):
    return validate.length_histogram(pairs(spark, sf_dir))


@query(f"{P} SELECT channel, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr FROM p GROUP BY channel")
def a12_cross_tab(spark, sf_dir):
    return validate.cross_tab(pairs(spark, sf_dir), "channel", "lang", ["en", "de", "fr"])


NORMAL = "lower(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g'))"


@query(
    f"""WITH g AS (SELECT {NORMAL} AS t FROM benchmark UNION ALL SELECT {NORMAL} FROM documents WHERE doc_id % 10 = 3),
    r AS (SELECT 'document' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'quoted', item_id, replace(lower(text), ' ', '  ') FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT 'cited', item_id, text || '.' FROM benchmark)
    SELECT origin, id FROM r WHERE {NORMAL} IN (SELECT t FROM g)"""
)
def j10_leakage(spark, sf_dir):
    """Documents, and test items quoted in small letters with wide gaps or with a mark behind, against the test items and held-out documents."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    row = lambda df, origin, key, text: df.select(F.lit(origin).alias("origin"), F.col(key).alias("id"), text.alias("message"))
    quoted = row(items.where("item_id % 3 = 0"), "quoted", "item_id", F.replace(F.lower("text"), F.lit(" "), F.lit("  ")))
    train = row(docs, "document", "doc_id", F.col("text")).union(quoted).union(row(items, "cited", "item_id", F.concat("text", F.lit("."))))
    golden = items.select(F.col("text").alias("message")).union(docs.where("doc_id % 10 = 3").select("text"))
    return curate.leaks(train, golden).select("origin", "id")


@query(
    f"""WITH g AS (SELECT {NORMAL} AS t FROM benchmark UNION SELECT {NORMAL} FROM documents WHERE doc_id % 10 = 3),
    r AS (SELECT 'document' AS origin, doc_id AS id, {NORMAL} AS t FROM documents UNION ALL SELECT 'embedded', item_id, lower(replace('Before ' || text || ' and after', ' ', '')) FROM (SELECT item_id, regexp_replace(text, '[ \t\n\r]+', '', 'g') AS text FROM benchmark) UNION ALL SELECT 'torn', item_id, replace({NORMAL}, 'th', 't-h') FROM benchmark)
    SELECT origin, id FROM r WHERE EXISTS (SELECT 1 FROM g WHERE g.t <> '' AND (r.t = g.t OR length(g.t) >= 8 AND contains(r.t, g.t)))"""
)
def j10_occurrence(spark, sf_dir):
    """Documents, and test items inside a longer text or torn, against the test items and held-out documents."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    row = lambda df, origin, key, text: df.select(F.lit(origin).alias("origin"), F.col(key).alias("id"), text.alias("message"))
    embedded = row(items, "embedded", "item_id", F.concat(F.lit("Before "), "text", F.lit(" and after")))
    torn = row(items, "torn", "item_id", F.replace(curate.normal(F.col("text")), F.lit("th"), F.lit("t-h")))
    golden = items.select(F.col("text").alias("message")).union(docs.where("doc_id % 10 = 3").select("text"))
    return curate.occurrences(row(docs, "document", "doc_id", F.col("text")).union(embedded).union(torn), golden).select("origin", "id")


@query(f"{P}, b AS (SELECT * FROM p WHERE doc_id % 2 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM p WHERE doc_id % 2 = 1) SELECT doc_id FROM b UNION ALL SELECT doc_id FROM n WHERE rn = 1 AND text NOT IN (SELECT text FROM b)")
def j6_append_missing(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("doc_id", "message")
    return curate.append_missing(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "message", "doc_id").select("doc_id")


@query(f"{P} SELECT doc_id FROM p WHERE text NOT IN (SELECT text FROM p WHERE doc_id % 3 = 0)")
def j7_pool_minus_keep(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return curate.pool_minus_keep(rows, rows.where("doc_id % 3 = 0"), "message").select("doc_id")


@query(f"{P} SELECT p.doc_id FROM p JOIN labels l ON p.doc_id = l.doc_id WHERE NOT p.is_schedule AND l.quality = 1 AND l.toxic = 0")
def j12_agreed_negatives(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.when(F.col("quality") == 1, "no").otherwise("yes").alias("label"), F.when(F.col("toxic") == 1, "x").alias("flag"))
    return curate.agreed_negatives(pairs(spark, sf_dir).where(~F.col("is_schedule")), found, "doc_id").select("doc_id")


@query(f"{M} SELECT event_id, k % 2 = 0 AND regexp_matches(coalesce(date, ''), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND NOT regexp_matches(body || body, '[0-9]{{1,2}} */ *[0-9]{{1,2}}|[0-9]{{1,2}} *월 *[0-9]{{1,2}}') AS leak FROM m")
def f13_date_leak(spark, sf_dir):
    return with_events(spark, sf_dir).select("event_id", curate.is_date_leak(F.col("events"), F.col("message"), F.col("thread_context")).alias("leak"))


@query(f"{M} SELECT event_id, CASE WHEN k % 3 = 0 THEN NULL ELSE body END AS description, CASE WHEN is_schedule AND date IS NOT NULL AND has_time AND trim(coalesce(title, '')) <> '' AND k < 90 THEN 0.9 ELSE k / 100 END AS confidence FROM m")
def f16_f17_gold_fixes(spark, sf_dir):
    fixed_events = curate.raised_confidence(F.col("is_schedule"), curate.without_boilerplate(F.col("events")))
    return with_events(spark, sf_dir).select("event_id", F.element_at(fixed_events, 1).alias("e")).select("event_id", "e.description", "e.confidence")


SAID = "lower(CASE WHEN k % 2 = 0 THEN body || ' ' || body ELSE body END)"
HIT = lambda c: f"(strpos({SAID}, lower({c})) > 0 OR len(list_filter(regexp_split_to_array({c}, '[ ,·/]+'), lambda w: length(w) >= 2 AND strpos({SAID}, lower(w)) > 0)) > 0)"
CHECKED = "(CASE WHEN trim(coalesce(title, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(place, '')) <> '' THEN 1 ELSE 0 END + 1)"
GROUNDED = f"(CASE WHEN trim(coalesce(title, '')) <> '' AND {HIT('title')} THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(place, '')) <> '' AND {HIT('place')} THEN 1 ELSE 0 END + CASE WHEN strpos({SAID}, lower(sender)) > 0 THEN 1 ELSE 0 END)"
HARD = f"""CASE WHEN NOT is_schedule THEN CASE WHEN regexp_matches(body, '{fixed.SURFACE_CUES}') THEN 1.0 ELSE 0.0 END ELSE
  CASE WHEN k % 2 = 0 THEN 2.0 ELSE 0.0 END + CASE WHEN date IS NULL THEN 1.0 WHEN NOT regexp_full_match(substr(date, 1, 4), '[0-9]+') AND strpos(date, '월') = 0 THEN 1.5 ELSE 0.0 END
  + CASE WHEN has_time AND marker IS NULL AND hour BETWEEN 1 AND 12 THEN 1.0 ELSE 0.0 END + CASE WHEN length(body) < 20 THEN 1.0 ELSE 0.0 END + CASE WHEN coalesce(place, '') = '' THEN 0.3 ELSE 0.0 END END"""
SCORED = f"{M}, g AS (SELECT *, CASE WHEN is_schedule THEN {GROUNDED} / {CHECKED} ELSE 1.0 END AS grounding, {HARD} AS difficulty FROM m)"


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_events(spark, sf_dir)
    said = (F.col("is_schedule"), F.col("events"), F.col("message"), F.col("thread_context"))
    return rows.withColumns({"grounding": curate.grounding(*said), "difficulty": curate.difficulty(*said)})


@query(f"{SCORED} SELECT event_id, round(grounding, 6) AS grounding, round(CAST(difficulty AS DOUBLE), 6) AS difficulty FROM g")
def d30_d31_scores(spark, sf_dir):
    return scored_rows(spark, sf_dir).select("event_id", F.round("grounding", 6).alias("grounding"), F.round("difficulty", 6).alias("difficulty"))


@query(f"{SCORED} SELECT k < 50 AS selected, round(avg(grounding), 6) AS grounding, count(*) AS rows FROM g GROUP BY ALL")
def a15_grounding_by_choice(spark, sf_dir):
    out = curate.grounding_by_choice(scored_rows(spark, sf_dir).withColumn("selected", F.col("k") < 50))
    return out.withColumn("grounding", F.round("grounding", 6))


CUE = f"regexp_matches(body, '{fixed.SURFACE_CUES}')"


@query(f"{M}, t AS (SELECT *, {CUE} AS cue, {duck.clean('date')} AS tok FROM m), r AS (SELECT *, {duck.resolve_date('recv', 'tok')} AS found FROM t) SELECT round(count(*) FILTER (cue AND is_schedule) / greatest(1, count(*) FILTER (cue)), 6) AS positive_given_cue, round(count(*) FILTER (is_schedule) / count(*), 6) AS base_rate, round(count(*) FILTER (cue AND is_schedule) / greatest(1, count(*) FILTER (is_schedule)), 6) AS cue_rate_positive, round(count(*) FILTER (cue AND NOT is_schedule) / greatest(1, count(*) FILTER (NOT is_schedule)), 6) AS cue_rate_negative, count(*) FILTER (is_schedule AND date IS NOT NULL AND found IS NULL) AS unresolved FROM r")
def a10_cue_shortcut(spark, sf_dir):
    out = curate.cue_shortcut(messages(spark, sf_dir).withColumn("cue", F.col("body").rlike(fixed.SURFACE_CUES)))
    return out.select(*(F.round(c, 6).alias(c) if c != "unresolved" else c for c in out.columns))


@query(f"{M}, t AS (SELECT *, {duck.clean('date')} AS tok FROM m), r AS (SELECT *, {duck.resolve_date('recv', 'tok')} AS found FROM t) SELECT event_id, date FROM r WHERE is_schedule AND date IS NOT NULL AND found IS NULL")
def a19_unresolved(spark, sf_dir):
    return validate.unresolved(messages(spark, sf_dir)).select("event_id", "date")


CAP = 200
SELECTED = f"""{SCORED}, q AS (SELECT *, 'e' || event_id AS pair_key, k < 5 AS keep, k % 2 = 0 AS real FROM g),
k AS (SELECT * FROM q WHERE keep), n AS (SELECT greatest(0, {CAP} - 110 - count(*) FILTER (is_schedule)) AS need_pos, greatest(0, 110 - count(*) FILTER (NOT is_schedule)) AS need_neg, count(*) AS kept FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY is_schedule ORDER BY CASE WHEN is_schedule THEN CASE WHEN grounding >= 0.6 THEN 0 ELSE 1 END END, difficulty DESC, CASE WHEN is_schedule THEN -grounding END, md5(pair_key || '|0')) AS rn FROM q WHERE NOT keep),
c AS (SELECT event_id, pair_key, is_schedule, real FROM k UNION ALL SELECT event_id, pair_key, is_schedule, real FROM o, n WHERE rn <= CASE WHEN is_schedule THEN need_pos ELSE need_neg END),
t AS (SELECT count(*) AS total FROM c),
extra AS (SELECT event_id, is_schedule, row_number() OVER (ORDER BY md5(pair_key || '|0')) AS r2 FROM o WHERE event_id NOT IN (SELECT event_id FROM c)),
cut AS (SELECT event_id, row_number() OVER (ORDER BY md5(pair_key || '|0')) AS r3 FROM c WHERE NOT real)
SELECT event_id, is_schedule FROM c WHERE event_id NOT IN (SELECT event_id FROM cut, t WHERE r3 <= total - {CAP}) UNION ALL SELECT event_id, is_schedule FROM extra, t WHERE r2 <= {CAP} - total"""


@query(SELECTED)
def w6_capped_selection(spark, sf_dir):
    rows = scored_rows(spark, sf_dir).select("event_id", "is_schedule", "grounding", "difficulty", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("pair_key"), F.when(F.col("k") < 5, "keep").otherwise("pool").alias("kind"), (F.col("k") % 2 == 0).alias("real"))
    return curate.capped_selection(rows, CAP, 0.55).select("event_id", "is_schedule")


@query(f"{M}, r AS (SELECT event_id, channel, row_number() OVER (PARTITION BY channel ORDER BY event_id) AS rn FROM m) SELECT event_id, channel FROM r WHERE rn <= CASE channel WHEN 'sms' THEN 70 WHEN 'gmail' THEN 30 ELSE 0 END")
def w8_quota(spark, sf_dir):
    return curate.quota(messages(spark, sf_dir).select("event_id", "channel"), F.col("channel"), {"sms": 70, "gmail": 30}, "event_id")


@query(f"{M} SELECT event_id, row_number() OVER (ORDER BY md5(event_id || '|7')) AS place FROM m")
def w13_shuffle(spark, sf_dir):
    """All messages in shuffled order, with their places."""
    return curate.shuffled(messages(spark, sf_dir).select("event_id"), F.col("event_id"), 7).select("event_id", "place")


@query(f"{M} SELECT channel, source_ord, kind, count(*) AS rows FROM (SELECT channel, 0 AS source_ord, 'keep' AS kind FROM m WHERE channel <> 'sms' UNION ALL SELECT channel, 1, 'pool' FROM m WHERE channel = 'sms') GROUP BY ALL")
def u1_union_sources(spark, sf_dir):
    rows = messages(spark, sf_dir).select("event_id", "channel")
    joined = io.union_sources([(rows.where("channel <> 'sms'"), "keep", True), (rows.where("channel = 'sms'").withColumn("extra", F.lit(1)), "pool", False)])
    return joined.groupBy("channel", "source_ord", "kind").agg(F.count("*").alias("rows"))


@query(f"{M} SELECT event_id FROM m WHERE k % 3 <> 0 AND k % 5 <> 0")
def j2_not_done(spark, sf_dir):
    rows = messages(spark, sf_dir).select("event_id", "k")
    return labels.not_done(rows, rows.where("k % 3 = 0"), rows.where("k % 5 = 0"), key="event_id").select("event_id")


NEED = "pl AS (SELECT scenario_id, max(wanted) * 20 AS count FROM l GROUP BY scenario_id), made AS (SELECT produced_id AS scenario_id, count(*) AS produced FROM l GROUP BY produced_id)"


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLAN.spark(spark, sf_dir).groupBy("scenario_id").agg((F.max("wanted") * 20).alias("count"))


def produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLAN.spark(spark, sf_dir).select(F.col("produced_id").alias("scenario_id"))


@query(f"{L}, {NEED} SELECT pl.scenario_id, pl.count - coalesce(produced, 0) AS need, CAST(ceil((pl.count - coalesce(produced, 0)) / 10) AS INT) AS batches FROM pl LEFT JOIN made USING (scenario_id) WHERE pl.count - coalesce(produced, 0) > 0")
def j3_deficit(spark, sf_dir):
    return labels.deficit(plan(spark, sf_dir), produced(spark, sf_dir)).select("scenario_id", "need", "batches")


@query(f"{L}, {NEED}, n AS (SELECT pl.scenario_id, pl.count - coalesce(produced, 0) AS need FROM pl LEFT JOIN made USING (scenario_id)) SELECT scenario_id, CAST(c AS INT) AS call, least(10, need - (c - 1) * 10) AS size FROM n, LATERAL (SELECT unnest(range(1, CAST(ceil(need / 10) AS BIGINT) + 1)) AS c) WHERE need > 0")
def j3_batches(spark, sf_dir):
    return labels.batches(labels.deficit(plan(spark, sf_dir), produced(spark, sf_dir)))


@query(f"{L}, {NEED} SELECT (SELECT count(*) FROM l) AS produced, CAST((SELECT sum(count) FROM pl) AS BIGINT) AS target, round((SELECT count(*) FROM l) / (SELECT sum(count) FROM pl), 6) AS share")
def j3_progress(spark, sf_dir):
    return labels.progress(plan(spark, sf_dir), produced(spark, sf_dir)).withColumn("share", F.round("share", 6))


BALANCE = " UNION ALL ".join(f"SELECT '{n}' AS name, round(sum(CASE WHEN {c} THEN wanted ELSE 0 END) / sum(wanted), 6) AS share, {t} AS target FROM l" for n, c, t in [("no_schedule", "edge_case = 'no_schedule'", 0.25), ("multi_event", "edge_case = 'multi_event'", 0.05), ("recurring", "edge_case = 'recurring'", 0.03), ("past_time", "edge_case = 'past_time'", 0.03), ("language_ko", "language = 'ko'", 0.6), ("language_en", "language = 'en'", 0.25), ("language_mixed", "language = 'mixed'", 0.15)])


@query(f"{L}, b AS ({BALANCE}) SELECT name, share, CASE WHEN starts_with(name, 'language_') THEN abs(share - target) <= 0.1 ELSE share >= target END AS ok FROM b")
def a20_plan_balance(spark, sf_dir):
    out = validate.plan_balance(PLAN.spark(spark, sf_dir).select("edge_case", "language", F.col("wanted").alias("count")))
    return out.select("name", F.round("share", 6).alias("share"), "ok")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select("event_id", F.col("body").alias("gold"), "k")
    verdict = F.element_at(F.array(*map(F.lit, ("accept", "fix", "reject", "unsure"))), (F.col("k") % 4 + 1).cast("int"))
    found = rows.where("k % 7 <> 0").select("event_id", verdict.alias("verdict"), F.when(F.col("k") % 3 > 0, F.lit("fixed")).alias("fixed_gold"))
    return labels.apply_verdicts(rows, found, "event_id")


JUDGED = "j AS (SELECT event_id, CASE WHEN k % 7 = 0 THEN 'reject' WHEN k % 4 = 0 THEN 'accept' WHEN k % 4 = 1 AND k % 3 > 0 THEN 'fix' ELSE 'reject' END AS verdict, body FROM m)"


@query(f"{M}, {JUDGED} SELECT event_id, verdict, CASE WHEN verdict = 'fix' THEN 'fixed' ELSE body END AS gold FROM j")
def j4_verdicts(spark, sf_dir):
    return judged(spark, sf_dir).select("event_id", "verdict", "gold")


@query(f"{M}, {JUDGED} SELECT verdict, count(*) AS rows, round(100 * count(*) / (SELECT count(*) FROM m), 6) AS percent FROM j GROUP BY verdict")
def a11_verdict_totals(spark, sf_dir):
    return labels.verdict_totals(judged(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(f"{M}, x AS (SELECT *, is_schedule AS has, CASE WHEN k % 11 = 0 THEN NULL ELSE list_extract(['no', 'yes', 'pending'], k % 3 + 1) END AS label FROM m) SELECT event_id, CASE WHEN label IS NULL THEN 'yes' WHEN label = 'no' THEN 'no' WHEN has THEN label ELSE 'no' END AS status, CASE WHEN has AND coalesce(label, '') <> 'no' THEN 1 ELSE 0 END AS n_events, coalesce(label IN ('yes', 'pending') AND NOT has, false) AS flagged FROM x")
def j5_status(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = messages(spark, sf_dir).select("event_id", "k", F.lit("yes").alias("status"), F.when(F.col("is_schedule"), F.array("body")).otherwise(none).alias("events"))
    label = F.element_at(F.array(*map(F.lit, ("no", "yes", "pending"))), (F.col("k") % 3 + 1).cast("int"))
    found = rows.select("event_id", label.alias("label"), F.when(F.col("k") % 11 == 0, "timeout").alias("error"))
    return labels.apply_status(rows, found, "event_id").select("event_id", "status", F.size("events").alias("n_events"), "flagged")


@query(f"{M} SELECT event_id, CASE WHEN trim(coalesce(place, '')) <> '' THEN place WHEN strpos(lower(regexp_replace(body, ' +', '', 'g')), 'zoom') > 0 THEN 'zoom' END AS location, array_to_string(list_sort(list_distinct(list_filter([sender, 'Tom Lee'], lambda a: strpos(lower(regexp_replace(body, ' +', '', 'g')), lower(replace(a, ' ', ''))) > 0))), ',') AS attendees FROM m")
def d29_relabel_guard(spark, sf_dir):
    out = labels.guard_relabel(F.col("place"), F.array("sender"), F.lit("zoom"), F.array(F.lit("Tom Lee")), F.col("body"))
    return messages(spark, sf_dir).select("event_id", out.alias("o")).select("event_id", "o.location", F.array_join(F.array_sort("o.attendees"), ",").alias("attendees"))


@query(f"{M} SELECT count(*) FILTER (trim(coalesce(place, '')) = '') AS filled, count(*) FILTER (k % 2 = 0) AS added, count(*) FILTER (k % 3 = 0) AS dropped, count(*) FILTER (trim(coalesce(place, '')) = '' OR k % 2 = 0 OR k % 3 = 0) AS changed FROM m")
def a18_relabel_changes(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = messages(spark, sf_dir).select(F.col("place").alias("old_location"), F.coalesce(F.nullif(F.trim("place"), F.lit("")), F.lit("x")).alias("new_location"), F.when(F.col("k") % 3 == 0, F.array(F.lit("old"))).otherwise(none).alias("old_attendees"), F.when(F.col("k") % 2 == 0, F.array(F.lit("new"))).otherwise(none).alias("new_attendees"))
    return labels.relabel_changes(rows)


def gold_and_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold from the messages; predictions that differ in one field, by five or six minutes, do not parse, or are missing, by event_id."""
    rows = messages(spark, sf_dir).withColumn("scenario_id", F.col("event_id"))
    none = F.lit(None).cast(schemas.TIME)
    record = lambda title, date, has, time: F.struct(has.alias("is_schedule"), title.alias("title"), date.alias("date"), time.alias("time"), none.alias("end_time"), F.col("place").alias("location"), F.lit(None).cast("string").alias("description"))
    gold = rows.select("scenario_id", "received_at", record(F.col("title"), F.col("date"), F.col("is_schedule"), clock()).alias("gold"))
    k = F.col("event_id") % 10
    minute = F.col("minute")
    near, far = F.when(minute >= 5, minute - 5).otherwise(minute + 5), F.when(minute >= 6, minute - 6).otherwise(minute + 6)
    other = F.when(F.col("has_time"), tokens.time_struct(F.col("hour"), F.when(k == 6, near).when(k == 7, far).otherwise(minute), F.col("marker")))
    pred = record(F.when(k == 1, F.lit(None).cast("string")).otherwise(F.col("title")), F.when(k == 2, F.lit(None).cast("string")).otherwise(F.col("date")), F.when(k == 3, ~F.col("is_schedule")).otherwise(F.col("is_schedule")), other)
    output = F.when(k == 4, F.lit('{"is_schedule": tr')).otherwise(F.concat(F.lit("```json\n"), F.to_json(pred), F.lit("\n```")))
    return gold, rows.where(k != 5).select("scenario_id", output.alias("output"))


PREDICTED = f"""{WHEN}, a AS (SELECT *, event_id % 10 AS v, CASE WHEN event_id % 10 = 6 THEN CASE WHEN minute >= 5 THEN minute - 5 ELSE minute + 5 END WHEN event_id % 10 = 7 THEN CASE WHEN minute >= 6 THEN minute - 6 ELSE minute + 6 END ELSE minute END AS said_minute FROM s),
o AS (SELECT *, CASE WHEN v = 2 THEN CASE WHEN has_time THEN recv END ELSE on_day END AS said_day, {duck.resolve_time('hour', 'said_minute', 'marker', 'recv_minute')} AS said_time FROM a),
b AS (SELECT *, CASE WHEN has_time THEN strftime(said_day, '%Y-%m-%d') || 'T' || said_time || ':00+09:00' ELSE strftime(said_day, '%Y-%m-%d') END AS pred_start, v NOT IN (4, 5) AS json_valid, CASE WHEN v = 3 THEN NOT is_schedule ELSE is_schedule END AND v NOT IN (4, 5) AS pred_has,
  CASE WHEN coalesce(title, '') = '' THEN 1.0 WHEN v = 1 THEN 0.0 WHEN trim(title) = '' THEN 0.0 ELSE 1.0 END AS title_f1 FROM o),
tt AS (SELECT *, CASE WHEN has_time AND substr(start, 12, 2) = '24' THEN NULL ELSE start END AS gs, CASE WHEN has_time AND substr(pred_start, 12, 2) = '24' THEN NULL ELSE pred_start END AS ps FROM b),
e AS (SELECT *, CASE WHEN gs IS NULL AND ps IS NULL THEN 1.0 WHEN gs IS NULL OR ps IS NULL THEN 0.0 WHEN NOT has_time THEN CASE WHEN gs = ps THEN 1.0 ELSE 0.0 END WHEN left(gs, 14) = left(ps, 14) AND abs(CAST(substr(gs, 15, 2) AS INT) - CAST(substr(ps, 15, 2) AS INT)) <= 5 THEN 1.0 ELSE 0.0 END AS time_f1, json_valid AND pred_has = is_schedule AS status_match FROM tt)"""


HIT_ROWS = "json_valid AND is_schedule AND pred_has AND coalesce(title, '') <> ''"
METRICS = {
    "n": "count(*)",
    "n_pos": "count(*) FILTER (is_schedule)",
    "n_neg": "count(*) FILTER (NOT is_schedule)",
    "overfire_count": "count(*) FILTER (json_valid AND NOT is_schedule AND pred_has)",
    "missed_count": "count(*) FILTER (is_schedule AND NOT (json_valid AND pred_has))",
    "tp_n": f"count(*) FILTER ({HIT_ROWS})",
    "json_valid_rate": "count(*) FILTER (json_valid) / count(*)",
    "is_schedule_acc": "count(*) FILTER (status_match) / count(*)",
    "title_f1_avg": "sum(CASE WHEN json_valid THEN title_f1 ELSE 0 END) / count(*)",
    "time_match_rate": "sum(CASE WHEN json_valid THEN time_f1 ELSE 0 END) / count(*)",
    "location_f1_avg": "sum(CASE WHEN json_valid THEN 1.0 ELSE 0 END) / count(*)",
    "recall_pos": "count(*) FILTER (json_valid AND is_schedule AND pred_has) / greatest(1, count(*) FILTER (is_schedule))",
    "specificity_neg": "count(*) FILTER (json_valid AND NOT is_schedule AND NOT pred_has) / greatest(1, count(*) FILTER (NOT is_schedule))",
    "tp_title_avg": f"coalesce(sum(title_f1) FILTER ({HIT_ROWS}), 0) / greatest(1, count(*) FILTER ({HIT_ROWS}))",
    "tp_time_acc": f"coalesce(sum(time_f1) FILTER ({HIT_ROWS}), 0) / greatest(1, count(*) FILTER ({HIT_ROWS}))",
    "tp_loc_avg": f"count(*) FILTER ({HIT_ROWS}) / greatest(1, count(*) FILTER ({HIT_ROWS}))",
}
COUNTS = ("n", "n_pos", "n_neg", "overfire_count", "missed_count", "tp_n")
FINAL = "0.25 * json_valid_rate + 0.30 * is_schedule_acc + 0.45 * (title_f1_avg + time_match_rate + location_f1_avg) / 3"


@query(f"{PREDICTED}, z AS (SELECT {', '.join(f'{e} AS {c}' for c, e in METRICS.items())} FROM e) SELECT {', '.join(c if c in COUNTS else f'round({c}, 6) AS {c}' for c in METRICS)}, round({FINAL}, 6) AS final_score FROM z")
def a6_a7_a8_metrics(spark, sf_dir):
    out = evaluate.metrics(evaluate.score(*gold_and_predictions(spark, sf_dir)))
    return out.select(*COUNTS, *(F.round(c, 6).alias(c) for c in [*METRICS, "final_score"] if c not in COUNTS))


@query(f"{PREDICTED} SELECT event_id AS scenario_id, json_valid, status_match, CASE WHEN json_valid THEN title_f1 END AS title_f1, CASE WHEN json_valid THEN time_f1 END AS time_f1 FROM e")
def j1_d34_scores(spark, sf_dir):
    return evaluate.score(*gold_and_predictions(spark, sf_dir)).select("scenario_id", "json_valid", "status_match", "title_f1", "time_f1")


@query(f"{PREDICTED} SELECT event_id AS scenario_id, CASE WHEN NOT json_valid THEN 'json_parse_error' ELSE 'score_low' END AS reason FROM e WHERE NOT json_valid OR NOT status_match OR title_f1 < 0.7 OR time_f1 < 1 ORDER BY event_id LIMIT 200")
def f18_failures(spark, sf_dir):
    return evaluate.next_round(evaluate.failures(evaluate.score(*gold_and_predictions(spark, sf_dir)))).select("scenario_id", "reason")


@query(f"{PREDICTED} SELECT CASE WHEN NOT is_schedule AND pred_has THEN 'overfired' WHEN is_schedule AND NOT pred_has THEN 'missed' ELSE 'hit' END AS section, event_id AS scenario_id FROM e WHERE is_schedule OR pred_has")
def a9_audit(spark, sf_dir):
    return evaluate.audit(evaluate.score(*gold_and_predictions(spark, sf_dir))).select("section", "scenario_id")


@query()
def d32_d33_similarity(spark, sf_dir):
    rows = messages(spark, sf_dir)
    return rows.select("event_id", title_score(F.col("title"), F.col("body")).alias("title"), location_score(F.col("place"), F.col("body")).alias("place"))


@query()
def d23_mask_personal_data(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", F.md5(mask_personal_data(F.col("message")).cast("binary")).alias("masked_md5"))


NAMES = {True: fixed.NAMES_HANGUL, False: fixed.NAMES_LATIN}
PARTS = [f"CAST('0x' || substr(md5(sender), {1 + 8 * k}, 8) AS BIGINT)" for k in range(4)]
FOLDED = "0"
for part in PARTS:
    FOLDED = f"((({FOLDED}) * 16 + {part}) % 30)"


@query(f"{M} SELECT event_id, CASE WHEN regexp_matches(sender, '[가-힣]') THEN list_extract([{duck.quoted(fixed.NAMES_HANGUL)}], CAST({FOLDED} + 1 AS INT)) ELSE list_extract([{duck.quoted(fixed.NAMES_LATIN)}], CAST({PARTS[3]} % 16 + 1 AS INT)) END AS name FROM m")
def d25_pseudonym(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", first_pseudonym(F.col("sender")).alias("name"))


@query()
def d26_anonymize(spark, sf_dir):
    from msgloom.functions.anonymize import anonymize

    rows = with_events(spark, sf_dir).select("event_id", "sender", "message", "thread_context", "events")
    return anonymize(rows).select("event_id", "sender", "message", F.col("events")[0]["title"].alias("title"))


FEEDBACK = ("EDITED", "ADDED", "DISMISSED", "AUTO_ADDED")


def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_events(spark, sf_dir).withColumn("target", tokens.resolve_date(F.col("recv"), F.col("date")).cast("string"))
    gold = F.to_json(F.struct(F.col("is_schedule").alias("has_schedule"), F.array(event(F.col("target"))).alias("events")))
    kind = F.element_at(F.array(*map(F.lit, FEEDBACK)), (F.col("k") % 4 + 1).cast("int"))
    return rows.select("event_id", "message", F.when(F.col("k") % 13 == 0, "bad").otherwise(F.col("received_at")).alias("received_at"), kind.alias("feedback"), F.when(F.col("k") % 11 == 0, "{").otherwise(gold).alias("gold"))


FED = f"""{TOLD_DATES}, s AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'bad_gold' WHEN k % 13 = 0 AND k % 4 = 0 AND is_schedule THEN 'bad_received_at' END AS skip_reason FROM told),
b AS (SELECT *, k % 4 = 0 AND is_schedule AND skip_reason IS NULL AS edited FROM s)"""


@query(f"{FED} SELECT event_id, skip_reason, CASE WHEN edited THEN method ELSE '' END AS methods, edited AND method IN ('canonical', 'absolute-kept') AS review, CASE WHEN edited THEN token WHEN skip_reason IS NULL THEN strftime(target, '%Y-%m-%d') END AS date, CASE WHEN skip_reason IS NULL THEN title END AS title FROM b")
def d38_feedback_pairs(spark, sf_dir):
    e = F.try_element_at("gold.events", F.lit(1))
    return feedback.feedback_pairs(feedback_rows(spark, sf_dir)).select("event_id", "skip_reason", F.array_join("methods", ",").alias("methods"), "review", e["date"].alias("date"), e["title"].alias("title"))


@query(
    f"""{FED}, r AS (SELECT 'feedback' AS section, list_extract([{duck.quoted(FEEDBACK)}], k % 4 + 1) AS name FROM b WHERE skip_reason IS NULL UNION ALL SELECT 'method', method FROM b WHERE edited UNION ALL SELECT 'skipped', skip_reason FROM b WHERE skip_reason IS NOT NULL)
    SELECT section, name, count(*) AS rows FROM r GROUP BY ALL"""
)
def a13_feedback_report(spark, sf_dir):
    return feedback.feedback_report(feedback.feedback_pairs(feedback_rows(spark, sf_dir)))


@query(f"""{M} SELECT event_id, CASE k % 4 WHEN 0 THEN '{{"has_schedule":true}}' WHEN 1 THEN '{{"schedule_status":"no","events":[]}}' WHEN 2 THEN '{{"has_schedule":true,"events":[]}}' END AS gold FROM m""")
def d37_gold_for(spark, sf_dir):
    k = F.col("k") % 4
    status = F.when(k == 1, "DISMISSED").when(k == 2, "ADDED").otherwise("PENDING")
    own = F.when(k == 3, F.lit("{")).otherwise(F.lit('{"has_schedule":true,"events":[]}'))
    return messages(spark, sf_dir).select("event_id", feedback.gold_for(F.when(k == 0, F.lit('{"has_schedule":true}')), status, own).alias("gold"))


@query(f"{M} SELECT event_id, k % 3 = 0 AS abolished FROM m")
def d39_schema_gate(spark, sf_dir):
    gold = F.when(F.col("k") % 3 == 0, F.lit('{"has_schedule":true}')).otherwise(F.lit('{"is_schedule":true,"title":"x"}'))
    return messages(spark, sf_dir).select("event_id", validate.has_abolished_keys(gold).alias("abolished"))


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older rows whose stored start is what their message says, or, for some k, is not."""
    rows = messages(spark, sf_dir)
    none = F.lit(None).cast(schemas.TIME)
    told = tokens.resolve_when(F.col("received_at"), tokens.parse_date(F.col("body")), tokens.parse_time(F.col("body")), none)
    start = F.when(F.col("k") % 5 == 0, F.lit("2020-01-01T00:00:00+09:00")).otherwise(told["start"])
    stored = F.struct(start.alias("start"), F.lit(None).cast("string").alias("end"), F.lit(False).alias("all_day"))
    prefix = F.concat(F.col("channel"), F.lit("_"), F.col("event_id").cast("string"))
    out = rows.select(prefix.alias("scenario_id"), F.col("body").alias("message"), "received_at", F.array(stored).alias("events"))
    return feedback.tokens_from_absolute(out)


TOLD = f"{M}, o AS (SELECT *, k % 16 IN (0, 3, 7, 9, 11) AS has_date, k % 16 IN (0, 3) AS has_clock FROM m), c AS (SELECT *, CASE WHEN NOT has_date THEN 'no_date_token' WHEN k % 5 = 0 THEN CASE WHEN has_clock THEN 'roundtrip_fail' ELSE 'no_time' END WHEN has_clock THEN 'ok' ELSE 'ok_allday' END AS outcome FROM o)"


@query(f"{TOLD} SELECT outcome, count(*) AS rows FROM c GROUP BY outcome")
def a14_d12_outcomes(spark, sf_dir):
    return validate.outcomes(converted(spark, sf_dir))


@query(f"{TOLD} SELECT channel AS prefix, count(*) AS rows FROM c WHERE outcome IN ('ok', 'ok_allday') GROUP BY channel")
def a14_by_prefix(spark, sf_dir):
    return validate.successes_by_prefix(converted(spark, sf_dir))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as rows to generate from."""
    return messages(spark, sf_dir).select(F.col("event_id").alias("i"), "received_at", "channel", "sender")


def drawn(n: int, salt: str) -> str:
    return f"CAST(CAST('0x' || substr(md5((event_id) || '|{salt}|0'), 1, 8) AS BIGINT) % {n} AS INT)"


def listed(values: tuple, salt: str) -> str:
    return f"list_extract([{duck.quoted(values)}], {drawn(len(values), salt)} + 1)"


WEEKDAY = "CAST(isodow({0}) - 1 AS INT)"
LETTER = f"substr('{fixed.WEEKDAYS}', {{0}} + 1, 1)"
#: Whom a made row is from: the sender if a person, else a drawn name; and the particle behind the name.
WHO = f"CASE WHEN {PERSONAL} THEN {NAME} ELSE {listed(generate.PEOPLE, 'who')} END"
PARTICLE = "CASE WHEN (ord(right(who, 1)) - 44032) % 28 <> 0 THEN '과' ELSE '와' END"


@query(
    f"""{M}, g AS (SELECT *, {listed(tuple(fixed.DAY_WORDS), 'word')} AS tok, {drawn(4, 'word')} AS ahead, {listed(generate.ACTIVITIES, 'what')} AS what, 9 + {drawn(10, 'at')} AS clock_hour FROM m), t AS (SELECT *, recv + ahead AS intended FROM g)
    SELECT 'weekend_' || event_id AS scenario_id, channel, received_at, tok || ' ' || clock_hour || '시 ' || what AS message, what AS title, tok AS date, clock_hour AS hour, intended,
    ({WEEKDAY.format('recv')} < 5 AND {WEEKDAY.format('intended')} >= 5) OR {WEEKDAY.format('intended')} < {WEEKDAY.format('recv')} AS crosses_weekend FROM t"""
)
def g3_weekend_samples(spark, sf_dir):
    rows = generate.weekend_samples(seeds(spark, sf_dir))
    return rows.select("scenario_id", "channel", "received_at", "message", "title", "date", "time.hour", "intended", "crosses_weekend")


@query(
    f"""{M}, g AS (SELECT *, {drawn(100, 'kind')} AS roll FROM m), c AS (SELECT *, CASE WHEN roll < 45 THEN 'question' WHEN roll < 75 THEN 'cancel' WHEN roll < 90 THEN 'past' ELSE 'vague' END AS kind FROM g)
    SELECT 'negative_' || event_id AS scenario_id, channel, received_at, kind, CASE kind {' '.join(f"WHEN '{k}' THEN {listed(texts, 'text')}" for k, _, texts in generate.NEGATIVES)} END AS message, false AS is_schedule FROM c"""
)
def g4_negative_samples(spark, sf_dir):
    return generate.negative_samples(seeds(spark, sf_dir))


@query(
    f"""{M}, g AS (SELECT event_id, recv, received_at, {WHO} AS who, {listed(generate.SHAPES, 'shape')} AS shape, {listed(generate.ACTIVITIES, 'what')} AS what, {listed(generate.NEAR_DATES, 'date')} AS near, {listed(generate.LATER_DATES, 'new date')} AS later, 9 + {drawn(4, 'hour')} AS clock_hour, {listed(generate.MEETING_PLACES, 'place')} AS at_place FROM m),
    t AS (SELECT *, CASE WHEN shape = 'date change' THEN later ELSE near END AS tok FROM g),
    d AS (SELECT *, CAST({duck.resolve_date('recv', 'tok')} AS DATE) AS day FROM t)
    SELECT 'thread_' || event_id AS scenario_id, shape, near || ' ' || clock_hour || '시 ' || at_place || '에서 ' || what || ' 어때요?' AS asked, CASE shape WHEN 'time change' THEN (clock_hour + 2) || '시로 바꿀까요?' WHEN 'place change' THEN '{generate.OTHER_PLACE}에서 볼까요?' WHEN 'date change' THEN later || '로 미룰까요?' WHEN 'build-up' THEN '좋아요, 자료도 가져갈게요.' END AS answered,
    CASE WHEN shape <> 'unconfirmed' THEN who || {PARTICLE} || ' ' || what END AS title, CASE WHEN shape <> 'unconfirmed' THEN tok END AS date, CASE WHEN shape <> 'unconfirmed' THEN clock_hour + CASE WHEN shape = 'time change' THEN 2 ELSE 0 END END AS hour,
    CASE WHEN shape = 'place change' THEN '{generate.OTHER_PLACE}' WHEN shape <> 'unconfirmed' THEN at_place END AS location, CASE WHEN shape <> 'unconfirmed' THEN day END AS intended FROM d"""
)
def g5_thread_samples(spark, sf_dir):
    rows = generate.thread_samples(seeds(spark, sf_dir))
    said = lambda k: F.try_element_at("thread_context", F.lit(k))["message"]
    return rows.select("scenario_id", "shape", said(1).alias("asked"), said(2).alias("answered"), "title", "date", "time.hour", "location", "intended")


CLOCK = "printf('%02d:%02d', CAST((recv_minute + {0} + 1440) % 1440 // 60 AS INT), CAST((recv_minute + {0} + 1440) % 60 AS INT))"
CONFIRMED = f"""{M}, g AS (SELECT event_id, recv, recv_minute, received_at, {WHO} AS who, {drawn(7, 'weekday')} AS wd, {drawn(2, 'other')} AS other, {listed(generate.ACTIVITIES, 'what')} AS what FROM m),
    c AS (SELECT *, {LETTER.format('wd')} AS letter, CASE WHEN wd >= {WEEKDAY.format('recv')} THEN '이번주' ELSE '다음주' END || {LETTER.format('wd')} AS date, recv + CAST((wd - {WEEKDAY.format('recv')} + 7) % 7 AS INT) AS intended FROM g)"""


@query(
    f"""{CONFIRMED} SELECT 'confirm_' || event_id AS scenario_id, received_at, {CLOCK.format(-20)} || ' ' || letter || '요일에 ' || what || ' 괜찮으세요?' AS asked, {CLOCK.format(-5)} || ' ' || who AS answered,
    CASE WHEN other = 1 THEN month(recv - 20) || '/' || day(recv - 20) || ' 회의록 잘 받았어요. ' ELSE '' END || letter || '요일 좋아요!' AS message, what AS title, date, intended FROM c"""
)
def g6_confirm_samples(spark, sf_dir):
    rows = generate.confirm_samples(seeds(spark, sf_dir))
    turn = lambda k: F.element_at("thread_context", k)
    return rows.select("scenario_id", "received_at", F.concat_ws(" ", turn(1)["time"], turn(1)["message"]).alias("asked"), F.concat_ws(" ", turn(2)["time"], turn(2)["sender"]).alias("answered"), "message", "title", "date", "intended")


@query(f"{CONFIRMED} SELECT 'confirm_' || event_id AS scenario_id, date, intended FROM c")
def g9_resolved_samples(spark, sf_dir):
    """The generated rows behind the gate that lets them through only if every token resolves."""
    return validate.require_resolved(generate.confirm_samples(seeds(spark, sf_dir))).select("scenario_id", "date", "intended")


@query("SELECT 'ad_' || lpad(event_id::VARCHAR, CAST(greatest(3, length(event_id::VARCHAR)) AS INT), '0') AS scenario_id, strftime(DATE '2026-06-01' + CAST(event_id % 6 AS INT), '%Y-%m-%d') || printf('T%02d:%02d:00+09:00', CAST(8 + event_id % 12 AS INT), CAST(event_id * 7 % 60 AS INT)) AS received_at FROM events")
def g7_seed_records(spark, sf_dir):
    return seed_records(messages(spark, sf_dir)).select("scenario_id", "received_at")


def seed_records(rows: DataFrame) -> DataFrame:
    return generate.seed_records(rows.select(F.col("event_id").alias("row_ord"), "sender", F.col("body").alias("message")), "ad", "sms")


@query(f"{M} SELECT event_id, 's' || event_id AS scenario_id, CAST(1 AS BIGINT) AS rows FROM m")
def g8_generated_rows(spark, sf_dir):
    text_column = F.concat(F.lit('# note\n\n`{"message":"'), F.col("event_id").cast("string"), F.lit('"}`\n{"message": broken\nplain'))
    rows = messages(spark, sf_dir).select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("scenario_id"), text_column.alias("text"))
    out = io.generated_rows(rows)
    return out.groupBy(F.col("message").cast("long").alias("event_id"), "scenario_id").agg(F.count("*").alias("rows"))
