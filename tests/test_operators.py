"""Operators whose results SQL does not state, and edge cases: nulls, ties, empty arrays."""

import hashlib
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from msgloom.functions import anonymize, fixed, keys, similarity, substrings, text
from msgloom.operators import conversation, curate, events, generate, labels
from msgloom.plans import message_flow
from msgloom.plans.message_flow import to_events
from msgloom.queries.all import QUERIES
from msgloom.queries.messages import keyed_events, messages
from msgloom.queries.workloads import labelled, stored_events
from msgloom.sources import io, store


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, last = [0], row
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(row[-1], last[k + 1]))
    return row[-1]


@pytest.mark.parametrize("a, b", [("주간 회의", "회의"), ("abcabc", "bca"), ("", "x"), ("kitten", "sitting"), ("a b c", "c b")])
def test_common_subsequence(a, b):
    assert similarity.common(a, b) == lcs(a, b)


def test_similarity(spark):
    rows = [(None, "", 1.0, 1.0), ("a", None, 0.0, 0.0), ("주간 회의", "회의 주간", 1.0, None), ("회의", "주간 회의", 1.0, 1.0), (" ", "a", 0.0, None), ("강남역", "강남역 3번", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, title double, place double")
    for r in df.withColumn("t", similarity.title_score(F.col("a"), F.col("b"))).withColumn("p", similarity.location_score(F.col("a"), F.col("b"))).collect():
        assert r.t == pytest.approx(r.title)
        if r.place is not None:
            assert r.p == pytest.approx(r.place)
    assert similarity.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0
    assert similarity.partial_ratio("abcd", "xxabcdxx") == 1.0


def test_repeats_compare_with_the_last_kept(spark):
    times = [0, 8, 16, 17, 40]
    rows = [("c", t, k, "s", "b") for k, t in enumerate(times)] + [("d", 0, 0, "s", "b"), ("d", 1, 1, "s", "x"), ("d", 2, 2, "s", "b")]
    df = spark.createDataFrame(rows, "conversation string, seconds long, seq long, sender string, body string")
    kept = conversation.suppress_repeats(df).orderBy("conversation", "seconds").collect()
    assert [r.seconds for r in kept if r.conversation == "c"] == [0, 16, 40]
    assert [r.seconds for r in kept if r.conversation == "d"] == [0, 1, 2]
    assert conversation.suppress_repeats(df.limit(0)).count() == 0


def test_long_runs_of_repeats_equal_a_replay(spark):
    draw = random.Random(3)
    rows, at = [], {"c": 0, "d": 0}
    for k in range(6000):
        room = draw.choice("cd")
        at[room] += draw.choice([0, 1, 1, 2, 3, 12] if k % 50 == 0 else [0, 1, 1, 2])
        rows.append((room, at[room], k, "bot", "x" if draw.random() < 0.999 else "y"))
    rows.append(("e", None, 0, "bot", "x"))
    rows += [("e", k, 1 + k, "bot", "x") for k in range(12)]
    rows.append((None, 1, 0, None, None))
    want, last = [], {}
    for room, time, k, sender, body in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        before = last.get(room)
        if before is None or before[0] != body or time is None or before[1] is None or time - before[1] >= 10:
            last[room] = (body, time)
            want.append((room or "", k))
    df = spark.createDataFrame(rows, "conversation string, seconds long, seq long, sender string, body string")
    got = conversation.suppress_repeats(df).collect()
    assert sorted((r.conversation or "", r.seq) for r in got) == sorted(want)
    assert len(got) < 2000


def test_context_is_bounded_by_turns_and_age(spark):
    rows = [("c", 400 * k, k, "sms", "s", f"b{k}", f"t{k}") for k in range(9)] + [("m", 400 * k, k, "gmail", "s", "b", "t") for k in range(2)]
    df = spark.createDataFrame(rows, "conversation string, seconds long, seq long, channel string, sender string, body string, clock string")
    out = {(r.conversation, r.seq): [t.message for t in r.context] for r in conversation.with_context(df).collect()}
    assert out["c", 8] == ["b4", "b5", "b6", "b7"] and out["c", 0] == [] and out["m", 1] == []


def test_context_of_a_hot_room_comes_from_its_slices(spark):
    draw, at, rows = random.Random(5), 3_000_000, []
    for k in range(3000):
        at += draw.choice([0, 0, 5, 60, 500, 1799, 1800, 1801, 9000, 30000] if k % 7 == 0 else [0, 5, 200])
        rows.append(("hot", None if k % 211 == 0 else at, k, "gmail" if k % 97 == 0 else "sms", f"s{k % 3}", f"b{k}", f"t{k}"))
    rows += [(None, 10, 0, "sms", None, None, None), (None, 20, 1, None, "s", "b", "t"), ("cold", -5, 0, "sms", "s", "x", "t"), ("cold", 5, 1, "sms", "s", "y", "t")]
    want = {}
    for room in ("hot", None, "cold"):
        told = sorted((r for r in rows if r[0] == room), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for k, (_, now, seq, channel, *_rest) in enumerate(told):
            seen = [r for r in told[max(0, k - 5) : k] if now is not None and r[1] is not None and r[1] >= now - 1800]
            want[room, seq] = [] if channel == "gmail" else [(r[6], r[4], r[5]) for r in seen]
    df = spark.createDataFrame(rows, "conversation string, seconds long, seq long, channel string, sender string, body string, clock string")
    for hours in (0, 1, 6):
        out = conversation.with_context(df, hours=hours)
        assert out.columns == [*df.columns, "context"]
        got = out.collect()
        assert len(got) == len(rows) and {(r.conversation, r.seq): [tuple(t) for t in r.context] for r in got} == want
        assert re.search(r"hashpartitioning\(conversation#\d+, _place#\d+\.slice|hashpartitioning\(conversation#\d+, _w\d+#", out._jdf.queryExecution().toString())
    assert conversation.with_context(df.limit(0)).count() == 0


def test_capped_selection_equals_its_rules(spark):
    draw = random.Random(3)
    rows = [(f"k{k}", "keep" if draw.random() < 0.05 else "pool", draw.random() < 0.5, draw.random() < 0.3, draw.choice([0.2, 0.5, 0.6, 1.0]), draw.choice([0.0, 1.5, 3.0])) for k in range(4000)]
    df = spark.createDataFrame(rows, "pair_key string, kind string, real boolean, is_schedule boolean, grounding double, difficulty double").repartition(5)
    digest = lambda key: hashlib.md5(f"{key}|0".encode()).hexdigest()
    by_class = {True: lambda r: (r[4] < 0.6, -r[5], -r[4], digest(r[0])), False: lambda r: (-r[5], digest(r[0]))}

    def plain(cap, share):
        keep, pool = [r for r in rows if r[1] == "keep"], [r for r in rows if r[1] == "pool"]
        negatives = int(round(cap * share))
        chosen = list(keep)
        for label, goal in ((True, cap - negatives), (False, negatives)):
            most = max(0, goal - sum(r[3] == label for r in keep))
            chosen += sorted((r for r in pool if r[3] == label), key=by_class[label])[:most]
        if len(chosen) < cap:
            names = {r[0] for r in chosen}
            chosen += sorted((r for r in pool if r[0] not in names), key=lambda r: digest(r[0]))[: cap - len(chosen)]
        gone = {r[0] for r in sorted((r for r in chosen if not r[2]), key=lambda r: digest(r[0]))[: max(0, len(chosen) - cap)]}
        return sorted(r[0] for r in chosen if r[0] not in gone)

    # both classes cut, one class short, the pool short, more kept than wanted, all, nothing
    for cap, share in ((1000, 0.5), (2500, 0.1), (3990, 0.5), (100, 0.5), (5000, 0.5), (0, 0.5)):
        assert sorted(r.pair_key for r in curate.capped_selection(df, cap, share).select("pair_key").collect()) == plain(cap, share), (cap, share)
    plan = curate.first_rows(df, 3000, F.col("pair_key"))
    assert plan.count() == 3000 and "TakeOrdered" not in plan._jdf.queryExecution().toString()
    assert curate.capped_selection(df.limit(0), 10, 0.5).count() == 0


def event_rows(spark, rows):
    return spark.createDataFrame(rows, "channel string, start string, room string, base_title string, sender string, title string, event_key string, status string, created_at long, seq long")


def test_merge_events(spark):
    day = 86_400_000
    rows = [
        ("k", "2026", "r1", "기타 회의", "s", "기타 회의", "a", "PENDING", 0, 0),
        ("k", "2026", "r1", "동기회", "s", "동기회", "b", "PENDING", 1, 1),
        ("k", "2026", "r2", "점심", "s", "점심", "c", "PENDING", 2, 2),
        ("k", "2026", "", "점심", "s", "점심", "d", "PENDING", 3, 3),
        ("k", "2026", "", "저녁", "s", "저녁", "e", "DISMISSED", 4, 4),
        ("k", "2026", "", "저녁", "s", "저녁", "f", "PENDING", 5, 5),
        ("k", "2026", "r1", "동기회", "s", "동기회", "g", "PENDING", 31 * day, 6),
        ("k", None, "r9", "면접", "s", "면접", "h", "PENDING", 0, 7),
        ("k", None, "r9", "회의", "s", "회의", "i", "PENDING", 1, 8),
        ("k", "2027", "", "", "s", "", "same", "PENDING", 0, 9),
        ("k", "2027", "", "", "s", "", "same", "PENDING", 1, 10),
    ]
    got = {r.event_key: r for r in events.merge_events(event_rows(spark, rows)).collect()}
    assert set(got) == {"a", "c", "e", "f", "g", "h", "same"}
    assert (got["a"].base_title, got["a"].merged) == ("동기회", 1) and got["c"].merged == 1 and got["h"].base_title == "면접"
    assert events.merge_events(event_rows(spark, [])).count() == 0


def replayed(rows):
    """A plain replay of the store's rules: newest match by room, else by title, else a new event unless its key is there."""
    store = []
    for row in sorted(rows, key=lambda r: (r["created_at"], r["seq"])):
        own = [e for e in store if all(e[c] == row[c] for c in ("user_id", "channel", "start"))]
        live = [e for e in own if e["status"] != "DISMISSED" and 0 <= row["created_at"] - e["created_at"] <= 30 * 86_400_000]
        live.sort(key=lambda e: (e["created_at"], e["seq"]))
        met = [e for e in live if row["room"].strip() and e["room"] == row["room"]]
        if not met:
            titled = [e for e in live if row["base_title"].strip() and e["base_title"] == row["base_title"]][-1:]
            met = [e for e in titled if not row["room"].strip() or not e["room"].strip() or e["room"] == row["room"]]
        if met:
            event, old, new = met[-1], met[-1]["base_title"], row["base_title"]
            event["merged"] += 1
            if new.strip() and (not old.strip() or (old in fixed.GENERIC_TITLES and new not in fixed.GENERIC_TITLES)):
                event["base_title"], event["title"] = new, new.strip()
        elif row["event_key"] not in {e["event_key"] for e in own}:
            store.append({**row, "merged": 0})
    return sorted((e["user_id"], e["channel"], e["start"] or "", e["event_key"], e["created_at"], e["base_title"], e["title"] or "", e["merged"]) for e in store)


def seen(df):
    return sorted((r.user_id, r.channel, r.start or "", r.event_key, r.created_at, r.base_title, r.title or "", r.merged) for r in df.collect())


def test_merging_equals_a_replay_in_batch_and_stream(spark, sf_dir):
    rows = [r.asDict() for r in keyed_events(spark, sf_dir).collect()]
    want = replayed(rows)
    assert sum(e[-1] for e in want) > 5 and any(e[-1] and not e[2] for e in want)
    assert seen(QUERIES["w4_merge_events"](spark, sf_dir)) == want
    assert seen(QUERIES["t4_merge_stream"](spark, sf_dir)) == want
    assert seen(QUERIES["w4_event_store"](spark, sf_dir)) == want
    one = keyed_events(spark, sf_dir).withColumn("user_id", F.lit(1).cast("long"))
    assert seen(events.merge_events(one, owner=("user_id",))) == replayed([r | {"user_id": 1} for r in rows])


def test_merging_into_stored_events(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).withColumn("user_id", F.lit(1).cast("long"))
    cut = rows.agg(F.percentile_approx("created_at", 0.5)).first()[0]
    first = events.merge_events(rows.where(F.col("created_at") <= cut), owner=("user_id",))
    both = events.merge_events(rows.where(F.col("created_at") > cut), first, ("user_id",))
    assert seen(both) == replayed([r.asDict() for r in rows.collect()])


def test_store_rewrites_only_touched_buckets(spark, sf_dir, tmp_path):
    rows = keyed_events(spark, sf_dir)
    path, some = f"file://{tmp_path}/store", rows.where("user_id % 10 = 0")
    cut = rows.agg(F.percentile_approx("created_at", 0.5)).first()[0]
    first, second = rows.where(F.col("created_at") <= cut), some.where(F.col("created_at") > cut)
    assert store.merge_into_store(first, path, ("user_id",), 32) == 1
    # a run that died after writing data has left no version
    second.write.parquet(f"{path}/data/version=2/bucket=99")
    assert store.versions(spark, path) == [1] and seen(store.read_store(spark, path)) == replayed([r.asDict() for r in first.collect()])
    assert store.merge_into_store(second, path, ("user_id",), 32) == 2
    assert store.merge_into_store(second.limit(0), path, ("user_id",), 32) == 2
    assert seen(store.read_store(spark, path)) == replayed([r.asDict() for r in first.union(second).collect()])
    held = store.manifest(spark, path, 2)
    assert set(held.values()) == {1, 2} and sum(v == 2 for v in held.values()) <= second.select("user_id").distinct().count()
    store.vacuum(spark, path, keep=1)
    assert store.versions(spark, path) == [2] and seen(store.read_store(spark, path)) == replayed([r.asDict() for r in first.union(second).collect()])
    # buckets that only version 1 read are gone
    left = {p.name for p in (tmp_path / "store/data/version=1").iterdir() if p.name.startswith("bucket=")}
    assert left == {f"bucket={b}" for b, v in held.items() if v == 1}


def test_occurrences_of_golden_texts(spark):
    train = spark.createDataFrame([(1, "see: Meeting at\n5pm  tomorrow!"), (2, "meeting at 6pm"), (3, "Yes"), (4, "yes, yes"), (5, None), (6, "")], "id long, message string")
    golden = spark.createDataFrame([("meeting AT 5pm",), ("yes",), (None,), (" ",)], "message string")
    assert sorted(r.id for r in curate.occurrences(train, golden).collect()) == [1, 3]
    assert curate.occurrences(train, golden.limit(0)).count() == 0
    assert sorted(curate.occurrences(train, golden).columns) == ["id", "message"]


def test_occurrences_equal_brute_force_in_parts(spark, monkeypatch):
    """Texts of many lengths, periodic ones too, in three parts; what a task holds of them does not grow with their lengths."""
    monkeypatch.setattr(curate, "PART_TEXTS", 40)
    draw = random.Random(3)
    drawn = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    golden = [drawn(letters, n) for letters in ("ab", "회의a") for n in (1, 3, 7, 8, 9, 15, 16, 17, 31, 64, 65, 130, 300) for _ in range(4)]
    train = [drawn("ab", draw.randrange(200)) for _ in range(60)] + [drawn("b", 9) + draw.choice(golden).upper() + drawn("회a ", 9) for _ in range(60)] + ["a" * 500, *golden[:9]]
    want = [k for k, t in enumerate(said.lower().replace(" ", "") for said in train) if any(g == t or len(g) >= 8 and g in t for g in golden)]
    rows, marks = spark.createDataFrame(list(enumerate(train)), "id long, message string"), spark.createDataFrame([(g,) for g in golden], "message string")
    assert sorted(r.id for r in curate.occurrences(rows, marks).collect()) == want
    assert 0 < len(want) < len(train)
    assert substrings.digests(["a" * 1_000_000], 8).nbytes < 100


def test_quota_in_one_pass(spark):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 < 8 THEN 'a' WHEN id % 10 = 8 THEN 'b' END AS s")
    got = curate.quota(rows.repartition(7), F.col("s"), {"a": 30, "c": 5}, F.desc("id")).collect()
    assert sorted(r.id for r in got) == [r.id for r in rows.where("s = 'a'").orderBy("id").tail(30)]
    assert curate.quota(rows, F.col("s"), {}, "id").count() == 0


def test_merging_without_a_start(spark):
    rows = [("k", None, "r1", "면접", "s", "면접", "a", "PENDING", 0, 0), ("k", None, "", "면접", "s", "면접", "b", "PENDING", 1, 1), ("k", None, "", "", "s", "일정", "c", "PENDING", 2, 2)]
    got = {r.event_key: r.merged for r in events.merge_events(event_rows(spark, rows)).collect()}
    assert got == {"a": 1, "c": 0}


def test_windows_of_places_equal_plain_search():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        plain = lambda x, y: max(similarity.ratio(x, y[max(0, k) : k + len(x)]) for k in range(1 - len(x), len(y)))
        want = plain(short, long) if len(a) != len(b) else max(plain(a, b), plain(b, a))
        assert similarity.partial_ratio(a, b) == pytest.approx(want), (a, b)
    start = time.monotonic()
    similarity.partial_ratio("가나다라마바사" * 40, "아자차카타파하" * 3000)
    assert time.monotonic() - start < 5


def test_similarity_query_equals_its_rules(spark, sf_dir):
    rows = {r.event_id: r for r in messages(spark, sf_dir).collect()}
    got = {r.event_id: r for r in QUERIES["d32_d33_similarity"](spark, sf_dir).collect()}
    assert set(got) == set(rows)
    for k, r in rows.items():
        for value, text, score in ((r.title, got[k].title, similarity.token_set_ratio), (r.place, got[k].place, similarity.partial_ratio)):
            want = (1.0 if not r.body else 0.0) if not value else (score(value, r.body) if r.body else 0.0)
            assert text == pytest.approx(want), r


def plain_masks(text):
    """Masks by kinds in order at each place."""
    out, at = [], 0
    while at < len(text):
        for _, pattern, mask in fixed.PERSONAL_DATA:
            m = re.compile(pattern).match(text, at)
            if m and m.end() > at:
                out.append(mask)
                at = m.end()
                break
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def test_mask_query_equals_plain_masks(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = dict(QUERIES["d23_mask_personal_data"](spark, sf_dir).collect())
    for k, text in texts.items():
        assert got[k] == hashlib.md5(plain_masks(text).encode()).hexdigest(), k


def test_masks_equal_the_plain_pattern_and_are_linear():
    plain = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern, _ in fixed.PERSONAL_DATA) + r"|Tom|ab\.c")
    masks = {kind: mask for kind, _, mask in fixed.PERSONAL_DATA}
    given = {"Tom": "Ann", "ab.c": "Q"}
    rng = random.Random(1)
    parts = ["a", "b", "Tom", "ab.c", "@", ".", "-", "+", " ", "010-1234-5678", "123456 - 1234567", "2026-06-05", "http://", "x", "1111-2222-3333-4444", "\n", "가", "_"]
    for _ in range(20_000):
        said = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert anonymize.Swap(given)(said) == plain.sub(lambda m: given.get(m.group(), masks.get(m.lastgroup)), said)
    for said in ("a" * 1_000_000, "a@" * 500_000, "a.b-" * 250_000, "1" * 1_000_000, "a@b." * 250_000):
        start = time.time()
        anonymize.masked(said)
        assert time.time() - start < 3


def test_anonymize_query_equals_plain_rules(spark, sf_dir):
    rows = {r.event_id: r for r in messages(spark, sf_dir).collect()}
    for r in QUERIES["d26_anonymize"](spark, sf_dir).collect():
        was = rows[r.event_id]
        name = was.sender.replace(fixed.WEB_MARK, "").strip()
        person = bool(re.fullmatch("[가-힣]{2,4}", name)) and not re.search(fixed.ORGANISATION, name)
        given = anonymize.pseudonyms([was.sender, *([name] if person else [])])
        assert r.sender == (was.sender.replace(name, given[name]) if person else was.sender)
        for text, new in ((was.body, r.message), (was.title, r.title)):
            want = text
            if text:
                # longest names first, each with a mark that no other rule touches, then masks
                for n, old in enumerate(sorted(given, key=len, reverse=True)):
                    want = want.replace(old, chr(0xE000 + n))
                want = plain_masks(want)
                for n, old in enumerate(sorted(given, key=len, reverse=True)):
                    want = want.replace(chr(0xE000 + n), given[old])
            assert new == want, was


def test_assembly_query_keeps_its_promises(spark, sf_dir):
    """The flagship: at most the cap, no key twice, shares as asked, every kept row in, texts anonymised."""
    rows = labelled(spark, sf_dir).collect()
    got = QUERIES["workload_assembly"](spark, sf_dir).collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r.kind != "keep", r.source_ord, r.row_ord)):
        first.setdefault(r.pair_key, r)
    chosen = {r.event_id for r in got}
    assert len(got) == len(chosen) == 300 and chosen <= {r.event_id for r in first.values()}
    kept = {r.event_id for r in first.values() if r.kind == "keep"}
    assert kept <= chosen
    assert abs(sum(not r.is_schedule for r in got) / len(got) - 0.55) < 0.02
    worst = {c: min((r.difficulty for r in got if r.is_schedule == c and r.event_id not in kept), default=0) for c in (True, False)}
    assert worst[False] >= 0 and all(0 <= r.grounding <= 1 for r in got)


def flow_replayed(said):
    """The whole flow row by row: buffer, gates of both ways, store. Row-wise values come from the library's own columns."""
    b = F.col("body")
    author = F.when((F.col("event_id") % 11 == 0) & (F.col("event_id") % 2 == 0), F.lit("박서준")).otherwise(F.col("sender"))
    gold = F.struct(F.nullif("title", F.lit("")).alias("title"), "date", F.when(F.col("has_time"), F.struct("hour", "minute", "marker")).alias("time"), F.lit(None).cast("struct<hour:int,minute:int,marker:string>").alias("end_time"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("description"))
    rows = said.withColumn("event", events.resolved_event(F.col("received_at"), author, gold))
    rows = rows.withColumns({"cue": text.has_cue(b), "done": text.is_completed(b), "paid": text.is_payment(b, F.col("recv")), "start": F.col("event.start"), "made": F.col("event.title")})
    rows = rows.withColumns({"event_key": keys.event_key(F.col("channel"), F.col("received_at"), F.col("start"), F.col("made")), "status": events.route(F.lit(True), F.col("made"), F.col("start"), F.lit("2024-01-15").cast("date"))})
    rows = sorted((r.asDict() for r in rows.collect()), key=lambda r: (r["seconds"], r["seq"]))
    kept, before, passed = {}, {}, []
    for r in rows:
        blank = not (r["body"] or "").strip()
        cue, earlier = r["cue"], before.get(r["user_id"], False)
        before[r["user_id"]] = r["cue"]
        if r["event_id"] % 11 == 0:
            cue = cue or earlier
        elif not blank:
            last = kept.get(r["conversation"])
            if last and (last["sender"], last["body"]) == (r["sender"], r["body"]) and r["seconds"] - last["seconds"] < 10:
                continue
            kept[r["conversation"]] = r
        if not blank and cue and not r["done"] and not r["paid"] and r["is_schedule"]:
            passed.append({**r, "created_at": 1000 * r["seconds"], "base_title": r["title"] or "", "title": r["made"]})
    return passed


def test_message_flow_equals_a_replay(spark, sf_dir):
    said = messages(spark, sf_dir)
    for spread in (1, 400_000):  # as it is, and with messages of one start months apart
        rows = said.withColumn("seconds", F.col("seconds") * spread).cache()
        passed = flow_replayed(rows)
        want = replayed(passed)
        got = stored_events(rows).withColumn("title", F.lit("")).collect()
        assert sorted((r.user_id, r.channel, r.start or "", r.event_key, r.created_at, r.base_title, r.merged) for r in got) == [(*e[:6], e[7]) for e in want]
        status = {(r["user_id"], r["event_key"]): r["status"] for r in reversed(passed)}
        assert all(r.status == status[r.user_id, r.event_key] for r in got)
        assert sum(e[7] for e in want) > 0 and any(r["event_id"] % 11 == 0 and not r["cue"] for r in passed)
    in_calendar = QUERIES["workload_calendar_rows"](spark, sf_dir).collect()
    stored = [r for r in QUERIES["workload_message_flow"](spark, sf_dir).collect() if r.status == "AUTO_ADDED"]
    assert sorted((r.user_id, r.event_key) for r in in_calendar) == sorted((r.user_id, r.event_key) for r in stored)
    assert all(r.end_millis - r.start_millis in (3_600_000, 86_400_000) for r in in_calendar)


def test_blank_and_switched_off_messages_stay_out_of_the_context(spark):
    columns = "channel string, conversation string, sender string, room string, seq long, seconds long, clock string, received_at string, body string"
    rows = [("sms", "c", "a", "", k, 60 * k, f"10:0{k}", "2026-06-15T10:00:00+09:00", t) for k, t in enumerate(["내일 3시 회의", " ", None, "내일 5시 회의"])]
    rows += [("gmail", "c", "a", "", 9, 100, "10:01", "2026-06-15T10:00:00+09:00", "내일 7시 회의")]
    channels = spark.createDataFrame([("sms", True), ("gmail", False)], "channel string, enabled boolean")
    both = [("sms", "c", "나", "", 5, 400, "10:06", "2026-06-15T10:06:00+09:00", "네", [("10:05", "a", t)], True, " ") for t in ("내일 3시 회의", "안녕")]
    scraped = spark.createDataFrame(both, f"{columns}, thread_context array<struct<time:string,sender:string,message:string>>, from_me boolean, counterpart string")
    got = message_flow.to_prompts(spark.createDataFrame(rows, columns), channels, "s", scraped).collect()
    assert sorted((r.seq, r.body, [t.message for t in r.thread_context], r.from_me) for r in got) == [(0, "내일 3시 회의", [], False), (3, "내일 5시 회의", ["내일 3시 회의"], False), (5, "네", ["내일 3시 회의"], True)]
    said = message_flow.to_prompts(spark.createDataFrame(rows, columns), channels, "s", scraped).withColumn("output", F.lit('{"is_schedule": true, "title": "회식", "date": "내일"}'))
    made = {r.seq: r for r in to_events(said, spark.createDataFrame([], "sender string, token string"), F.lit("2026-01-01").cast("date")).collect()}
    assert made[0].merged == 2 and made[0].title == "회식 [a]" and made[0].created_at == 0  # all three are one event


def test_roster_reaches_every_message(spark, sf_dir):
    rows = {r.event_id: r for r in messages(spark, sf_dir).collect()}
    got = {r.event_id: r for r in QUERIES["u3_attendee_union"](spark, sf_dir).collect()}
    assert set(got) == set(rows)
    named = {4: ["민수진", "영희", "Tom Lee"], 13: ["Anna", "이영"]}
    machine = ("010-1234-5678", "team@corp.com", "나")
    tag = {"김민수 한빛상사 영업": "김민수(한빛상사)", "[Web발신] 국민은행": "국민은행", "박서준": "박서준"}
    met = 0
    for k, r in rows.items():
        names = named.get(r.k % 16, [])
        assert got[k].attendees == ",".join(sorted({r.sender, *names})), r
        if not names or not (r.title or "").strip():
            assert got[k].title == r.title
            continue
        met += 1
        base = r.title.strip()
        assert got[k].title == (base if r.sender in machine or tag[r.sender] in base else f"{base} [{tag[r.sender]}]"), r
    assert met > 20


def test_events_carry_the_roster(spark):
    columns = "channel string, sender string, room string, seq long, seconds long, received_at string, message string, output string"
    text = '{"is_schedule": true, "title": "회식", "date": "내일", "attendees": ["영희"]}'
    rows = [("sms", "박서준", "", 1, 10, "2026-06-15T10:00:00+09:00", "명단 1. 민수진 2. 영희", text), ("sms", "박서준", "", 2, 20, "2026-06-16T10:00:00+09:00", None, text.replace("회식", "면접"))]
    aliases = spark.createDataFrame([], "sender string, token string")
    got = {r.base_title: r for r in to_events(spark.createDataFrame(rows, columns), aliases, F.lit("2026-06-15").cast("date")).collect()}
    assert got["회식"].attendees == ["영희", "민수진"] and got["회식"].title == "회식 [박서준]" and got["면접"].attendees == ["영희"]


def test_seed_records_of_any_size(spark, sf_dir):
    seeds = spark.createDataFrame([(k, "s", "m") for k in (0, 7, 100, 999, 1000, 1009, 123456)], "row_ord long, sender string, message string")
    assert [r.scenario_id for r in generate.seed_records(seeds, "ad", "sms").orderBy("row_ord").collect()] == ["ad_000", "ad_007", "ad_100", "ad_999", "ad_1000", "ad_1009", "ad_123456"]
    ids = [r.event_id for r in messages(spark, sf_dir).collect()]
    assert sorted(r.scenario_id for r in QUERIES["g7_seed_records"](spark, sf_dir).collect()) == sorted(f"ad_{k:03d}" for k in ids)


def test_shuffle_keeps_all_rows(spark, sf_dir):
    ids = [r.event_id for r in messages(spark, sf_dir).collect()]
    want = sorted(ids, key=lambda k: hashlib.md5(f"{k}|7".encode()).hexdigest())
    got = QUERIES["w13_shuffle"](spark, sf_dir).collect()
    assert [(r.event_id, r.place) for r in got] == [(k, n + 1) for n, k in enumerate(want)]


def test_masks_in_one_pass():
    assert anonymize.masked("a@b.co 010-1234-5678 http://x.y/z 123456-1234567") == "user@example.com 010-0000-0000 http://example.com 000000-0000000"
    assert anonymize.masked("2026-06-05") == "000-000-000000" and anonymize.masked("2026-06-05", protect_dates=True) == "2026-06-05"


def test_anonymize_gives_a_name_one_pseudonym(spark):
    kind = "array<struct<time:string,sender:string,message:string>>"
    event = "array<struct<title:string,location:string,description:string,organizer:string,attendees:array<string>,date:string>>"
    df = spark.createDataFrame([("김민수", "김민수 이지은 만나", [("t", "이지은", "김민수!")], [("김민수 면담", None, None, None, ["이지은"], "내일")]), (None, None, None, None)], f"sender string, message string, thread_context {kind}, events {event}")
    one = anonymize.anonymize(df).collect()[0]
    given = anonymize.pseudonyms(["김민수", "이지은"])
    assert one.sender == given["김민수"] and one.message == f"{given['김민수']} {given['이지은']} 만나"
    assert one.events[0].title == f"{given['김민수']} 면담" and one.events[0].attendees == [given["이지은"]] and one.events[0].date == "내일"
    shown = spark.createDataFrame([("김민수",), ("Tom Lee",)], "n string").select("n", anonymize.first_pseudonym(F.col("n")).alias("p")).collect()
    assert all(r.p == anonymize.pseudonyms([r.n])[r.n] for r in shown)
    many = anonymize.pseudonyms([f"이름{k}" for k in range(40)])
    assert len(set(many.values())) == 40


def test_plug_ins(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, body string")
    assert [r.output for r in events.predict(df, lambda rows: [f"{r['id']}" for r in rows]).orderBy("id").collect()] == ["1", "2"]

    def judge(row):
        if row["body"] is None:
            raise ValueError("no body")
        return "ok"

    got = labels.label(df, judge).orderBy("id").collect()
    assert [(r.label, r.error) for r in got] == [("ok", None), (None, "ValueError: no body")]


def test_generators_label_right(spark):
    for make in (generate.weekend_samples, generate.thread_samples, generate.confirm_samples):
        assert generate.label_errors(make(generate.numbered(spark, 500))).count() == 0
    words = spark.createDataFrame([("김민수",), ("이지은",), ("Tom",)], "w string").select(generate.particle(F.col("w")).alias("p"))
    assert [r.p for r in words.collect()] == ["와", "과", "와"]
    clock = spark.range(1).select(generate.plus_minutes(F.lit("23:50"), F.lit(15)).alias("a"), generate.plus_minutes(F.lit("00:05"), F.lit(-10)).alias("b")).first()
    assert (clock.a, clock.b) == ("00:05", "23:55")


def test_files(spark, tmp_path):
    path = f"{tmp_path}/pairs"
    rows = spark.createDataFrame([("a", "m1"), ("b", None)], "scenario_id string, message string")
    io.write_pairs(rows, path)
    assert {(r.scenario_id, r.message) for r in io.read_pairs(spark, path).collect()} == {("a", "m1"), ("b", None)}
    io.append_new(spark.createDataFrame([("b", "x"), ("c", "y")], rows.schema), path, "scenario_id")
    assert sorted(r.scenario_id for r in io.read_pairs(spark, path).collect()) == ["a", "b", "c"]
    io.append_new(rows, f"{tmp_path}/new", "scenario_id")
    assert io.read_pairs(spark, f"{tmp_path}/new").count() == 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one.jsonl").write_text('{"message": "m", "_feedback": "ADDED"}\n\nnot json\n')
    (tmp_path / "f" / "x_review.jsonl").write_text('{"message": "no"}\n')
    got = io.read_feedback(spark, f"{tmp_path}/f/*.jsonl").collect()
    assert sorted(str(r.bad_line) for r in got) == ["None", "not json"]


def test_text_edges(spark):
    one = spark.createDataFrame([(None, "")], "n string, e string").select(
        text.has_cue(F.col("n")).alias("cue"), text.compose_title(F.col("n"), F.col("n")).alias("title"), text.with_links(F.col("n"), F.col("e")).alias("links"),
        F.size(text.roster(F.col("e"))).alias("roster"), text.clean_from(F.col("e")).alias("sender"), text.json_block(F.col("e")).alias("block"),
    ).first()
    assert tuple(one) == (False, "일정", None, 0, "", "")
    assert isinstance(one, tuple) and pd.isna(one.links)
