"""Token rules against a plain-Python form written from the rules."""

import calendar
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from msgloom.functions import fixed, tokens
from msgloom.queries.all import QUERIES
from msgloom.queries.messages import messages

DAYS = [dt.date(2027, 12, 25) + dt.timedelta(k) for k in range(0, 140, 3)] + [dt.date(2028, 2, 29), dt.date(2026, 1, 31), dt.date(2026, 12, 31)]
TOKENS = (
    list(fixed.DAY_WORDS) + [*fixed.WEEK_WORDS, *fixed.WEEKEND_WORDS, *fixed.DATE_ALIASES]
    + [w + d for w in fixed.WEEK_WORDS for d in fixed.WEEKDAYS] + [d + "요일" for d in fixed.WEEKDAYS]
    + ["0일", "1일", "15일", "31일", "45일", "3일후", "10주후", "1개월후", "13개월후", "4년후", "99999년후", "6월16일", "6/16", "5.29", "2/30", "13/1", "0/5", "2026-6-5.", "2026/02/31", "0000-01-01", "이번목요일", "다음 주 화요일", " Tomorrow ", "", " ", "someday", None]
)


def clamp(year, month, day):
    return dt.date(year, month, min(day, calendar.monthrange(year, month)[1]))


def add_months(d, n):
    months = d.year * 12 + d.month - 1 + n
    return clamp(months // 12, months % 12 + 1, d.day) if months // 12 <= 9999 else None


def resolve(d, token):
    if token is None or not token.strip():
        return None
    t = token.strip()
    t = fixed.DATE_ALIASES.get(t.lower(), t).replace(" ", "")
    t = re.sub("(이번|다음|다다음)주?([월화수목금토일])요일", r"\1주\2", t)
    if t in fixed.DAY_WORDS:
        return d + dt.timedelta(fixed.DAY_WORDS[t])
    if m := re.fullmatch(r"(\d+)(일|주|개월|년)후", t):
        n, unit = int(m[1]), m[2]
        return d + dt.timedelta(n * (7 if unit == "주" else 1)) if unit in "일주" else add_months(d, n * (12 if unit == "년" else 1))
    if t in ("다음주", "다다음주"):
        return d + dt.timedelta(7 * fixed.WEEK_WORDS[t])
    if m := re.fullmatch("(이번주|다음주|다다음주)([월화수목금토일])", t):
        return d + dt.timedelta(7 * fixed.WEEK_WORDS[m[1]] + fixed.WEEKDAYS.index(m[2]) - d.weekday())
    if m := re.fullmatch("([월화수목금토일])요일", t):
        return d + dt.timedelta((fixed.WEEKDAYS.index(m[1]) - d.weekday()) % 7)
    if t in fixed.WEEKEND_WORDS:
        return d + dt.timedelta((5 - d.weekday()) % 7 + fixed.WEEKEND_WORDS[t])
    if m := re.fullmatch(r"(\d{1,2})일", t):
        if int(m[1]) == 0:
            return None
        here = clamp(d.year, d.month, int(m[1]))
        follow = add_months(d.replace(day=1), 1)
        return here if here >= d else clamp(follow.year, follow.month, int(m[1]))
    if m := re.fullmatch(r"(\d{1,2})[월/.](\d{1,2})일?", t):
        mo, da = int(m[1]), int(m[2])
        if not (1 <= mo <= 12 and 1 <= da <= 31):
            return None
        return clamp(d.year, mo, da) if clamp(d.year, mo, da) >= d else clamp(d.year + 1, mo, da)
    if m := re.fullmatch(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\.?", t):
        y, mo, da = map(int, m.groups())
        return clamp(y, mo, da) if y and 1 <= mo <= 12 and 1 <= da <= 31 else None
    return None


def test_resolve_date(spark):
    df = spark.createDataFrame([(d, t) for d in DAYS for t in TOKENS], "d date, t string")
    for r in df.select("d", "t", tokens.resolve_date(F.col("d"), F.col("t")).alias("got")).collect():
        assert r.got == resolve(r.d, r.t), (r.d, r.t)


@pytest.mark.parametrize(
    "at, date, time, start",
    [
        ("2026-06-15T10:00:00+09:00", "내일", (3, 0, "오후"), "2026-06-16T15:00:00+09:00"),
        ("2026-06-15T10:00:00+09:00", "다음주화", None, "2026-06-23"),
        ("2026-06-21T09:00:00+09:00", "이번주말", None, "2026-06-27"),
        ("2026-01-31T09:00:00+09:00", "1개월후", None, "2026-02-28"),
        ("2026-06-15T10:00:00+09:00", "12일", (10, 0, None), "2026-07-12T10:00:00+09:00"),
        ("2026-06-15T10:30:00+09:00", None, (10, 0, None), "2026-06-15T22:00:00+09:00"),
        ("2026-06-15T10:00:00+09:00", "someday", (9, 0, "오전"), None),
        ("2026-06-15T23:59:00+09:00", " ", (12, 0, None), "2026-06-15T12:00:00+09:00"),
        ("unreadable", "내일", None, None),
    ],
)
def test_resolve_when(spark, at, date, time, start):
    kind = "struct<hour:int,minute:int,marker:string>"
    df = spark.createDataFrame([(at, date, time, None)], f"a string, d string, t {kind}, e {kind}")
    got = df.select(tokens.resolve_when(F.col("a"), F.col("d"), F.col("t"), F.col("e")).alias("w")).first().w
    assert (got.start, got.all_day) == (start, time is None)


def test_every_hour_and_marker(spark):
    def want(h, marker, minutes):
        if marker in fixed.AFTERNOON_MARKERS:
            h = h + 12 if h < 12 else h
        elif marker in fixed.MORNING_MARKERS:
            h = 0 if h == 12 else h
        elif marker in (fixed.NOON, fixed.MIDNIGHT):
            return "12:00" if marker == fixed.NOON else "00:00"
        elif marker is None and 1 <= h <= 12:
            h = h % 12 if h % 12 * 60 >= minutes else h % 12 + 12
        return f"{h:02d}:05"

    rows = [(h, m, minutes) for h in range(26) for m in (*fixed.MARKERS, None, "??") for minutes in (0, 690, 720, 1439)]
    df = spark.createDataFrame(rows, "h int, m string, at int").withColumn("t", tokens.time_struct(F.col("h"), F.lit(5), F.col("m")))
    for r in df.select("h", "m", "at", tokens.resolve_time(F.col("t"), F.col("at")).alias("got")).collect():
        assert r.got == want(r.h, r.m, r.at), r


def test_relativize(spark):
    rows = [("2026-06-15", "2026-06-16", "내일 봐요", "내일", "message-match"), ("2026-06-15", "2026-06-18", "봐요", "글피", "canonical"), ("2026-06-15", "2026-05-01", "봐요", "2026-05-01", "absolute-kept"), ("2026-06-15", "내일", "", "내일", "passthrough"), ("2026-06-15", None, "", None, "passthrough"), ("2026-06-15", "2026-06-23", "다음 주 화요일, 다음주화", "다음주화", "message-match")]
    df = spark.createDataFrame(rows, "r string, d string, m string, value string, method string")
    for r in df.select("value", "method", tokens.relativize_date(F.col("r").cast("date"), F.col("d"), F.col("m")).alias("got")).collect():
        assert (r.got.value, r.got.method) == (r.value, r.method)


def candidates(received, target):
    offset, letter = (target - received).days, fixed.WEEKDAYS[target.weekday()]
    found = [{0: "오늘", 1: "내일", 2: "모레", 3: "글피"}.get(offset), f"{target.day}일", *(w + letter for w in ("이번주", "다음주", "다다음주")), "이번주말", "다음주말"]
    found += [f"{offset // 7}주후"] if offset >= 7 and offset % 7 == 0 else []
    found += [f"{m}개월후" for m in (round(offset / 30.0) + k for k in (-1, 0, 1)) if m >= 1] if offset >= 28 else []
    found += [f"{y}년후" for y in (round(offset / 365.0) + k for k in (0, 1)) if y >= 1] if offset >= 365 else []
    return [c for c in [*found, f"{offset}일후" if offset >= 1 else None] if c]


def test_all_dates_as_tokens(spark, sf_dir):
    got = {r.event_id: r for r in QUERIES["d6_relativize"](spark, sf_dir).collect()}
    rows = messages(spark, sf_dir).collect()
    assert set(got) == {r.event_id for r in rows}
    used = set()
    for r in rows:
        target = resolve(r.recv, r.date)
        fits = [c for c in candidates(r.recv, target) if resolve(r.recv, c) == target] if target else []
        said = [c for c in fits if c in (r.body or "").replace(" ", "")]
        want = (None, "passthrough") if target is None else (said[0], "message-match") if said else (fits[0], "canonical") if fits else (str(target), "absolute-kept")
        assert (got[r.event_id].token, got[r.event_id].method) == want, r
        used.add(re.sub(r"\d+", "", want[0] or ""))
    assert {"주후", "개월후", "년후"} & used and {"다음주화"} & used


def test_calendar_rows_of_every_hour(spark, sf_dir):
    got = {r.event_id: r.start_millis for r in QUERIES["d11_calendar_row"](spark, sf_dir).collect()}
    rows = messages(spark, sf_dir).collect()
    assert set(got) == {r.event_id for r in rows}
    late = [r for r in rows if r.has_time and r.hour == 24]
    for r in late:
        hour = {fixed.NOON: 12, fixed.MIDNIGHT: 0}.get(r.marker)
        day = resolve(r.recv, r.date) if r.date is not None else r.recv
        # 24:00 is no clock time, except where a marker names noon or midnight
        want = None if day is None or hour is None else int(dt.datetime(day.year, day.month, day.day, hour, tzinfo=dt.timezone(dt.timedelta(hours=9))).timestamp() * 1000)
        assert got[r.event_id] == want, r
    assert any(got[r.event_id] is not None for r in late)
