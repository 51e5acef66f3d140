"""DuckDB texts of the token rules, for the queries' SQL."""

from __future__ import annotations

from msgloom.functions import fixed

LETTERS = f"[{fixed.WEEKDAYS}]"


def clean(token: str) -> str:
    text = f"regexp_replace({token}, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')"
    named = f"CASE lower({text}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.DATE_ALIASES.items()) + f" ELSE {text} END"
    return f"regexp_replace(replace({named}, ' ', ''), '(이번|다음|다다음)주?({LETTERS})요일', '\\1주\\2', 'g')"


def num(text: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST(regexp_extract({text}, '{pattern}', {group}) AS INT)"


def index(letter: str) -> str:
    return f"CASE WHEN length({letter}) = 1 THEN strpos('{fixed.WEEKDAYS}', {letter}) - 1 END"


def in_month(first: str, day: str) -> str:
    return f"({first} + CAST(least({day}, day(last_day({first}))) - 1 AS INT))"


def resolve_date(recv: str, t: str) -> str:
    """The date of a cleaned token ``t`` (a column) for a received date (a column)."""
    wd = f"CAST(isodow({recv}) - 1 AS INT)"
    first = f"CAST(date_trunc('month', {recv}) AS DATE)"
    jan = f"CAST(date_trunc('year', {recv}) AS DATE)"
    months = lambda d, n: f"CAST({d} + to_months(CAST({n} AS INT)) AS DATE)"
    week = f"regexp_extract({t}, '^(이번주|다음주|다다음주)({LETTERS})$', 1)"
    week_day = index(f"regexp_extract({t}, '^(이번주|다음주|다다음주)({LETTERS})$', 2)")
    bare = index(f"regexp_extract({t}, '^({LETTERS})요일$', 1)")
    day = num(t, "^([0-9]{1,2})일$")
    md = "^([0-9]{1,2})[월/.]([0-9]{1,2})일?$"
    m, d = num(t, md, 1), num(t, md, 2)
    full = "^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})[.]?$"
    y, fm, fd = (num(t, full, k) for k in (1, 2, 3))
    ok_md = f"{m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31"
    this_day, next_day = in_month(first, day), in_month(months(first, 1), day)
    this_year, next_year = in_month(months(jan, f"{m} - 1"), d), in_month(months(jan, f"{m} + 11"), d)
    words = " ".join(f"WHEN {t} = '{w}' THEN {recv} + {n}" for w, n in fixed.DAY_WORDS.items())
    saturday = f"{recv} + CAST((5 - {wd} + 7) % 7 AS INT)"
    return f"""CASE {words}
      WHEN {num(t, '^([0-9]{1,5})일후$')} IS NOT NULL THEN {recv} + {num(t, '^([0-9]{1,5})일후$')}
      WHEN {num(t, '^([0-9]{1,5})주후$')} IS NOT NULL THEN {recv} + 7 * {num(t, '^([0-9]{1,5})주후$')}
      WHEN {num(t, '^([0-9]{1,5})개월후$')} IS NOT NULL THEN {months(recv, num(t, '^([0-9]{1,5})개월후$'))}
      WHEN {num(t, '^([0-9]{1,5})년후$')} IS NOT NULL THEN {months(recv, '12 * ' + num(t, '^([0-9]{1,5})년후$'))}
      WHEN {t} = '다음주' THEN {recv} + 7 WHEN {t} = '다다음주' THEN {recv} + 14
      WHEN {week} <> '' THEN {recv} - {wd} + CAST(7 * CASE {week} WHEN '이번주' THEN 0 WHEN '다음주' THEN 1 ELSE 2 END + {week_day} AS INT)
      WHEN {bare} IS NOT NULL THEN {recv} + CAST(({bare} - {wd} + 7) % 7 AS INT)
      WHEN {t} = '이번주말' THEN {saturday} WHEN {t} = '다음주말' THEN {saturday} + 7
      WHEN {day} >= 1 THEN CASE WHEN {this_day} < {recv} THEN {next_day} ELSE {this_day} END
      WHEN {ok_md} THEN CASE WHEN {this_year} < {recv} THEN {next_year} ELSE {this_year} END
      WHEN {y} >= 1 AND {fm} BETWEEN 1 AND 12 AND {fd} BETWEEN 1 AND 31 THEN {in_month(f"make_date({y}, {fm}, 1)", fd)}
    END"""


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def resolve_time(h: str, m: str, marker: str, minutes: str) -> str:
    hour = f"""CASE WHEN {marker} IN ({quoted(fixed.AFTERNOON_MARKERS)}) THEN CASE WHEN {h} < 12 THEN {h} + 12 ELSE {h} END
      WHEN {marker} IN ({quoted(fixed.MORNING_MARKERS)}) THEN CASE WHEN {h} = 12 THEN 0 ELSE {h} END
      WHEN {marker} = '{fixed.NOON}' THEN 12 WHEN {marker} = '{fixed.MIDNIGHT}' THEN 0
      WHEN {marker} IS NULL AND {h} BETWEEN 1 AND 12 THEN CASE WHEN ({h} % 12) * 60 >= {minutes} THEN {h} % 12 ELSE {h} % 12 + 12 END
      ELSE {h} END"""
    minute = f"CASE WHEN {marker} IN ('{fixed.NOON}', '{fixed.MIDNIGHT}') THEN 0 ELSE {m} END"
    return f"printf('%02d:%02d', CAST({hour} AS INT), CAST({minute} AS INT))"


def has_cue(text: str) -> str:
    return f"coalesce(regexp_matches({text}, '(?i){fixed.CUES}'), false)"


def is_completed(text: str) -> str:
    return f"coalesce(regexp_matches({text}, '{fixed.COMPLETED}'), false)"


def is_payment(text: str, recv: str) -> str:
    part = lambda k: num(text, fixed.PAYMENT_TIME, k)
    return f"""coalesce(regexp_matches({text}, '{fixed.PAYMENT}') AND CASE WHEN {part(1)} IS NOT NULL
      THEN {part(1)} = year({recv}) AND {part(2)} = month({recv}) AND {part(3)} = day({recv})
      ELSE {part(4)} = month({recv}) AND {part(5)} = day({recv}) END, false)"""
