"""Date and time tokens as Column expressions.

A token is the surface form that a message uses ("tomorrow", "next Tuesday", a day of the
month); resolving it against the received date is arithmetic on dates, so each function is
a plain expression that runs in generated code and inside a lambda. All of them return null
where a token cannot be resolved; none raises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgloom.functions import fixed


def number(text: Column, pattern: str, group: int = 1) -> Column:
    """The group as an int; null where the pattern doesn't match."""
    # a cast that fails costs far more than one of null
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int")


def let(build, **values: Column) -> Column:
    """``build`` over values that are computed once, however often it names them."""
    bound = F.array(F.struct(*(value.alias(name) for name, value in values.items())))
    return F.element_at(F.transform(bound, lambda row: build(*(row[name] for name in values))), 1)


def pick(value: Column, table: dict, default: Column | None = None) -> Column:
    chain = reduce(lambda w, kv: w.when(value == kv[0], F.lit(kv[1])), table.items(), F)
    return chain.otherwise(default) if default is not None else chain


def weekday_index(letter: Column) -> Column:
    """0 for Monday to 6 for Sunday; null for anything else."""
    at = F.instr(F.lit(fixed.WEEKDAYS), letter)
    return F.when((F.length(letter) == 1) & (at > 0), at - 1)


def day_in_month(first: Column, day: Column) -> Column:
    """The day of the month that starts at ``first``; days past its end are its last."""
    return F.date_add(first, F.least(day, F.dayofmonth(F.last_day(first))) - 1)


def clean_token(token: Column) -> Column:
    text = F.regexp_replace(token, r"^\s+|\s+$", "")
    named = pick(F.lower(text), fixed.DATE_ALIASES, text)
    packed = F.replace(named, F.lit(" "), F.lit(""))
    return F.regexp_replace(packed, f"(이번|다음|다다음)주?([{fixed.WEEKDAYS}])요일", "$1주$2")


def resolve_date(received: Column, token: Column) -> Column:
    """The date a token means for a message received on the date ``received``."""
    return let(_resolve_date, received=received, t=clean_token(token))


def _resolve_date(received: Column, t: Column) -> Column:
    letters = f"[{fixed.WEEKDAYS}]"
    since_monday = F.weekday(received)
    monday = F.date_sub(received, since_monday)

    week = F.regexp_extract(t, f"^(이번주|다음주|다다음주)({letters})$", 1)
    week_day = weekday_index(F.regexp_extract(t, f"^(이번주|다음주|다다음주)({letters})$", 2))
    bare_day = weekday_index(F.regexp_extract(t, f"^({letters})요일$", 1))
    saturday = F.date_add(received, F.pmod(F.lit(5) - since_monday, F.lit(7)))

    month_first = F.trunc(received, "month").cast("date")
    day = number(t, r"^(\d{1,2})일$")
    this_month = F.when(day >= 1, day_in_month(month_first, day))
    next_month = day_in_month(F.add_months(month_first, 1), day)

    month_day = r"^(\d{1,2})[월/.](\d{1,2})일?$"
    m, d = number(t, month_day, 1), number(t, month_day, 2)
    year_first = F.trunc(received, "year").cast("date")
    this_year = F.when(m.between(1, 12) & d.between(1, 31), day_in_month(F.add_months(year_first, m - 1), d))
    next_year = day_in_month(F.add_months(year_first, m + 11), d)

    full = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\.?$"
    y, fm, fd = (number(t, full, k) for k in (1, 2, 3))
    january = F.make_date(y, F.lit(1), F.lit(1))
    absolute = F.when((y >= 1) & fm.between(1, 12) & fd.between(1, 31), day_in_month(F.add_months(january, fm - 1), fd))

    found = F.coalesce(
        F.date_add(received, pick(t, fixed.DAY_WORDS)),
        F.date_add(received, number(t, r"^(\d{1,5})일후$")),
        F.date_add(received, 7 * number(t, r"^(\d{1,5})주후$")),
        F.add_months(received, number(t, r"^(\d{1,5})개월후$")),
        F.add_months(received, 12 * number(t, r"^(\d{1,5})년후$")),
        F.date_add(received, pick(t, {"다음주": 7, "다다음주": 14})),
        F.date_add(monday, 7 * pick(week, fixed.WEEK_WORDS) + week_day),
        F.date_add(received, F.pmod(bare_day - since_monday, F.lit(7))),
        F.date_add(saturday, pick(t, fixed.WEEKEND_WORDS)),
        F.when(this_month < received, next_month).otherwise(this_month),
        F.when(this_year < received, next_year).otherwise(this_year),
        absolute,
    )
    return let(lambda day: F.when(F.year(day).between(1, 9999), day), day=found)


def two_digits(value: Column) -> Column:
    return F.when(value.between(0, 9), F.concat(F.lit("0"), value.cast("string"))).otherwise(value.cast("string"))


def resolve_time(time: Column, received_minutes: Column) -> Column:
    """``HH:MM`` of a time struct for a message received at this minute of the day.

    A bare hour of 1 to 12 is the next such time, or the afternoon one if both have passed.
    Hours over 23 are not checked. A null struct gives null.
    """
    return let(_resolve_time, time=time, received_minutes=received_minutes)


def _resolve_time(time: Column, received_minutes: Column) -> Column:
    h, m, marker = F.coalesce(time["hour"], F.lit(0)), F.coalesce(time["minute"], F.lit(0)), time["marker"]
    morning, evening = h % 12, h % 12 + 12
    bare = F.when(morning * 60 >= received_minutes, morning).otherwise(evening)
    hour = (
        F.when(marker.isin(*fixed.AFTERNOON_MARKERS), F.when(h < 12, h + 12).otherwise(h))
        .when(marker.isin(*fixed.MORNING_MARKERS), F.when(h == 12, 0).otherwise(h))
        .when(marker == fixed.NOON, 12)
        .when(marker == fixed.MIDNIGHT, 0)
        .when(marker.isNull() & h.between(1, 12), bare)
        .otherwise(h)
    )
    minute = F.when(marker.isin(fixed.NOON, fixed.MIDNIGHT), 0).otherwise(m)
    return F.when(time.isNotNull(), F.concat_ws(":", two_digits(hour), two_digits(minute)))


def received_date(received_at: Column) -> Column:
    """The local date in the text; the text is never read as an instant."""
    return F.try_to_date(F.substring(received_at, 1, 10), "yyyy-MM-dd")


def received_minutes(received_at: Column) -> Column:
    clock = r"^\d{4}-\d{2}-\d{2}[T ](\d{2}):(\d{2})"
    return F.coalesce(number(received_at, clock, 1) * 60 + number(received_at, clock, 2), F.lit(0))


def resolve_when(received_at: Column, date: Column, time: Column, end_time: Column, zone: str = fixed.DEFAULT_ZONE) -> Column:
    """D3: struct of start, end and all_day.

    Without a time the start is a date; without a date token the time falls on the received
    day; an unknown token or an unreadable received_at gives a null start.
    """

    def build(received: Column, minutes: Column, date: Column, time: Column, end_time: Column) -> Column:
        blank = date.isNull() | (F.regexp_replace(date, r"\s", "") == "")
        day = F.coalesce(resolve_date(received, date), F.when(blank & time.isNotNull(), received))
        return let(lambda text, minutes, time, end_time: _when(text, minutes, time, end_time, zone), text=day.cast("string"), minutes=minutes, time=time, end_time=end_time)

    return let(build, received=received_date(received_at), minutes=received_minutes(received_at), date=date, time=time, end_time=end_time)


def _when(text: Column, minutes: Column, time: Column, end_time: Column, zone: str) -> Column:
    def at(clock: Column) -> Column:
        return F.concat(text, F.lit("T"), resolve_time(clock, minutes), F.lit(f":00{zone}"))

    return F.struct(
        F.when(time.isNull(), text).otherwise(at(time)).alias("start"),
        F.when(time.isNotNull() & end_time.isNotNull(), at(end_time)).alias("end"),
        time.isNull().alias("all_day"),
    )


def with_weekday(received_at: Column) -> Column:
    """The text with its weekday in brackets; text without a date stays as it is."""
    day = received_date(received_at)
    letter = F.substring(F.lit(fixed.WEEKDAYS), 1, 7)
    shown = F.concat(received_at, F.lit(" ("), F.substr(letter, F.weekday(day) + 1, F.lit(1)), F.lit(")"))
    return F.coalesce(F.when(day.isNotNull(), shown), received_at)


def date_candidates(received: Column, target: Column) -> Column:
    """Tokens that may mean ``target``, most natural first; not yet verified."""
    return let(_candidates, received=received, target=target)


def _candidates(received: Column, target: Column) -> Column:
    offset = F.datediff(target, received)
    letter = F.substr(F.lit(fixed.WEEKDAYS), F.weekday(target) + 1, F.lit(1))
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    months = F.round(offset / 30.0).cast("int")
    years = F.round(offset / 365.0).cast("int")
    in_months = [F.when((offset >= 28) & (months + k >= 1), text(months + k, "개월후")) for k in (-1, 0, 1)]
    in_years = [F.when((offset >= 365) & (years + k >= 1), text(years + k, "년후")) for k in (0, 1)]
    return F.array_distinct(
        F.array_compact(
            F.array(
                pick(offset, {n: w for w, n in fixed.DAY_WORDS.items()}),
                text(F.dayofmonth(target), "일"),
                *(F.concat(F.lit(w), letter) for w in fixed.WEEK_WORDS),
                *(F.lit(w) for w in fixed.WEEKEND_WORDS),
                F.when((offset >= 7) & (offset % 7 == 0), text((offset / 7).cast("int"), "주후")),
                *in_months,
                *in_years,
                F.when(offset >= 1, text(offset, "일후")),
            )
        )
    )


def relativize_date(received: Column, date: Column, message: Column) -> Column:
    """Struct of value and method: the token for an absolute date, as the message writes it if it does."""
    target = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(date, "yyyy-MM-dd"))

    def verify(received: Column, target: Column, date: Column, message: Column) -> Column:
        fits = F.filter(date_candidates(received, target), lambda c: F.coalesce(resolve_date(received, c) == target, F.lit(False)))
        return let(choose, fits=fits, target=target, date=date, said=F.replace(F.coalesce(message, F.lit("")), F.lit(" "), F.lit("")))

    def choose(fits: Column, target: Column, date: Column, said: Column) -> Column:
        in_message = F.filter(fits, lambda c: F.contains(said, F.replace(c, F.lit(" "), F.lit(""))))
        value = F.coalesce(F.try_element_at(in_message, F.lit(1)), F.try_element_at(fits, F.lit(1)), date)
        method = F.when(target.isNull(), "passthrough").when(F.size(in_message) > 0, "message-match").when(F.size(fits) > 0, "canonical").otherwise("absolute-kept")
        return F.struct(F.when(target.isNull(), date).otherwise(value).alias("value"), method.alias("method"))

    return let(verify, received=received, target=target, date=date, message=message)


def first_match(text: Column, pattern: str, build) -> Column:
    """``build(group)`` where the pattern is found, else null."""
    return F.when(text.rlike(pattern), build(lambda k: F.regexp_extract(text, pattern, k)))


def plain_number(text: Column) -> Column:
    return text.try_cast("int").cast("string")


def parse_date(message: Column) -> Column:
    """The date token that a free text holds; the first rule that hits wins."""
    words = [F.when(F.contains(message, F.lit(w)), F.lit(w)) for w in fixed.DAY_WORDS]
    letters = f"[{fixed.WEEKDAYS}]"
    return F.coalesce(
        *words,
        first_match(message, r"((?:이번|다음)주말|(?:이번|다음)\s주말)", lambda g: F.replace(g(1), F.lit(" "), F.lit(""))),
        first_match(message, rf"(이번주|다음주|다다음주)\s?({letters})요일?", lambda g: F.concat(g(1), g(2))),
        first_match(message, r"(\d+)\s?일\s?후", lambda g: F.concat(g(1), F.lit("일후"))),
        first_match(message, r"(\d+)\s?주\s?후", lambda g: F.concat(g(1), F.lit("주후"))),
        first_match(message, r"(\d+)\s?개월\s?후", lambda g: F.concat(g(1), F.lit("개월후"))),
        first_match(message, r"(\d{1,2})\s?월\s?(\d{1,2})\s?일", lambda g: F.concat(plain_number(g(1)), F.lit("월"), plain_number(g(2)), F.lit("일"))),
        first_match(message, r"(?<!\d)(\d{1,2})/(\d{1,2})(?!\d)", lambda g: F.concat(plain_number(g(1)), F.lit("/"), plain_number(g(2)))),
        first_match(message, rf"({letters})요일", lambda g: F.concat(g(1), F.lit("요일"))),
        first_match(message, r"(?<!\d)(\d{1,2})\s?일(?!후|간|짜|째)", lambda g: F.concat(plain_number(g(1)), F.lit("일"))),
    )


def parse_time(message: Column) -> Column:
    """The clock time that a free text holds, with the first marker word of the list; null without one."""
    marker = F.coalesce(*(F.when(F.contains(message, F.lit(w)), F.lit(w)) for w in fixed.TEXT_MARKERS))
    hours = r"(\d{1,2})\s?시\s?(\d{1,2})?\s?(분|반)?"
    clock = r"(\d{1,2}):(\d{2})"
    spoken = message.rlike(hours)
    hour = F.when(spoken, number(message, hours, 1)).otherwise(number(message, clock, 1))
    minute = F.when(spoken, F.when(F.regexp_extract(message, hours, 3) == "반", 30).otherwise(F.coalesce(number(message, hours, 2), F.lit(0)))).otherwise(number(message, clock, 2))
    return F.when(hour.isNotNull(), time_struct(hour, minute, marker))


def time_struct(hour: Column, minute: Column, marker: Column) -> Column:
    return F.struct(hour.cast("int").alias("hour"), minute.cast("int").alias("minute"), marker.alias("marker"))


def derive_time(hour: Column, minute: Column) -> Column:
    """A 24-hour time as a token: midnight and noon by name, mornings marked, later hours bare."""
    marker = F.when(hour == 0, fixed.MIDNIGHT).when(hour < 12, "오전").when(hour == 12, fixed.NOON)
    return time_struct(F.when(hour == 0, 12).otherwise(hour), minute, marker)


def edited_time(hour: Column, minute: Column) -> Column:
    """D9, the edit form's way: twelve hours, always marked."""
    return time_struct(F.when(hour % 12 == 0, 12).otherwise(hour % 12), minute, F.when(hour < 12, "오전").otherwise("오후"))
