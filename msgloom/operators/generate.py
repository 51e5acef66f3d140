"""Synthetic rows with labels that are right by construction.

Each made row follows from a row of a table (``i``, received_at, channel, sender): when it
was received, where and from whom are that row's, and every draw is a hash of ``i`` and a
seed, so rows are the same on every run and in any number of partitions. ``numbered`` gives
such rows where there is no table. ``label_errors`` must be empty for each generator.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.functions import fixed
from msgloom.functions.text import is_personal_name, plain_sender
from msgloom.functions.tokens import number, received_date, resolve_date, time_struct, two_digits

CHANNELS = ("sms", "kakaotalk", "gmail")
ACTIVITIES = ("회의", "점심 약속", "병원 예약", "스터디", "저녁 식사", "면접")
PEOPLE = ("김민수", "이지은", "박서준", "최유리")
NEGATIVES = (
    ("question", 45, ("언제 시간 괜찮으세요?", "이번 달에 한번 볼까요?")),
    ("cancel", 30, ("내일 모임은 취소되었습니다.", "회의 취소됐어요.")),
    ("past", 15, ("어제 회의 잘 마쳤습니다.", "지난주 모임 사진 보내드려요.")),
    ("vague", 10, ("조만간 한번 보자.", "나중에 밥 먹어요.")),
)


def draw(n: int, salt: str, seed: int, row: Column | None = None) -> Column:
    """0 to n - 1, by a hash that other engines have too."""
    row = F.col("i") if row is None else row
    digits = F.substring(F.md5(F.concat_ws("|", row.cast("string"), F.lit(salt), F.lit(str(seed))).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % n).cast("int")


def one_of(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), place + 1)


def particle(word: Column) -> Column:
    """와 or 과, by whether the word's last Hangul syllable has a final consonant."""
    last = F.substr(word, F.length(word), F.lit(1))
    code = F.conv(F.hex(F.encode(last, "UTF-16BE")), 16, 10).cast("int")
    return F.when(last.between("가", "힣") & ((code - 0xAC00) % 28 != 0), "과").otherwise("와")


def received(seed: int, first_day: str, days: int) -> Column:
    day = F.date_add(F.lit(first_day).cast("date"), draw(days, "day", seed))
    return F.concat(day.cast("string"), F.lit("T"), two_digits(8 + draw(12, "hour", seed)), F.lit(":"), two_digits(draw(60, "minute", seed)), F.lit(f":00{fixed.DEFAULT_ZONE}"))


def numbered(spark: SparkSession, n: int, seed: int = 0, first_day: str = "2026-01-05") -> DataFrame:
    """``n`` rows to generate from, with drawn times, channels and senders."""
    return spark.range(n).select(F.col("id").alias("i")).select("i", received(seed, first_day, 364).alias("received_at"), one_of(CHANNELS, draw(3, "channel", seed)).alias("channel"), one_of(PEOPLE, draw(4, "sender", seed)).alias("sender"))


def counterpart(seed: int) -> Column:
    """The sender if that is a person, else a drawn name."""
    return F.when(is_personal_name(F.col("sender")), plain_sender(F.col("sender"))).otherwise(one_of(PEOPLE, draw(4, "who", seed)))


def text(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def scenario(kind: str) -> Column:
    return text(f"{kind}_", F.col("i").cast("string")).alias("scenario_id")


def weekend_samples(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Relative dates that cross a weekend: word, offset, message, date token, crosses_weekend."""
    base = rows.select("i", "channel", "received_at", one_of(tuple(fixed.DAY_WORDS), draw(4, "word", seed)).alias("date"), one_of(ACTIVITIES, draw(6, "what", seed)).alias("title"), (9 + draw(10, "at", seed)).alias("hour"))
    day = received_date(F.col("received_at"))
    base = base.withColumn("intended", resolve_date(day, F.col("date")))
    target = F.col("intended")
    return base.select(
        scenario("weekend"), "channel", "received_at",
        text(F.col("date"), " ", F.col("hour").cast("string"), "시 ", F.col("title")).alias("message"),
        F.lit(True).alias("is_schedule"), "title", "date",
        time_struct(F.col("hour"), F.lit(0), F.lit(None).cast("string")).alias("time"),
        "intended",
        ((F.weekday(day) < 5) & (F.weekday(target) >= 5) | (F.weekday(target) < F.weekday(day))).alias("crosses_weekend"),
    )


def negative_samples(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Negatives of four kinds in the shares of NEGATIVES."""
    base = rows.select("i", "channel", "received_at", draw(100, "kind", seed).alias("roll"))
    bounds = [sum(w for _, w, _ in NEGATIVES[: k + 1]) for k in range(len(NEGATIVES))]
    chain = lambda values: reduce(lambda w, row: w.when(F.col("roll") < row[0], row[1]), zip(bounds, values, strict=True), F)
    return base.select(
        scenario("negative"), "channel", "received_at",
        chain([F.lit(k) for k, _, _ in NEGATIVES]).alias("kind"),
        chain([one_of(texts, draw(len(texts), "text", seed)) for _, _, texts in NEGATIVES]).alias("message"),
        F.lit(False).alias("is_schedule"),
    )


SHAPES = ("simple", "time change", "place change", "date change", "build-up", "unconfirmed")
NEAR_DATES = ("내일", "모레", "글피")
LATER_DATES = ("다음주월", "다음주수", "다음주금")
MEETING_PLACES = ("강남역", "시청", "회사")
OTHER_PLACE = "종로"


def thread_samples(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Threads that agree on an event in five shapes, or do not (``shape`` unconfirmed); the last agreed value is gold."""
    rows = rows.select(
        "i", "received_at", one_of(SHAPES, draw(6, "shape", seed)).alias("shape"), counterpart(seed).alias("who"), one_of(ACTIVITIES, draw(6, "what", seed)).alias("title"),
        one_of(NEAR_DATES, draw(3, "date", seed)).alias("first_date"), one_of(LATER_DATES, draw(3, "new date", seed)).alias("new_date"), (9 + draw(4, "hour", seed)).alias("hour"), one_of(MEETING_PLACES, draw(3, "place", seed)).alias("place"),
    )
    shape = F.col("shape")
    new_hour = F.col("hour") + 2
    date = F.when(shape == "date change", F.col("new_date")).otherwise(F.col("first_date"))
    hour = F.when(shape == "time change", new_hour).otherwise(F.col("hour"))
    place = F.when(shape == "place change", OTHER_PLACE).otherwise(F.col("place"))
    turn = lambda who, said: F.struct(F.lit(None).cast("string").alias("time"), who.alias("sender"), said.alias("message"))
    ask = turn(F.col("who"), text(F.col("first_date"), " ", F.col("hour").cast("string"), "시 ", F.col("place"), "에서 ", F.col("title"), " 어때요?"))
    change = (
        F.when(shape == "time change", text(new_hour.cast("string"), "시로 바꿀까요?"))
        .when(shape == "place change", text(OTHER_PLACE, "에서 볼까요?"))
        .when(shape == "date change", text(F.col("new_date"), "로 미룰까요?"))
        .when(shape == "build-up", text("좋아요, 자료도 가져갈게요."))
    )
    turns = F.when(change.isNotNull(), F.array(ask, turn(F.lit("나"), change))).otherwise(F.array(ask))
    yes = shape != "unconfirmed"
    return rows.select(
        scenario("thread"), F.lit("kakaotalk").alias("channel"), "received_at", shape, turns.alias("thread_context"),
        F.when(yes, "네 좋아요, 그렇게 해요.").otherwise("확인하고 다시 연락드릴게요.").alias("message"),
        yes.alias("is_schedule"),
        F.when(yes, text(F.col("who"), particle(F.col("who")), " ", F.col("title"))).alias("title"),
        F.when(yes, date).alias("date"), F.when(yes, time_struct(hour, F.lit(0), F.lit(None).cast("string"))).alias("time"), F.when(yes, place).alias("location"),
        F.when(yes, resolve_date(received_date(F.col("received_at")), date)).alias("intended"),
    )


def week_token(received: Column, weekday: Column) -> Column:
    """The token of the coming such weekday: this week's if it is still ahead or today, else next week's."""
    letter = F.substr(F.lit(fixed.WEEKDAYS), weekday + 1, F.lit(1))
    return F.concat(F.when(weekday >= F.weekday(received), "이번주").otherwise("다음주"), letter)


def plus_minutes(clock: Column, minutes: Column) -> Column:
    """HH:MM plus minutes, round the clock."""
    total = F.pmod(number(clock, r"^(\d{1,2}):") * 60 + number(clock, r":(\d{2})$") + minutes, F.lit(1440))
    return F.concat(two_digits(F.floor(total / 60).cast("int")), F.lit(":"), two_digits((total % 60).cast("int")))


def confirm_samples(rows: DataFrame, seed: int = 0) -> DataFrame:
    """The counterpart's confirmation of a weekday, half of them beside a date that is not meant."""
    rows = rows.select("i", "received_at", draw(7, "weekday", seed).alias("weekday"), draw(2, "other", seed).alias("other"), counterpart(seed).alias("who"), one_of(ACTIVITIES, draw(6, "what", seed)).alias("title"))
    day = received_date(F.col("received_at"))
    token = week_token(day, F.col("weekday"))
    clock = F.substring("received_at", 12, 5)
    letter = F.substr(F.lit(fixed.WEEKDAYS), F.col("weekday") + 1, F.lit(1))
    turn = lambda minutes, who, said: F.struct(plus_minutes(clock, F.lit(minutes)).alias("time"), who.alias("sender"), said.alias("message"))
    other = F.when(F.col("other") == 1, text(F.date_format(F.date_add(day, -20), "M/d"), " 회의록 잘 받았어요. ")).otherwise("")
    return rows.select(
        scenario("confirm"), F.lit("kakaotalk").alias("channel"), "received_at",
        F.array(turn(-20, F.lit("나"), text(letter, "요일에 ", F.col("title"), " 괜찮으세요?")), turn(-5, F.col("who"), F.lit("확인해 볼게요."))).alias("thread_context"),
        text(other, letter, "요일 좋아요!").alias("message"),
        F.lit(True).alias("is_schedule"), "title", token.alias("date"),
        F.date_add(day, F.pmod(F.col("weekday") - F.weekday(day), F.lit(7))).alias("intended"),
    )


def seed_records(seeds: DataFrame, prefix: str, channel: str, order: str = "row_ord") -> DataFrame:
    """Seed rows (row_ord, sender, message) as records whose id and received time follow from their place."""
    i = F.col(order)
    day = F.date_add(F.lit("2026-06-01").cast("date"), (i % 6).cast("int"))
    at = F.concat(day.cast("string"), F.lit("T"), two_digits((8 + i % 12).cast("int")), F.lit(":"), two_digits((i * 7 % 60).cast("int")), F.lit(f":00{fixed.DEFAULT_ZONE}"))
    return seeds.select(F.format_string("%s_%03d", F.lit(prefix), i).alias("scenario_id"), at.alias("received_at"), F.lit(channel).alias("channel"), "sender", "message", F.lit('{"is_schedule":false}').alias("gold"))


def label_errors(df: DataFrame) -> DataFrame:
    """Rows whose token does not resolve to the intended date; must be empty."""
    return df.where(F.col("is_schedule") & ~resolve_date(received_date(F.col("received_at")), F.col("date")).eqNullSafe(F.col("intended")))
