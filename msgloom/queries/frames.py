"""Domain frames made from the driver's tables, stated once as expressions that Spark and DuckDB share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Frame:
    """A table with columns added in steps; an expression is one text, or a pair (Spark, DuckDB)."""

    base: str
    steps: tuple[dict, ...]

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.base}.parquet")
        for step in self.steps:
            df = df.selectExpr("*", *(f"{e if isinstance(e, str) else e[0]} AS {name}" for name, e in step.items()))
        return df

    @property
    def sql(self) -> str:
        text = f"SELECT * FROM {self.base}"
        for step in self.steps:
            columns = ", ".join(f"{e if isinstance(e, str) else e[1]} AS {name}" for name, e in step.items())
            text = f"SELECT *, {columns} FROM ({text})"
        return text


def case(value: str, texts: list[str | None]) -> str:
    quote = lambda t: "NULL" if t is None else "'" + t.replace("'", "''") + "'"
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN {quote(t)}" for k, t in enumerate(texts)) + " END"


NTZ = "CAST(ts AS TIMESTAMP_NTZ)"
BODIES = [
    "내일 3시 회의", "안녕하세요", "결제가 완료되었어요", None, "참석 명단 1. 민수진 2. 영희 3. Tom Lee", "링크 https://zoom.us/j/1, 지도 https://naver.me/abc. 끝 https://x.y/z!",
    "Meeting at 5pm", "다음 주 화요일 점심", "2024.01.05 10:20 입금 확인", "12일 3/4 보자", "see you", "3주 후 모임", "주문이 발송되었습니다", "1. Anna 2) 이영 3. 회의 4. Anna", "a@b.co 010-1234-5678", "  ",
]
DATES = [
    "오늘", "내일", "모레", "글피", "3일후", "2주후", "1개월후", "1년후", "다음주", "다다음주", "이번주월", "다음주화", "다다음주일", "이번목요일", "금요일", "이번주말",
    "다음주말", "12일", "31일", "6월16일", "2/30", "2026-6-5.", "Tomorrow", None, "13/1", "0일", "someday", "5.29",
]
MARKS = ["오전", "오후", "저녁", "밤", "낮", "아침", "새벽", "정오", "자정", None]
SENDERS = ["김민수 한빛상사 영업", "010-1234-5678", "team@corp.com", "나", "[Web발신] 국민은행", "박서준"]
TITLES = ["주간 회의", "점심", None, "", " 면접 ", "박서준 면담", "기타 회의"]
PLACES = ["강남역", None, "줌", "주간 회의", "Zoom online", "", "박서"]

MESSAGES = Frame(
    "events",
    (
        {"k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)", "seq": "event_id"},
        {
            "received_at": (f"concat(date_format({NTZ}, \"yyyy-MM-dd'T'HH:mm:ss\"), '+09:00')", "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+09:00'"),
            "recv": (f"CAST({NTZ} AS DATE)", "CAST(ts AS DATE)"),
            "recv_minute": (f"hour({NTZ}) * 60 + minute({NTZ})", "CAST(hour(ts) * 60 + minute(ts) AS INT)"),
            "seconds": (f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {NTZ}) DIV 5000", "CAST(floor(floor(epoch(ts)) / 5000) AS BIGINT)"),
            "channel": case("user_id % 3", ["sms", "kakaotalk", "gmail"]),
            "room": "CASE WHEN user_id % 5 < 2 THEN concat('room', CAST(user_id % 7 AS STRING)) ELSE '' END",
            "sender": case("(event_id * 7 + k) % 6", SENDERS),
            "date": case("(event_id + k) % 28", DATES),
            "hour": "CAST((event_id * 5 + k) % 25 AS INT)",
            "minute": "CAST(k % 60 AS INT)",
            "marker": case("(event_id * 3 + k) % 10", MARKS),
            "title": case("(event_id + 2 * k) % 7", TITLES),
            "place": case("(event_id * 3 + 2 * k) % 7", PLACES),
            "is_schedule": "(k % 5) < 3",
        },
        {
            "body": (
                f"CASE WHEN k % 16 = 3 THEN concat(date_format(recv, 'MM/dd'), ' 12:30 승인 5,000원') ELSE {case('k % 16', BODIES)} END",
                f"CASE WHEN k % 16 = 3 THEN strftime(recv, '%m/%d') || ' 12:30 승인 5,000원' ELSE {case('k % 16', BODIES)} END",
            ),
            "conversation": "concat(channel, ':', CAST(user_id AS STRING))",
            "has_time": "(event_id % 4) > 0",
            "clock": "substring(received_at, 12, 5)",
        },
    ),
)

PAIRS = Frame(
    "documents",
    (
        {
            "message": "text",
            "channel": "CASE length(source) % 3 WHEN 0 THEN 'sms' WHEN 1 THEN 'kakaotalk' ELSE 'gmail' END",
            "language": "lang",
            "is_schedule": "(doc_id * 7 + n_chars) % 20 < 9",
        },
    ),
)

TURNS = Frame("conversations", ({"sender": "role", "message": "text"},))
MAIL = Frame("pages", ({"body": "html"},))
PLAN = Frame(
    "orders",
    (
        {
            "scenario_id": "concat('s', CAST(o_custkey % 97 AS STRING))",
            "produced_id": "concat('s', CAST(o_orderkey % 89 AS STRING))",
            "edge_case": case("o_orderkey % 6", ["no_schedule", "multi_event", "recurring", "past_time", "plain", "plain"]),
            "language": case("o_orderkey % 7", ["ko", "ko", "ko", "ko", "en", "en", "mixed"]),
            "wanted": "CAST(20 + o_custkey % 30 AS BIGINT)",
        },
    ),
)
