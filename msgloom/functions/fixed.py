"""Word lists, patterns and constants that results depend on."""

# --- dates -------------------------------------------------------------------
WEEKDAYS = "월화수목금토일"
DATE_ALIASES = {
    "today": "오늘",
    "tomorrow": "내일",
    "day after tomorrow": "모레",
    "overmorrow": "모레",
    "next week": "다음주",
    "this weekend": "이번주말",
    "next weekend": "다음주말",
}
DAY_WORDS = {"오늘": 0, "내일": 1, "모레": 2, "글피": 3}
WEEK_WORDS = {"이번주": 0, "다음주": 1, "다다음주": 2}
WEEKEND_WORDS = {"이번주말": 0, "다음주말": 7}

# --- times -------------------------------------------------------------------
AFTERNOON_MARKERS = ("오후", "저녁", "밤", "낮")
MORNING_MARKERS = ("오전", "아침", "새벽")
NOON = "정오"
MIDNIGHT = "자정"
MARKERS = ("오전", "오후", "저녁", "밤", "낮", "아침", "새벽", "정오", "자정")
#: In the order in which they are looked for in a text.
TEXT_MARKERS = ("새벽", "아침", "오전", "정오", "낮", "오후", "저녁", "밤", "자정")
DEFAULT_ZONE = "+09:00"
DEFAULT_ZONE_NAME = "Asia/Seoul"

# --- gates -------------------------------------------------------------------
CUES = (
    "내일|모레|글피|오늘|다음\\s*주|이번\\s*주|주말|월요일|화요일|수요일|목요일|금요일|토요일|일요일"
    "|오전|오후|저녁|정오|새벽|아침|낮|\\d{1,2}\\s*시|\\d{1,2}:\\d{2}|\\d{1,2}\\s*일|\\d{1,2}/\\d{1,2}"
    "|\\d+\\s*(주|개월|달|년)\\s*(뒤|후)|약속|회의|미팅|예약|모임|일정|스케줄|만나|보자|봬요"
    "|meeting|appointment|schedule|tomorrow|am|pm"
)
COMPLETED = (
    "완료됐|완료되었|복원됐|복원되었|취소됐|취소되었|처리됐|처리되었|발송됐|발송되었|충전됐|충전되었"
    "|출금됐|출금되었|입금됐|입금되었|승인됐|승인되었|등록됐|등록되었|확인됐|확인되었|변경됐|변경되었"
    "|발급됐|발급되었|해지됐|해지되었|정지됐|정지되었|차단됐|차단되었"
)
PAYMENT = (
    "결제일시|승인번호|결제[가이]\\s*(완료|취소)|충전[이가]\\s*완료|입금|출금|잔액|승인|카카오뱅크|카카오페이"
    "|국민카드|신한카드|삼성카드|현대카드|하나카드|롯데카드|농협|우리은행|케이뱅크|토스"
)
PAYMENT_TIME = "(?:(\\d{4})[./](\\d{2})[./](\\d{2})|(\\d{2})/(\\d{2}))\\s+(\\d{2}):(\\d{2})"
SURFACE_CUES = "\\d{1,2}\\s*시|\\d{1,2}\\s*일|\\d{1,2}/\\d{1,2}|내일|모레|글피|다음\\s*주|이번\\s*주|오전|오후|저녁|요일"
EXPLICIT_DAY = "\\d{1,2}\\s*/\\s*\\d{1,2}|\\d{1,2}\\s*월\\s*\\d{1,2}"

# --- titles, places, names ---------------------------------------------------
DEFAULT_TITLE = "일정"
WEB_MARK = "[Web발신]"
SELF_NAMES = ("나", "Me", "me")
ROSTER_STOP = ("참석", "회의", "모임", "일정", "확인", "참석자", "명단")
GENERIC_TITLES = ("기타 회의", "회의", "협의", "일정", "기타", "미팅", "스레드 협의", "기한 회의", "약속")
ONLINE_PLACES = (
    "줌", "구글밋", "구글 밋", "팀즈", "웹엑스", "페이스타임", "스카이프", "행아웃", "웨일온",
    "온라인", "화상", "전화", "zoom", "google meet", "teams", "webex", "skype", "hangout", "facetime",
)
ONLINE_TOOLS = (
    "줌", "구글밋", "구글미트", "미트", "팀즈", "페이스타임", "전화", "화상",
    "온라인", "웹엑스", "행아웃", "스카이프", "비대면", "영상통화", "보이스톡",
)
BOILERPLATE = ("스레드 협의 확정",)
ATTENDEES_LINE = "참석자: "
ORGANIZER_LINE = "주최: "
RECURRENCE_LINE = "반복: "
PLACE_LINE = "장소: "
LINK_LABELS = (
    (("zoom.us", "zoom.com"), "줌 링크"),
    (("meet.google",), "구글밋 링크"),
    (("teams.microsoft", "teams.live"), "팀즈 링크"),
    (("webex",), "웹엑스 링크"),
    (("maps.google", "maps.app.goo.gl", "goo.gl/maps", "naver.me", "map.naver", "map.kakao", "kko.to"), "지도"),
)
OTHER_LINK = "링크"

# --- anonymising -------------------------------------------------------------
NAMES_HANGUL = (
    "민준", "서연", "도윤", "지우", "하준", "서윤", "예준", "지유", "주원", "채원",
    "지호", "수아", "건우", "유나", "현우", "지민", "준서", "은우", "민서", "지안",
    "선우", "다은", "시우", "예린", "연우", "수빈", "정우", "하린", "지환", "소율",
)
NAMES_LATIN = (
    "Alex", "Sam", "Jordan", "Taylor", "Casey", "Morgan", "Riley", "Jamie",
    "Quinn", "Avery", "Drew", "Reese", "Skyler", "Rowan", "Emery", "Parker",
)
SPARE_NAMES = {"hangul": "사람", "latin": "Person"}
ORGANISATION = (
    "센터|은행|카드|증권|보험|병원|의원|약국|회사|공단|지원|관리|학교|학원|국세|세무|구청|시청|동사무소|주민센터"
    "|배송|택배|쿠팡|배민|토스|페이|뱅크|알림|고객|상담|안내|예약|Web발신|발신|no.?reply|noreply|admin|team|notification"
    "|기상청|재난|긴급|소방|경찰|행정안전|행안|안전안내|광역시|특별시|도청|군청|CMAS"
)
#: Kind, pattern and mask, in order of priority.
PERSONAL_DATA = (
    ("url", "https?://\\S+", "http://example.com"),
    ("email", "[\\w.+-]+@[\\w-]+\\.[\\w.-]+", "user@example.com"),
    ("national_id", "\\b\\d{6}\\s*-\\s*[1-4]\\d{6}\\b", "000000-0000000"),
    ("card", "\\b\\d{4}[-\\s]\\d{4}[-\\s]\\d{4}[-\\s]\\d{4}\\b", "0000-0000-0000-0000"),
    ("phone", "\\b0\\d{1,2}[-\\s]?\\d{3,4}[-\\s]?\\d{4}\\b", "010-0000-0000"),
    ("account", "\\b\\d{2,6}-\\d{2,6}-\\d{2,6}\\b", "000-000-000000"),
)

# --- limits ------------------------------------------------------------------
REPEAT_SECONDS = 10
CONTEXT_TURNS = 5
CONTEXT_MINUTES = 30
MERGE_DAYS = 30
TIME_TOLERANCE_SECONDS = 300
TITLE_LIMIT = 60
CLEAR_CONFIDENCE = 0.9
EVENT_KEYS = ("title", "date", "time", "end_time", "all_day", "location", "attendees", "organizer", "description", "recurrence")
#: Gold keys of older generations that a current row may not have.
ABOLISHED_KEYS = ("has_schedule", "schedule_status", "events")
