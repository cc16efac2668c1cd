"""Values that results depend on and that therefore must not drift."""

# Timecodes, labels, tokens.
SPEAKER_LABEL = r"(?iU)^(SPEAKER|PERSON|UNKNOWN)[_ ]?"
UNKNOWN_SPEAKER = "UNKNOWN_SPEAKER"
TOKEN_TYPES = ["PERSON", "COMPANY", "LOCATION", "EMAIL", "PHONE", "URL", "DOMAIN", "TRANSACTION"]
TOKEN = r"(?:PERSON|COMPANY|LOCATION|EMAIL|PHONE|URL|DOMAIN|TRANSACTION)_\d{3,}"
QUOTE_WORD = r"[а-яёА-ЯЁa-zA-Z0-9@€$%+]+"
WORD_EDGE = " ,.!?—-…:;\"'«»"
MIN_ANCHOR_WORDS = 4

# Text that stands for "nothing".
NULL_TEXTS = ["null", "none", ""]
EMPTY_OWNERS = ["", "-", "—", "null", "none", "не назначен", "не назначено",
                "не указан", "не указано", "unknown", "n/a", "tbd"]
OWNER_CUT = r"[(,/]| или | и "

# Categories.
DEFAULT_CATEGORY = "Общее"
DEFAULT_SUBCATEGORY = "Без подкатегории"
KEYWORD_CATEGORIES = [("logistics", "Логистика"), ("marketing", "Маркетинг"), ("finance", "Финансы")]
BAD_NAME_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
NAME_LIMIT = 80

# File kinds.
AUDIO_EXTENSIONS = [".mp3", ".wav", ".m4a", ".ogg", ".mp4", ".mkv", ".flac", ".aac", ".webm"]
DOCUMENT_EXTENSIONS = [*AUDIO_EXTENSIONS, ".opus"]
PARTIAL_SUFFIXES = [".tmp", ".part", ".crdownload", ".download", ".partial"]
TRANSCRIPT_SUFFIX = r"(_anonymized_speakers|_speakers)$"
MAX_MESSAGE_FILE = 19_900_000

# Dates in names (year first, day first, compact), oldest year, look-ahead.
DATE_YEAR_FIRST = r"(?<!\d)(20\d{2})[-_.](\d{1,2})[-_.](\d{1,2})(?!\d)"
DATE_DAY_FIRST = r"(?<!\d)(\d{1,2})[-_.](\d{1,2})[-_.](20\d{2})(?!\d)"
DATE_COMPACT = r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)"
OLDEST_YEAR = 2020
MAX_FUTURE_DAYS = 2

# Spoken deadline hints.
HINT_TOMORROW = "сегодн|завтра|днях|день|дня"
HINT_WEEK = "недел|пятниц|понедельник"
HINT_MONTH = "месяц"

# Personal-data patterns in priority order, and the protected timecode.
PII_PATTERNS = [
    ("EMAIL", r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("URL", r"(?U)https?://[^\s\])\"'>»]+"),
    ("DOMAIN", r"(?iU)(?<![/@\w])(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+"
               r"(?:com|org|net|io|ru|de|uk|fr|es|it|co|gov|edu|biz|info|ai)\b"),
    ("PHONE", r"(?U)(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"
              r"|\+\d{1,3}[\s\-]\d{2,4}[\s\-]\d{3,4}[\s\-]\d{3,4}"),
    ("TRANSACTION", r"(?U)\b[A-Z]{2,6}[-_]?\d{6,}\b|\b\d{12,}\b"),
]
PROTECTED_TIMECODE = r"\[?\d{1,2}:\d{2}(?::\d{2})?(?:\s*-\s*\d{1,2}:\d{2}(?::\d{2})?)?\]?"
# Cheap necessary conditions; a text without the needle has no match of that kind.
PII_NEEDLES = {
    "TIME": r"\d:\d\d", "EMAIL": "@", "URL": "://", "PHONE": r"(?:\+\d|8)", "TRANSACTION": r"\d{6}",
    "DOMAIN": r"(?i)[a-z0-9]\.(?:com|org|net|io|ru|de|uk|fr|es|it|co|gov|edu|biz|info|ai)",
}
ENTITY_MIN_CHARS = 3
ENTITY_SKIP_WORDS = [
    "docker", "kubernetes", "redis", "postgresql", "postgres", "nginx",
    "linux", "ubuntu", "python", "javascript", "typescript", "react",
    "vue", "http", "https", "api", "rest", "json", "xml", "sql",
    "git", "github", "gitlab", "slack", "jira", "confluence",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "january", "february", "march", "april", "june", "july", "august",
    "september", "october", "november", "december",
    "понедельник", "вторник", "среда", "четверг", "пятница",
    "суббота", "воскресенье",
    "январь", "февраль", "март", "апрель", "май", "июнь",
    "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь",
    "ok", "yes", "no", "да", "нет", "ок", "info", "error", "warn",
]

# Meeting types and their labels.
MEETING_TYPES = {
    "planning": "Планёрка", "audit": "Аудит / разбор", "review": "Ревью результатов",
    "kickoff": "Kickoff", "brainstorm": "Брейншторм", "standup": "Стендап",
    "one_on_one": "1:1", "retro": "Ретро", "demo": "Демо", "other": "Рабочая встреча",
}

# Item kinds of an extraction and the text that identifies an item.
ITEM_KEYS = {
    "section_statuses": "section", "sequence": "what", "business_context": "topic",
    "decisions": "decision", "action_items": "task", "blockers": "blocker",
    "risks": "risk", "open_questions": "question", "meta_observations": "observation",
}
PLAIN_KINDS = ["important_facts", "mentioned_topics"]

# Review states, gate reasons, board lists that mean "done".
PROPOSAL_STATES = ["proposed", "accepted", "rejected", "sent"]
PATCHABLE = ["text", "owner", "label", "criterion", "due", "status", "kind"]
GATE_MISSING = "не найдено"
GATE_SENT = "уже отправлено"
GATE_MINOR = "мелочь — сначала «В приёмку»"
GATE_NO_CRITERION = "нет критерия готовности"
GATE_NO_DUE = "нет срока"
DONE_LISTS = ["готово", "✅ готово", "done", "✅ done", "сделано"]
DEFAULT_TITLE = "Совещание"
WEEKDAYS = ["Пн", "Вт", "Ср", "Чт", "Пт", "Сб", "Вс"]
