"""Fixed values.

Every word list, pattern, threshold and label below is part of the data
contract: changing one changes results.  Patterns are Java regular expressions.
Word edges are spelled as lookarounds on letters and digits, because ``\\b`` in
Unicode mode costs more per character than all the rest of a pattern.
"""

from __future__ import annotations

NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"

# --- fixed values: abbreviation expansion, applied in this order --------------
ABBREVIATIONS = (
    (r"пр-?(?:кт|т)", "проспект"),
    (r"пр-д", "проезд"),
    (r"р-н", "район"),
    (r"б-р", "бульвар"),
    (r"бульв", "бульвар"),
    (r"пер", "переулок"),
    (r"мкр", "микрорайон"),
    (r"наб", "набережная"),
    (r"туп", "тупик"),
    (r"пос", "поселок"),
    (r"пгт", "пгт"),
    (r"обл", "область"),
    (r"стр", "строение"),
    (r"ул", "улица"),
    (r"пл", "площадь"),
    (r"пр", "проспект"),
    (r"ш", "шоссе"),
    (r"г", "город"),
    (r"с", "село"),
    (r"п", "поселок"),
    (r"д", "дом"),
    (r"к", "корпус"),
)

# --- fixed values: word classes ---------------------------------------------
LOCALITY_WORDS = (
    "город", "г", "село", "с", "деревня", "д", "поселок", "пос", "пгт", "рп", "аул", "аал",
)
STREET_WORDS = (
    "улица", "проспект", "переулок", "проезд", "бульвар", "площадь", "шоссе", "тракт",
    "микрорайон", "набережная", "аллея", "тупик",
)
HOUSE_WORDS = ("дом", "корпус", "строение", "владение", "литера", "офис")
NO_BUILDING = ("", "бн", "б/н", "без номера", "без номер", "нет номера")
ADMIN_MARKERS = ("область", "обл", "край", "республика", "респ", "район", "р-н", "ао")

# --- fixed values: address patterns -----------------------------------------
NON_ADDRESS_CHARS = r"[^0-9a-zа-яё/\-–—]+"
HOUSE_KEY = r"(?<!\d)(\d{1,4}(?:/\d{1,4})?[a-zа-яA-ZА-Я]?)"
HOUSE_RANGE = r"\d{1,4}\s*[-–—]\s*\d{1,4}"
HOUSE_TOKEN = r"\d{1,4}(?:/\d{1,4})?[a-zа-я]?|\d{1,4}[-–—]\d{1,4}"
HOUSE_SPAN = r"(?<!\d)(\d{1,4})(?:\s*[-–—]\s*(\d{1,4}))?"

# --- fixed values: recovery patterns ----------------------------------------
STREET_TYPE = (
    rf"(?iu){NOT_AFTER_WORD}("
    r"ул(?:ица)?|пр(?:оспект|-?кт|-?т)?|пер(?:еулок)?|проезд|пр-?д|"
    r"бульвар|б-?р|пл(?:ощадь)?|ш(?:оссе)?|тракт|мкр|микрорайон|"
    r"наб(?:ережная)?|аллея|тупик"
    r")\.?\s+([^,;:\n]+)"
)
STREET_TYPE_TAIL = (
    rf"(?iu)([^,;:\n]+?)\s+{NOT_AFTER_WORD}("
    r"улица|проспект|переулок|проезд|бульвар|площадь|шоссе|тракт|"
    r"микрорайон|набережная|аллея|тупик"
    rf"){NOT_BEFORE_WORD}"
)
HOUSE_WITH_PREFIX = (
    rf"(?iu){NOT_AFTER_WORD}(?:д(?:ом)?|зд(?:ание)?|строение|стр|корп(?:ус)?|к|влад(?:ение)?|"
    r"лит(?:ера)?)\.?\s*(\d{1,4}(?:/\d{1,4})?[a-zа-я]?"
    rf"(?:\s*[-–—]\s*\d{{1,4}})?){NOT_BEFORE_WORD}"
)
TRAILING_HOUSE = (
    r"(?iu)(.*?\D)\s+(\d{1,4}(?:/\d{1,4})?[a-zа-я]?(?:\s*[-–—]\s*\d{1,4})?)\s*$"
)
ALPHA = r"[a-zA-Zа-яА-ЯёЁ]"
ROAD_DISTANCE = (
    rf"(?iu){NOT_AFTER_WORD}(?:км|а/?д|автодор|кадастр|к\.?\s*н|нас(?:еленный)?\s*пункт|"
    rf"разъезд|свертк|тер){NOT_BEFORE_WORD}"
)
CADASTRAL = rf"{NOT_AFTER_WORD}\d{{2}}:\d{{2}}:\d{{3,}}"
LOCALITY = (
    rf"(?iu){NOT_AFTER_WORD}(?:г(?:ород)?|с(?:ело)?|п(?:ос(?:елок|ёлок)?)?|пос(?:елок|ёлок)?|"
    r"пгт|рп|аал|аул|деревня)\.?\s+([^,;:\n]+)"
)
CITY_PREFIX = (
    r"(?iu)^(?:г(?:ород)?|с(?:ело)?|д(?:еревня)?|п(?:ос(?:елок|ёлок)?)?|"
    r"пос(?:елок|ёлок)?|пгт|рп|аал|аул)\.?\s+"
)
EDGE_PUNCTUATION = " .,;:-"
EXTRA_ADDRESS_KEYS = ("address", "addr", "location", "raw_location")

# --- fixed values: confidences ----------------------------------------------
FALLBACK_THRESHOLD = 0.6
CITY_PENALTY, CITY_GLUED_PENALTY = 0.2, 0.1
STREET_PENALTY = 0.15
BUILDING_PENALTY = 0.2
NO_CITY_FACTOR, REGEX_NO_CITY_FACTOR = 0.5, 0.75
REGEX_STREET_TYPED, REGEX_STREET_UNTYPED = 0.78, 0.64
REGEX_CITY_FIELD, REGEX_CITY_FORWARD, REGEX_CITY_LOCALITY = 0.08, 0.05, 0.04
REGEX_BUILDING = 0.09
REGEX_CONFIDENCE_CAP = 0.95

# --- fixed values: matcher ---------------------------------------------------
CITY_CUTOFF, STREET_CUTOFF = 0.88, 0.84
CONTAINMENT_SCORE = 0.93
SCORE_EXACT, SCORE_FUZZY_CITY_EXACT = 1.0, 0.96
SCORE_RANGE_CAP, SCORE_RANGE_BASE, SCORE_RANGE_SLOPE = 0.92, 0.84, 0.06
SCORE_STREET_AREA = 0.68

# --- fixed values: time rules ------------------------------------------------
SOURCE_ZONE = "+07:00"
DEDUP_TOLERANCE_SECONDS = 900
RISK_HORIZON_DAYS = 7
HIGH_LEAD_HOURS, MEDIUM_LEAD_HOURS = 24, 72
DEFAULT_DATE_FILTER_DAYS, MAX_DATE_FILTER_DAYS = 4, 14
DEFAULT_MAX_PAGES, MAX_PAGES = 5, 10
DEFAULT_PAGE_PARAM = "PAGEN_1"
MAX_PAYLOAD_BYTES = 10 * 1024 * 1024
SILENT_MULTIPLIER = 3.0
BACKOFF_BASE, BACKOFF_MAX_SECONDS, MAX_ATTEMPTS = 2, 600, 5

# --- fixed values: vocabularies ----------------------------------------------
EVENT_TYPES = ("power_outage", "maintenance", "infrastructure_failure", "other")
COMPATIBLE_EVENT_TYPES = ("power_outage", "maintenance", "infrastructure_failure")
IMPACT_LEVELS = ("low", "medium", "high")
SEVERITIES = ("low", "medium", "high", "critical")
SEVERITY_RANK = {"unknown": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_ORDER = ("critical", "high", "medium", "low", "unknown")
STATUS_RANK = {"ok": 0, "risk": 1, "critical": 2}
OUTAGE_TERMS = (
    "power_outage", "outage", "shutdown", "closure", "blackout", "отключ", "закрыт",
)
GRID_UNIT_TERMS = ("рэс", "уэс", "сет", "участ")
DESCRIBES_OUTAGE_TERMS = (
    "отключ", "электро", "ремонт", "авар", "обесточ", "вл-", "тп-",
    "outage", "maintenance", "shutdown", "blackout", "repair",
)
ABANDONED_TASK_ERROR = "abandoned by previous pipeline process"
REGION_MARKERS = ("обл", "край", "респ", "ао")
DISTRICT_MARKERS = ("р-н", "район")
TRUE_WORDS = ("1", "true", "yes", "y", "t")
OFFICE_REQUIRED_COLUMNS = ("name", "city", "address", "region")
FRAGMENT_LINK_HOST = "rosseti-tomsk.ru"
PIPELINE_STAGES = (
    ("scheduler", "Scheduler", "fetch_source"),
    ("collector", "Collector", "fetch_source"),
    ("parser", "Parser", "parse_content"),
    ("normalizer", "Regex Normalizer", "normalize_event"),
    ("dedup", "Dedup Engine", "deduplicate_event"),
    ("matcher", "Office Matcher", "match_offices"),
    ("notifier", "Notifier", "emit_event"),
)
NORMALIZER_PATHS = ("automaton", "regex_fallback", "llm_fallback", "none")
