"""Values fixed by the domain; results depend on every one of them."""

# ---- fixed values: research scope -------------------------------------------------
TARGET_CITIES = ("amsterdam", "london", "milan", "munich", "new york", "paris")
REQUIRED_STATIONS = ("EDDM", "EGLC", "EHAM", "KJFK", "KLGA", "LFPG", "LIMC")

MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
MONTH_ABBREVIATIONS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7,
    "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}

# ---- fixed values: text patterns (Java regex) ---------------------------------------
SIGNED_NUMBER = r"[+-]?\d+(?:\.\d+)?"
UNIT_WORD = r"(C|F|Celsius|Fahrenheit)?"
BUCKET_RANGE = rf"(?i)^\s*({SIGNED_NUMBER})\s*[-–]\s*({SIGNED_NUMBER})\s*°?\s*{UNIT_WORD}\s*$"
BUCKET_BELOW = rf"(?i)^\s*({SIGNED_NUMBER})\s*°?\s*{UNIT_WORD}\s+or\s+(?:below|lower|less)\s*$"
BUCKET_ABOVE = rf"(?i)^\s*({SIGNED_NUMBER})\s*°?\s*{UNIT_WORD}\s+or\s+(?:higher|above|more)\s*$"
BUCKET_EXACT = rf"(?i)^\s*({SIGNED_NUMBER})\s*°?\s*{UNIT_WORD}\s*$"
BARE_NUMBER = rf"^\s*{SIGNED_NUMBER}\s*$"
BARE_RANGE = rf"^\s*{SIGNED_NUMBER}\s*[-–]\s*{SIGNED_NUMBER}\s*$"
LABEL_RANGE = rf"({SIGNED_NUMBER})\s*[-–]\s*({SIGNED_NUMBER})"
LABEL_NUMBER = rf"({SIGNED_NUMBER})"
LABEL_UNIT = r"(?i)(?:°\s*([CF])\b|(Celsius|Fahrenheit)\b)"

QUESTION_DATE = (
    r"(?i)(?:will\s+the\s+)?highest\s+temperature\s+in\s+"
    r"(?:new\s+york|paris|london|munich|amsterdam|milan)(?:\s+city)?(?:\s+be\s+[^?]+?)?"
    r"\s+on\s+([A-Za-z]+)\s+(\d{1,2})(?:[a-z]{2})?(?:,?\s*(\d{4}))?"
)
SLUG_DATE = (
    r"(?i)(?:will-the-)?highest-temperature-in-"
    r"(?:new-york|paris|london|munich|amsterdam|milan)(?:-city)?(?:-be-[^-]+?)?"
    r"-on-([a-z]+)-(\d{1,2})(?:-(\d{4}))?"
)
MONTH_WORD = (
    "january|february|march|april|may|june|july|august|september|october|november|december"
    "|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
)
DESCRIPTION_MDY = rf"(?i)\b({MONTH_WORD})\s+(\d{{1,2}})(?:[a-z]{{2}})?,?\s+(20\d{{2}})\b"
DESCRIPTION_DMY_SHORT = r"\b(\d{1,2})\s+([A-Za-z]{3,9})\s+'?(\d{2})\b"
ISO_DATE = r"^(\d{4})-(\d{2})-(\d{2})$"

STATION_IN_PATH = r"(?i)/([A-Z]{4})(?=[/?#]|[^\w]|$)"
STATION_IN_PARENTHESES = r"\(([A-Z]{4})\)"
STATION_CODE = r"^[A-Z]{4}$"
RESOLUTION_HOST = "wunderground.com"
RESOLUTION_PATH = "/history/daily/"
RESOLUTION_STATION = r"(?i)/history/daily/(?:[a-z]{2}/[^/]+/)?([A-Za-z]{4})\b"

SLUG_BUCKET_SUFFIX = r"(?i)-(?:\d+(?:-\d+)?[cf]|or-below|or-higher|or-lower|or-above)$"
# the same suffix by its endings; texts that end in c or f have no line end behind it
SLUG_BUCKET_WORDS = ("-or-below", "-or-higher", "-or-lower", "-or-above")
SLUG_DEGREES = r"^([^-]*+(?:-(?!\d+(?:-\d+)?[cf]\z)[^-]*+)*+)"
QUESTION_FAMILY = r"(?i)(highest\s+temperature\s+in\s+.+?\s+on\s+[A-Za-z]+\s+\d{1,2}(?:,\s*\d{4})?)"
CITY_IN_TEXT = r"(?i)\b(new\s+york|paris|london|munich|amsterdam|milan)\b"
DATE_IN_QUESTION = r"(?i)\bon\s+([A-Za-z]+)\s+(\d{1,2})(?:[a-z]{2})?(?:,?\s*(\d{4}))?"
DATE_IN_SLUG = r"(?i)-on-([a-z]+)-(\d{1,2})(?:-(\d{4}))?"
MEMBER_KEY = r"^(.+)_member(\d+)$"

# ---- fixed values: class labels -------------------------------------------------------
EDGE_BUCKETS = ("<=0%", "0-5%", "5-10%", "10-15%", "15-20%", ">20%")
PRICE_BUCKETS = ("<1c", "1-3c", "3-5c", "5-10c", "10-25c", ">25c")
LEAD_BUCKETS = (">48h", "24-48h", "12-24h", "6-12h", "1-6h", "<1h")
TAIL_BANDS = (("<1c", 0.0, 0.01), ("1-3c", 0.01, 0.03), ("3-5c", 0.03, 0.05))
EDGE_THRESHOLDS = (0.05, 0.10, 0.15, 0.20)
SURVIVAL_STATUS = {
    None: "unknown_no_historical_asks",
    True: "measured_survived",
    False: "measured_did_not_survive",
}
SURVIVAL_STATE = {
    None: "UNKNOWN",
    True: "MEASURED_SURVIVED",
    False: "MEASURED_DID_NOT_SURVIVE",
}
MIN_SCORED_EVENTS = 30
LOG_LOSS_CLIP = 1e-15
PROBABILITY_TOLERANCE = 1e-9
CALIBRATION_BINS = 10
TRAIN_FRACTION, VALIDATION_FRACTION, TEST_FRACTION = 0.6, 0.2, 0.2

PRICE_LOOKBACK_DAYS = 7
RUN_STEP_HOURS = 6
AVAILABILITY_LAG_HOURS = 6
RUN_HORIZON_HOURS = 240
RUN_STEPS_BACK = 40

HOURLY_FEATURES = (
    "temperature_c", "dew_point_c", "humidity_pct", "cloud_cover_pct", "wind_speed",
    "wind_direction_deg", "precipitation", "surface_pressure",
)
HOURLY_SERIES = (
    "temperature_2m", "dew_point_2m", "relative_humidity_2m", "cloud_cover", "wind_speed_10m",
    "wind_direction_10m", "precipitation", "surface_pressure",
)
AUDITED_FIELDS = (
    "market_probability", "forecast_daily_max_c", "settlement_label", "diagnostic_actual_max_c",
    "best_ask", "executable_entry_price", "observation_max_so_far_c", "dew_point_c",
    "humidity_pct", "cloud_cover_pct", "wind_speed", "precipitation", "surface_pressure",
)
KEYED_TABLES = (
    "markets", "outcomes", "price_snapshots", "trades", "order_book_snapshots",
    "order_book_levels", "weather_forecasts", "forecast_ensemble_members",
    "hourly_observations", "daily_actual_maxima", "raw_payloads",
)
CELSIUS_UNITS = ("°c", "c", "celsius")
UNIT_ALIASES = {
    "C": "C", "CELSIUS": "C", "DEGC": "C",
    "F": "F", "FAHRENHEIT": "F", "DEGF": "F",
    "K": "K", "KELVIN": "K",
}

# ---- fixed values: result codes and texts ------------------------------------------------
IDENTITY_AMBIGUOUS = "event_identity_ambiguous"
DUPLICATE_SNAPSHOT = "duplicate_snapshot"
EVENT_ID_CONFLICT = "event_id_conflict"
CITY_CONFLICT = "event_city_conflict"
STATION_CONFLICT = "event_station_conflict"
DATE_CONFLICT = "event_date_conflict"
UNIT_CONFLICT = "event_unit_conflict"
RESOLUTION_CONFLICT = "event_resolution_source_conflict"
SLUG_CONFLICT = "event_slug_family_conflict"
QUESTION_CONFLICT = "event_question_family_conflict"
MARKET_FAMILY_CONFLICT = "event_market_family_conflict"
STRUCTURE_CONFLICT = "event_bucket_structure_conflict"
DUPLICATE_OUTCOME = "duplicate_outcome_conflict"
SETTLEMENT_CARDINALITY = "event_settlement_cardinality_conflict"
SETTLEMENT_UNRESOLVED = "event_settlement_unresolved"
NO_COVERAGE = "NO_USABLE_EVENT_COVERAGE"

PROVIDER_PRICES = "polymarket-clob-prices-history"
PROVIDER_SEARCH = "polymarket-gamma-public-search"
PROVIDER_RUN = "open-meteo-single-run"
PROVIDER_ARCHIVE = "open-meteo-archive"

NOT_SETTLED = "market not closed/resolved; settlement label unavailable"
SETTLEMENT_SHORT = "outcomes/outcomePrices missing or too short for binary settlement"
SETTLEMENT_LENGTH = "outcomes and outcomePrices length mismatch"
SETTLEMENT_AMBIGUOUS = "outcomePrices not unambiguous binary 1/0 settlement"

LOOKAHEAD_ISSUED = "weather issued_at is after decision_ts"
LOOKAHEAD_AVAILABLE = "weather available_at is after decision_ts; run not yet public"
LOOKAHEAD_ORDER = "weather available_at precedes issued_at"
LOOKAHEAD_PRICE = "price observed_at is after decision_ts"
LOOKAHEAD_OBSERVATION = "observation_as_of is after decision_ts"
LOOKAHEAD_NO_STAMP = "observation_max_so_far_c requires observation_as_of <= decision_ts"

NOTE_CITY = "city not identified among configured research cities"
NOTE_DATE = "event date not parsed; question retained"
NOTE_STATION = "station ICAO not found in source text; not inferred"
NOTE_MANY_STATIONS = "multiple ICAO-like tokens; station left unresolved"
NOTE_NO_YEAR = "year missing; date not synthesized"

STITCHED_LIMITATIONS = (
    "Open-Meteo Historical Forecast API stitches the first hours of successive model runs into a "
    "continuous series; per-timestep forecast issuance/run time is not provided and is stored as "
    "null.",
    "generationtime_ms is API processing latency, not model initialization time.",
)
ENSEMBLE_LIMITATIONS = (
    "Open-Meteo Ensemble API does not provide per-member issuance/run timestamps; issued_at is "
    "stored as null.",
    "Ensemble members are stored only when the JSON includes *_memberNN series.",
)
ARCHIVE_LIMITATIONS = (
    "Open-Meteo Archive /v1/archive is reanalysis-based (ERA5 family), not METAR.",
    "Daily maxima use the timezone supplied in the API response.",
)
NO_ISSUE_TIME = "forecast issuance timestamp unavailable in this response; not fabricated"
