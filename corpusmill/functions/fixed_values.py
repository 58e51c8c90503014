"""Fixed values.

Everything in this file must equal what the replaced application uses, or
results differ: language order, message texts, word lists, patterns, limits.
"""

# --- languages -------------------------------------------------------------
SUPPORTED_LANGUAGES = ["fr", "de", "it", "rm", "en"]
DEFAULT_LANGUAGE = "fr"
FALLBACK_LANGUAGE = "en"
SOURCE_PREFERENCE = ["en", "fr", "de", "it", "rm"]
LANGUAGE_CODE = r"^[a-z]{2}(-[a-z]{2})?$"
LANGUAGE_PATH_MARKERS = ["de", "it", "rm", "en"]

# --- white space: the Unicode White_Space property -------------------------
WHITE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- chunking --------------------------------------------------------------
CHUNK_SIZE = 768
CHUNK_SIZE_RANGE = (512, 1024)
CHUNK_OVERLAP = 0.15
CHUNK_OVERLAP_RANGE = (0.10, 0.20)

# --- embedding, retrieval, prompt ------------------------------------------
EMBEDDING_DIMENSIONS = 128
TOP_K = 5
MAX_EMBEDDING_INPUT_BYTES = 4000
MAX_PROMPT_BYTES = 4000
PROMPT_RESERVE_BYTES = 220
PROMPT_MIN_BUDGET = 800
PROMPT_MAX_HITS = 8
HIGHLIGHT_BYTES = 220
HIGHLIGHT_MAX = 2
HIGHLIGHT_MIN_BREAK = 40
QUESTION_BYTES = 1200
QUESTION_REJECT_BYTES = 2000
SAMPLE_SNIPPET_BYTES = 220

# --- privacy ---------------------------------------------------------------
EMAIL_MARK = "[redacted-email]"
PHONE_MARK = "[redacted-phone]"
SENSITIVE_KEY_PARTS = ["email", "contact"]

# --- messages by language --------------------------------------------------
SUMMARY_PREFIX = {
    "de": "Deterministische Zusammenfassung basierend auf indexierten Quellen (LLM deaktiviert).",
    "it": "Riassunto deterministico basato su fonti indicizzate (LLM disattivato).",
    "rm": "Resum deterministic basau sin funtaunas indexadas (LLM deactivau).",
    "en": "Deterministic summary based on indexed sources (LLM disabled).",
    "fr": "Resume deterministe base sur les sources indexees (LLM desactive).",
}
SUMMARY_NO_SOURCE = {
    "de": "Deterministische Zusammenfassung nicht verfugbar: keine nutzbare Quelle.",
    "it": "Riassunto deterministico non disponibile: nessuna fonte utilizzabile.",
    "rm": "Resum deterministic betg disponibel: nagina funtauna utilisabla.",
    "en": "Deterministic summary unavailable: no usable source.",
    "fr": "Resume deterministe indisponible: aucune source exploitable.",
}
NO_RELEVANT_SOURCE = {
    "de": "Es wurden keine relevanten Quellen gefunden.",
    "it": "Nessuna fonte pertinente trovata.",
    "rm": "Nagina funtauna relevanta e vegnida chattada.",
    "en": "No relevant source was found.",
    "fr": "Aucune source pertinente n'a ete trouvee.",
}
TRANSLATION_PENDING_MESSAGE = "translation in progress"
PROMPT_QUESTION_HEAD = "Question utilisateur (sanitisee):\n"
PROMPT_EXCERPTS_HEAD = "\n\nExtraits de documents publics indexes:\n"
PROMPT_INSTRUCTION = (
    'Return the answer strictly in language code "{lang}", in 1 or 2 factual sentences maximum, '
    "using only these sources."
)
TRANSLATION_PROMPT = (
    "Translate the following {label} from language code {source} to language code {target}. "
    "Keep factual meaning, names and numbers unchanged. Return only the translation.\n\n{text}"
)

# --- classification word lists ---------------------------------------------
PRO_WORDS = ["begrundung", "fuer", "dafur", "pro", "soutien", "favorable", "unterstutzt"]
CONTRA_WORDS = ["ablehnung", "dagegen", "contra", "contre", "defavorable", "refus", "oppose"]
INITIANT_ROLE_WORDS = ["auteur", "urheber", "initiant", "motionnaire", "postulant"]
OFFICIAL_SYSTEM_WORDS = ["openparl", "admin", "opendata"]
ARGUMENT_MISSING = "indisponible"

# --- names of source systems, keys looked for in vote payloads -------------
VOTE_SYSTEM = "openparldata"
VOTE_ORG = "OpenParlData.ch"
VOTE_API_HOST = "api.openparldata.ch"
VOTE_API_ROOT = "https://api.openparldata.ch/v1"
DATASET_SYSTEM = "opendata_swiss"
DATASET_HOST = "opendata.swiss"
BALLOT_SYSTEM = "abstimmungen_admin"
BALLOT_HOST = "abstimmungen.admin.ch"
COMMUNE_CODE_KEYS = [
    "commune_code",
    "municipality_code",
    "gemeinde_code",
    "comune_code",
    "vischnanca_code",
]
COMMUNE_NAME_KEYS = [
    "commune_name",
    "municipality_name",
    "gemeinde_name",
    "comune_name",
    "vischnanca_name",
    "commune",
    "municipality",
    "gemeinde",
    "comune",
    "vischnanca",
]

# --- request limits --------------------------------------------------------
LEVELS = ["federal", "cantonal", "communal"]
STATUSES = ["past", "upcoming"]
USAGE_FLOWS = ["rag_index", "qa_query"]
USAGE_OPERATIONS = ["embedding", "translation", "summarization"]
USAGE_MODES = ["local", "llm"]
LIST_LIMIT = (20, 100)
USAGE_LIMIT = (100, 1000)
MAX_FILE_BYTES = 2 * 1024 * 1024

# --- question cache --------------------------------------------------------
EXACT_TTL_SECONDS = 600
TRANSLATION_JOB_SECONDS = 90
EXACT_MAX_ENTRIES = 500
EXACT_ENTRIES_CEILING = 50_000
SEMANTIC_TTL_SECONDS = 86_400
SEMANTIC_MAX_ENTRIES = 2000
SEMANTIC_ENTRIES_CEILING = 100_000
SEMANTIC_THRESHOLD = 0.90
SEMANTIC_MIN_BYTES = 24

# --- crawl -----------------------------------------------------------------
CRAWL_MAX_DEPTH = 3
CRAWL_MAX_NODES = 150
CRAWL_VOTINGS = 5
FETCH_MAX_BYTES = 1_500_000
FETCH_MIN_INTERVAL_SECONDS = 1.0
FETCH_MAX_RETRIES = 3
FETCH_BACKOFF_MAX_SECONDS = 30.0
FETCH_JITTER_MS = (100, 250)
FETCH_TTL_SECONDS = 72 * 3600
FETCH_RETENTION_SECONDS = 168 * 3600
RETRYABLE_STATUS = [429, 500, 502, 503, 504]
DOC_TEXT_BYTES = 4000
FREE_TEXT_BYTES = 2000
ARGUMENT_DOC_BYTES = 1800
ARGUMENT_TEXT_BYTES = 1200
ARGUMENT_SIDE_BYTES = 2400

# --- rate limit ------------------------------------------------------------
RATE_QPS = 1.0
RATE_BURST = 3
