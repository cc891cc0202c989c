"""Fixed values that must equal the reference service's behaviour.

Every constant the operators compare against lives here, in one place,
so results line up with the service these jobs replace.
"""

# --- fixed values: chunking -------------------------------------------------
CHUNK_SIZE_WORDS = 200
CHUNK_OVERLAP_WORDS = 50

# --- fixed values: embeddings ----------------------------------------------
HASH_DIM_DEFAULT = 64          # module-level hash fallback dimension
DISTANCE = "Cosine"

# --- fixed values: search ---------------------------------------------------
TOP_K = 5
MAX_SEARCH_LIMIT = 15
STORE_SCORE_THRESHOLD = 0.15   # store-side, inclusive
SIMILARITY_THRESHOLD = 0.3     # hit-side, drop score <= threshold
DEMO_MATCH_RATIO = 0.6
DEMO_MIN_MATCH_SCORE = 0.0
SNIPPET_CHARS = 400
TITLE_PREFIX_WINDOW = 100
SCORE_DECIMALS = 6             # scores rounded before ranking (id tie-break)

# --- fixed values: answers --------------------------------------------------
MAX_CONTEXT_CHARS = 4000
TRUNCATION_SUFFIX = "\n\n...[Truncated context]..."
MAX_CONVERSATION_HISTORY = 6
DEMO_MAX_CHARS = 800
DEMO_BLOCKS = 3
MAX_QUERY_CHARS = 2000
DEMO_PREFIX = "(Demo mode - no chat model available) "
NO_MATCH_ANSWER = (
    "(Demo mode - no chat model available) I couldn't find any confident matches "
    "in the documents (no documents matched the query)."
)
NO_CONTEXT_ANSWER = "I have no documents to answer from. Try uploading or adding documents."
CONTENT_FILTER_MARKER = "__CONTENT_FILTER_BLOCKED__"
CONTENT_BLOCKED_ANSWER = "Content blocked by safety filters."
GENERIC_FAILURE_ANSWER = "Sorry, something went wrong with the assistant."
EMPTY_QUERY_MESSAGE = "Please provide a non-empty query."
LONG_QUERY_MESSAGE = "The query is too long; please shorten it."
NON_IT_MESSAGE = (
    "That question doesn't appear related to IT or work tasks (recipes, sports, travel, etc.). "
    "I can help with IT topics such as Microsoft 365, Windows, networking, printers, and related business questions. "
    "Please rephrase your question with an IT focus so I can assist."
)
SYSTEM_PROMPT_HEAD = (
    "You are a concise, factual, and safety-aware assistant for a public demo. "
    "Answer clearly in English and use Markdown when helpful. Do not invent links or confidential info.\n\n"
)
SYSTEM_PROMPT_TAIL = (
    "\n\nIf the answer comes from provided documents, PREFIX the response on the first line with [SOURCE:0]. "
    "If it comes from general knowledge, PREFIX the response on the first line with [SOURCE:1].\n"
)

# --- fixed values: query expansion (term -> appended words), in order -------
SYNONYMS = [
    ("office", "Office 365 Microsoft 365"),
    ("teams", "Microsoft Teams"),
    ("outlook", "Microsoft Outlook"),
    ("word", "Microsoft Word"),
    ("excel", "Microsoft Excel"),
    ("powerpoint", "Microsoft PowerPoint"),
    ("sharepoint", "Microsoft SharePoint"),
    ("onedrive", "OneDrive"),
    ("login", "log in login access password account"),
    ("printer", "printer print printing"),
    ("internet", "network wifi connection"),
    ("mail", "email outlook"),
    ("password", "password change reset update"),
    ("reset", "reset restart reboot"),
]

# --- fixed values: domain classifier ----------------------------------------
NON_IT_TERMS = ["recipe", "recipes", "food", "cooking", "travel", "movie", "music", "book", "books", "sport", "sports"]
IT_TERMS = [
    "windows", "excel", "outlook", "teams", "sharepoint", "onedrive", "word", "powerpoint", "vpn",
    "printer", "network", "wifi", "email", "password", "linux", "azure", "microsoft",
]
MATH_WORDS = ["plus", "minus", "times", "divide", "percentage", "%"]
DEMO_SOURCE_WORDS = ["microsoft", "windows", "office"]

# --- fixed values: request monitoring ---------------------------------------
SLOW_REQUEST_MS = 10000.0
ERROR_RATE_THRESHOLD = 0.1
ENDPOINT_BUDGETS_MS = [("/upload", 120000.0), ("/admin/upload_vectors", 300000.0)]
STALE_REQUEST_SECONDS = 10800
ACTIVE_REQUESTS_ALERT = 10
EVENT_LATENESS = "10 minutes"   # how far behind the latest event a stream still waits
RESTART_UPTIME_SECONDS = 60
RECENT_ERRORS_SHOWN = 10
MEMORY_WARNING_MB = 1024.0
MEMORY_CRITICAL_MB = 2048.0
MEMORY_SAMPLES_KEPT = 100

# --- fixed values: parser outputs ({name} = file name, {n} = 1-based slide) ----
PLACEHOLDER_PDF = "[Simulated PDF parsing for {name} - pdf parsing libraries missing or failed]"
PLACEHOLDER_DOCX = "[Simulated DOCX parsing for {name} - python-docx missing or failed]"
PLACEHOLDER_PPTX = "[Simulated PPTX parsing for {name} - python-pptx missing or failed]"
PLACEHOLDER_OTHER = "[Simulated parsing for {name} - demo mode]\nContent not extracted."
SHORTCUT_NO_URL = "Internet shortcut: {name}"
SHORTCUT_HEAD = "**{title}**\n\nType: Internet Link / Shortcut\nDescription: This is a link to {title}.\n"
SHORTCUT_POWERBI = "This is a Power BI report link.\n"
SHORTCUT_SHAREPOINT = "This is a SharePoint link.\n"
SHORTCUT_TAIL = "\nLink: [{title}]({url})\n\nKeywords: {title}, link, shortcut, URL\n"
LINKS_HEADER = "**Links from document:**"
SLIDE_MARKER = "\n--- Slide {n} ---\n"
CONTEXT_BLOCK = "Source ({filename}): {text}"

# --- fixed values: health and upload reports --------------------------------------
ISSUE_HIGH_ERROR_RATE = "High error rate: %.1f%%"
ISSUE_MANY_ACTIVE = "Many active requests: %d"
ISSUE_RESTART = "Recent restart detected"
STATUS_HEALTHY, STATUS_DEGRADED = "healthy", "degraded"
STATUS_INDEXED, STATUS_DIM_MISMATCH = "indexed", "embedding_dim_mismatch"
STATUS_UPSERTED, STATUS_SKIPPED = "upserted", "skipped"
REASON_NO_CHUNKS = "no chunks provided"
REASON_MISSING_VECTOR = "missing vector for chunk {i}"
