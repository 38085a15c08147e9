"""Fixed values.

Everything in this module has to be exactly what it is for results to be
right: enumerations of the job message, the extension table, word lists,
markers, key formats and default limits.
"""

from __future__ import annotations

# --- job message enumerations (fixed values) -------------------------------
DOCUMENT_TYPES = [
    "pdf", "docx", "xlsx", "pptx", "html", "rtf", "odt", "txt", "csv", "image",
]
LOCATION_TYPES = ["s3", "url", "ftp", "local"]
AUTH_TYPES = ["none", "basic", "bearer", "aws_sigv4"]
DEFAULT_FTP_PORT = 21
SECRET_FIELDS = ["ftp_pass", "auth_password", "auth_token"]

# --- extension -> document type (fixed values) ------------------------------
EXTENSION_TYPES = {
    ".pdf": "pdf",
    ".docx": "docx", ".doc": "docx",
    ".xlsx": "xlsx", ".xls": "xlsx",
    ".csv": "csv",
    ".pptx": "pptx", ".ppt": "pptx",
    ".html": "html", ".htm": "html",
    ".rtf": "rtf",
    ".odt": "odt",
    ".txt": "txt",
    ".jpg": "image", ".jpeg": "image", ".png": "image", ".tiff": "image",
    ".tif": "image", ".bmp": "image", ".webp": "image",
}
SCAN_EXTENSIONS = [
    ".pdf", ".docx", ".xlsx", ".pptx", ".html", ".rtf", ".odt", ".txt", ".csv",
    ".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".webp",
]

# --- document type -> converter family (fixed values) -----------------------
CONVERTER_FAMILIES = {
    "pdf": "pages",
    "docx": "word",
    "xlsx": "spreadsheet",
    "csv": "spreadsheet",
    "pptx": "slides",
    "html": "html",
    "rtf": "rtf",
    "odt": "opendocument",
    "txt": "text",
    "image": "frames",
}

# --- longest time from the start of a conversion to its end (fixed value) ------
CONVERT_STEP_LIMIT = "600 SECONDS"

# --- text analytics (fixed values) ------------------------------------------
STOP_WORDS = [
    "the", "a", "an", "is", "it", "in", "on", "at", "to", "for",
    "of", "and", "or", "but", "not", "with", "by", "from", "as",
    "this", "that", "be", "are", "was", "were", "been", "have",
    "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "shall", "i", "you", "he",
    "she", "we", "they", "me", "him", "her", "us", "them", "my",
]
# Order matters: a tie goes to the language named first.
LANGUAGE_MARKERS = {
    "en": ["the", "and", "that", "have", "for", "not", "with"],
    "es": ["que", "los", "las", "una", "del", "por", "con"],
    "de": ["der", "die", "das", "und", "ist", "ein", "den"],
    "fr": ["les", "des", "une", "est", "que", "dans", "pour"],
}
UNKNOWN_LANGUAGE = "unknown"
TOP_WORDS = 20
PAGE_MARKER_PREFIX = "--- Page "
PAGE_MARKER_PATTERN = r"--- Page \p{Nd}+ ---\n?"
TABLE_MARKER = "[TABLE"
IMAGE_MARKER = "[IMAGE TEXT]"
CELL_SEPARATOR = " | "

# --- sizes and limits (fixed values) ----------------------------------------
CHUNK_CHARS = 65_536
PARAGRAPHS_PER_CHUNK = 50
SHEET_ROWS_PER_CHUNK = 200
MAX_FILE_SIZE_MB = 500.0
SCAN_MAX_FILES = 100
MIN_CHARS_THRESHOLD = 50
ESCALATION_TYPES = ["pdf", "image"]
RECENT_JOBS_LIMIT = 20
RETENTION_HOURS = 24

# --- output keys (fixed values) ---------------------------------------------
CONVERTED_PREFIX = "converted/"
FLOW_PREFIX = "pipeline/"
MULTI_PREFIX = "multi/"
PROCESSED_PREFIX = "processed/"
WATCH_JOB_PREFIX = "s3watch-"

# --- whitespace removed by a strip (fixed values: the Unicode white-space
# characters plus the four ASCII information separators) ---------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
