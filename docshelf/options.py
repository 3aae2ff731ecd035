"""Options and fixed values.

Values in the FIXED VALUES block must stay equal to the behaviour this engine
reproduces (thresholds, defaults, lists, name tables); everything else is a
tunable of the Spark plans.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reproduced behaviour; do not tune)
# ---------------------------------------------------------------------------
FALLBACK_CATEGORY = "Other"          # configured fallback for low confidence and blank text
ERROR_CATEGORY = "Other"             # literal used when classification fails
PROTECTED_CATEGORY = "Other"         # cannot be deleted from the taxonomy
NB_ALPHA = 0.4
NB_CONFIDENCE_THRESHOLD = 0.18
NGRAM_RANGE = (1, 2)
CORRECTION_WEIGHT = 3                # corrections are oversampled three times
CORRECTION_TEXT_CHARS = 500          # corrections are stored cut to 500 chars
EMBEDDING_LOW_THRESHOLD = 0.30
SEARCH_TOP_K = 10
SEARCH_MIN_SCORE = 0.25
SCORE_BAND_HIGH = 60.0
SCORE_BAND_MEDIUM = 40.0
CLASSIFY_WORDS = 512
INDEX_SNIPPET_WORDS = 300
PREVIEW_WORDS = 60
PREVIEW_CHARS = 300
PREVIEW_WEB_ELLIPSIS_WORDS = 50
LANGUAGE_MIN_CHARS = 20
RENAME_MIN_CHARS = 20
RENAME_SNIPPET_CHARS = 600
RENAME_MAX_CHARS = 80
ARCHIVE_MAX_MEMBERS = 10
ARCHIVE_MEMBER_CHARS = 2000
WATCH_SETTLE_SECONDS = 2.0
HISTORY_SCHEMA_VERSION = 1
MOVE_PATTERN = r"Moved '(.+?)' .+? '(.+?)'"      # a move in the legacy text log
INDEX_SCHEMA_VERSION = 2
DEFAULT_KEYWORD_SENTENCE = "add your keywords for {name} here"
RESTORED_SUFFIX = "_restored_"
SUPPORTED_EXTENSIONS = [".pdf", ".txt", ".docx", ".xlsx", ".pptx", ".csv", ".eml", ".msg",
                        ".zip", ".png", ".jpg", ".jpeg"]
ARCHIVE_TEXT_EXTENSIONS = [".txt", ".csv", ".md", ".py", ".js", ".html", ".xml", ".json"]
LANGUAGE_NAMES = {
    "en": "English", "hi": "Hindi", "mr": "Marathi", "ar": "Arabic",
    "fr": "French", "de": "German", "es": "Spanish", "zh": "Chinese",
    "ja": "Japanese", "pt": "Portuguese", "ru": "Russian", "it": "Italian",
    "ko": "Korean", "nl": "Dutch", "tr": "Turkish", "pl": "Polish",
    "unknown": "Unknown",
}
STATUS_LOW = "Low confidence"
STATUS_CONFIDENT = "Confident"
STATUS_OVERRIDDEN = "Manually overridden"
EXPORT_HEADER_WEB = ["File", "New Name", "Category", "Confidence (%)", "Language", "Status"]
EXPORT_HEADER_DESKTOP = ["File", "Category", "Confidence (%)", "Status"]
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class NBOptions:
    alpha: float = NB_ALPHA
    threshold: float = NB_CONFIDENCE_THRESHOLD
    ngram_range: tuple[int, int] = NGRAM_RANGE
    fallback: str = FALLBACK_CATEGORY
    stop_words: tuple[str, ...] | None = None   # None = Spark's English list
    # No longer read: the vocabulary is not replicated for the scoring join.
    term_salt: int = 8


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = SEARCH_TOP_K
    min_score: float = SEARCH_MIN_SCORE
    category: str | None = None
