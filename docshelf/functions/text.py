"""Column expressions for text preparation.

Everything here returns a ``Column`` built from Spark's own functions, so it
stays inside whole-stage codegen and is evaluated row by row on executors.
Regex classes are written with Unicode properties because Java's ``\\w`` and
``\\s`` are ASCII-only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import options as O

# A word is a maximal run of non-whitespace (Python's ``str.split()``).
WORD_RE = r"[^\s\p{Z}]+"
# A token is a run of at least two letters, digits or underscores.
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
NON_SPACE_RE = r"[^\s\p{Z}]"
SPACE_RUN_RE = r"[\s\p{Z}]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: str | Column) -> Column:
    """Whitespace-separated words, like ``text.split()``."""
    return F.regexp_extract_all(_col(text), F.lit(WORD_RE), 0)


def word_prefix(text: str | Column, n: int) -> Column:
    """First ``n`` words joined by one space."""
    return F.concat_ws(" ", F.slice(words(text), 1, n))


def word_count(text: str | Column) -> Column:
    return F.size(words(text)).cast("bigint")


def is_blank(text: str | Column) -> Column:
    """True for null, empty or whitespace-only text."""
    t = _col(text)
    return t.isNull() | ~t.rlike(NON_SPACE_RE)


def collapse_spaces(text: str | Column) -> Column:
    """Words joined by one space (``" ".join(text.split())``)."""
    return F.concat_ws(" ", words(text))


def char_preview_web(text: str | Column) -> Column:
    """Collapsed text cut at 300 chars; ``...`` when the text has more than 50 words."""
    flat = collapse_spaces(text)
    cut = F.substring(flat, 1, O.PREVIEW_CHARS)
    return F.when(F.size(words(text)) > O.PREVIEW_WEB_ELLIPSIS_WORDS, F.concat(cut, F.lit("..."))).otherwise(cut)


def char_preview_desktop(text: str | Column) -> Column:
    """Stripped text cut at 300 chars; ``…`` when it was longer."""
    t = strip(text)
    cut = F.substring(t, 1, O.PREVIEW_CHARS)
    return F.when(F.length(t) > O.PREVIEW_CHARS, F.concat(cut, F.lit("…"))).otherwise(cut)


def strip(text: str | Column) -> Column:
    """Surrounding whitespace removed (Python ``str.strip()``; Spark ``trim`` only removes spaces)."""
    return F.regexp_replace(_col(text), r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def first_word(text: str | Column) -> Column:
    """First whitespace-separated word, null when there is none (reads only the start)."""
    w = F.regexp_extract(_col(text), r"^[\s\p{Z}]*([^\s\p{Z}]+)", 1)
    return F.when(w != "", w)


def first_line(text: str | Column) -> Column:
    """Text up to the first newline (``text.split("\\n")[0]``)."""
    return F.substring_index(_col(text), "\n", 1)


def stripped_length_at_least(text: str | Column, n: int) -> Column:
    """``len(text.strip()) >= n`` without rewriting the text.

    True when two non-space characters are at least ``n - 1`` apart.
    """
    if n <= 0:
        return F.lit(True)
    if n == 1:
        return _col(text).rlike(NON_SPACE_RE)
    # reluctant: the first such pair is enough, the rest of the text is not read
    return _col(text).rlike(r"[^\s\p{Z}][\s\S]{%d,}?[^\s\p{Z}]" % (n - 2))


def trimmed_length(text: str | Column) -> Column:
    """Length after stripping surrounding whitespace (Python ``len(s.strip())``)."""
    return F.length(strip(text))


# ---------------------------------------------------------------------------
# File-name parts (pathlib semantics on '/'-separated strings)
# ---------------------------------------------------------------------------

def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def parent_dir(path: str | Column) -> Column:
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def suffix(name: str | Column) -> Column:
    """Last suffix with its dot (``Path.suffix``).

    A suffix needs at least one character before the last dot and one after
    it, so ``.bashrc`` and ``a.`` have none and ``a.tar.gz`` has ``.gz``.
    """
    return F.regexp_extract(_col(name), r"(?s)^.+(\.[^.]+)\z", 1)


def stem(name: str | Column) -> Column:
    """Name without its last suffix (``Path.stem``)."""
    n = _col(name)
    return n.substr(F.lit(1), F.length(n) - F.length(suffix(n)))


def extension(path: str | Column) -> Column:
    """Lower-cased suffix with the dot, ``''`` when there is none."""
    return F.lower(suffix(base_name(path)))


def dispatch_extension(path: str | Column) -> Column:
    """Lower-cased text after the last dot of the whole path (extract dispatch)."""
    p = _col(path)
    return F.when(p.contains("."), F.lower(F.regexp_extract(p, r"\.([^.]*)$", 1))).otherwise(F.lit(""))


def relative_path(path: str | Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    p = _col(path)
    return F.when(p.startswith(root), F.substring(p, len(root) + 1, 1 << 30))


# ---------------------------------------------------------------------------
# Name sanitising (proposed names to a safe file stem)
# ---------------------------------------------------------------------------

def sanitise_name(raw: str | Column) -> Column:
    """Clean a proposed name into a file stem.

    Order: stem when the name holds a dot, then the first line trimmed, spaces
    to ``_``, drop everything but word characters and ``-``, strip ``_`` at
    both ends, cut at 80 characters.
    """
    r = _col(raw)
    # Path(x).stem looks at the last path part only.
    last_part = F.regexp_extract(r, r"([^/]*)\z", 1)
    stemmed = F.when(r.contains("."), stem(last_part)).otherwise(r)
    first_line = F.split(stemmed, "\n").getItem(0)
    first_line = F.regexp_replace(first_line, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")
    underscored = F.regexp_replace(first_line, " ", "_")
    kept = F.regexp_replace(underscored, r"[^\p{L}\p{N}_\-]", "")
    stripped = F.regexp_replace(kept, r"^_+|_+\z", "")
    return F.substring(stripped, 1, O.RENAME_MAX_CHARS)
