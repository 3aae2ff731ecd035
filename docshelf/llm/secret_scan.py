"""Secret scan: fixed patterns, and an assignment-aware lexer.

The lexer reads source and configuration syntax (``name = literal``, ``"name": "literal"``,
``export NAME=value``, ``a := b + "c"``) into assignments of a name to literals and other names. Names
are constants from their assignment on, so a literal also counts for the names it flows to. A
literal is scored by the most sensitive target name it reaches and by how random it looks.

Span kinds, in order: ``assign``, ``access``, ``hex`` (patterns), ``literal`` (a literal given to a sensitive
name), ``flow`` (one that reaches a sensitive name through another name). The last two are added
only where no pattern span overlaps. Offsets are code points, ends exclusive.

Defined results: null text counts as empty and has no spans; rows that repeat an id are scanned one
by one; other columns are not read. Very long texts and names are read whole, in time that grows with
their length; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

KINDS = ("assign", "access", "hex", "literal", "flow")
MASK = "[SECRET]"
SCORE = 1.0                      # a literal from this score on is a secret

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

# Sensitivity of the words of a name (joined words are looked up too).
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.8,
    "apikey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "privatekey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "jwt": 0.8, "pin": 0.4,
    "connectionstring": 0.8, "salt": 0.5,
}
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|<.*|\$[{(A-Z_].*|%\(?.*|\{\{.*|your.*|change.?me.*|example.*|dummy.*|placeholder"
                         r"|true|false|null|none|nil|undefined|todo|redacted|(?:https?|file)://[^:@]*)$")
OPERATOR = re.compile(r"=>|:=|[=:]")
PART = re.compile(r"""[ \t]*(?:(?:Bearer|Basic)[ \t]+)?(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`"""
                  r"""|([^\s,;#&(){}\[\]"'`<>+][^\s,;&(){}\[\]"'`<>+]*))""")
JOIN = re.compile(r"[ \t]*\+")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
NOT_NAME = re.compile(r"[^A-Za-z0-9_.\-]")
NAME_START = re.compile(r"[A-Za-z_].*", re.S)
STEP = 256                       # characters read at once towards the start of a name


def sensitivity(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    return max((SENSITIVE.get("".join(words[i:j]), 0.0) for i in range(len(words)) for j in range(i + 1, min(i + 3, len(words)) + 1)),
               default=0.0)


def randomness(value: str) -> float:
    """0 to 1.5: bits per character of a literal, its length and its mix of character classes."""
    if len(value) < 6 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + (not value.isalnum())
    return min(1.5, bits / 4.0 * min(1.0, n / 12) + 0.25 * (classes - 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping pattern matches of each kind; matches that are too short are dropped."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def name_before(text: str, end: int) -> str:
    """The name that ends before ``end`` (but for blanks and up to two closing quotes or brackets), or an empty string."""
    while end and text[end - 1] in " \t":
        end -= 1
    for _ in range(2):
        if end and text[end - 1] in "\"']":
            end -= 1
    start = end
    while start:
        low = max(0, start - STEP)
        other = [m.end() for m in NOT_NAME.finditer(text, low, start)]
        start = other[-1] if other else low
        if other:
            break
    name = NAME_START.search(text, start, end)
    return name.group() if name else ""


def assignments(text: str) -> Iterator[tuple[str, list[tuple[int, int, str, bool]]]]:
    """``(name, parts)`` in text order; a part is ``(start, end, value, quoted)``."""
    at = 0
    for op in OPERATOR.finditer(text):
        if op.start() < at:                                   # inside the literal of the last assignment
            continue
        if text.startswith(("=", "/"), op.end()) or not (name := name_before(text, op.start())):
            continue
        parts, pos = [], op.end()
        while (m := PART.match(text, pos)) is not None:
            k = m.lastindex
            parts.append((m.start(k), m.end(k), m.group(k), k < 4))
            pos = m.end()
            if (more := JOIN.match(text, pos)) is None:
                break
            pos = more.end()
        if parts:
            at = parts[-1][1]
            yield name, parts


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, directly or through constants.

    Each assignment is a node that points to the earlier assignments whose names it uses. The best weight that
    the literals of an assignment reach is found from the last assignment to the first, in one pass.
    """
    current: dict[str, int] = {}
    own: list[float] = []
    uses: list[set[int]] = []
    literals: list[tuple[int, int, int, str]] = []
    for node, (name, parts) in enumerate(assignments(text)):
        own.append(sensitivity(name))
        uses.append(set())
        for start, end, value, quoted in parts:
            if not quoted and value in current and NAME.match(value):
                uses[node].add(current[value])
            else:
                literals.append((node, start, end, value))
        current[name] = node
    best = own[:]
    for node in range(len(own) - 1, -1, -1):
        for earlier in uses[node]:
            best[earlier] = max(best[earlier], best[node])
    found = []
    for node, start, end, value in literals:
        if best[node] > 0 and best[node] * (r := randomness(value)) * 1.5 >= SCORE:
            direct = own[node] * r * 1.5 >= SCORE and own[node] == best[node]
            found.append((start, end, "literal" if direct else "flow"))
    return found


def apart(spans: list[tuple[int, int, str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The ``spans`` that overlap none of ``taken``."""
    starts = sorted((s, e) for s, e, _ in taken)
    furthest = list(accumulate((e for _, e in starts), max))
    starts = [s for s, _ in starts]
    return [x for x in spans if (k := bisect_left(starts, x[1])) == 0 or furthest[k - 1] <= x[0]]


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind."""
    base = base_spans(text)
    more = apart(lexed_spans(text), base) if "=" in text or ":" in text else []
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def _row(text: str) -> tuple:
    spans = scan(text)
    base = [x for x in spans if x[2] in KINDS[:3]]
    n = Counter(kind for _, _, kind in base)
    return (n["assign"], n["access"], n["hex"], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame([_row(x) for x in t], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), read(whole_text(text_col)).alias("r")).select("doc_id", "r.*")


def masked(text: str) -> str:
    """The text with every span replaced by a mask; spans that overlap share one."""
    out, at = [], 0
    for s, e, _ in scan(text):
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join(out) + text[at:] if at else text


def mask_secrets(text: Column) -> Column:
    @F.pandas_udf("string")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(masked, na_action="ignore")

    return read(text)
