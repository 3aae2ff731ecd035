"""Personal data by fixed patterns and a semi-Markov conditional random field.

The field scores whole spans: the shape of a candidate segment (runs of digits, letters and signs),
its digit count, checksum and address range, and its neighbours, not single tokens. Over an island
of text around digits and at signs, a dynamic program over segments of at most ``max_tokens`` tokens
chooses boundaries and types together; training maximises the likelihood of whole segmentations
with the forward-backward sums of the same recursion.

It is trained here on a bounded sample of islands: those of the documents with the smallest text
hashes, labelled by the patterns. Islands without a pattern are its negatives. Each labelled phone
or card number is also learned in forms the patterns miss (no plus sign, no country code, dots
between groups), which is what decoding adds.

Span kinds, in order: ``email``, ``ip``, ``card``, ``phone`` (patterns), then ``crf_email``, ``crf_ip``, ``crf_card``,
``crf_phone`` for decoded segments that overlap no pattern span. Offsets are code points, ends exclusive.

Defined results: null text counts as empty and has no spans; with no island to learn from only the
patterns remain; rows that repeat an id are read one by one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text, written

TYPES = ("email", "ip", "card", "phone")
KINDS = TYPES + tuple(f"crf_{t}" for t in TYPES)

# The patterns of the base kinds, in forms that read long runs in linear time.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")
ISLAND = re.compile(r"\S+(?:[ \t]\S*?[0-9@]\S*)*")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[ \t]+|.", re.S)


@dataclass(frozen=True)
class CrfOptions:
    sample_docs: int = 20_000      # documents whose islands without a base span may be learned from
    sample_islands: int = 1_500    # of them, islands learned from
    sample_kind: int = 250         # islands with a base span learned from, for each kind, of all documents
    island_tokens: int = 60        # longer islands are decoded, not learned from
    max_tokens: int = 16           # bound of a segment
    epochs: int = 4
    rate: float = 0.5
    margin: float = 3.0            # log-odds against no entity from which a decoded span counts


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each pattern, by kind, then start; failing ones are dropped."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        host = EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            last = host.end()
            found.append((start, last, "email"))
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    if DIGIT.search(text) is None:
        return found
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        pos, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            end = pos + sum(map(len, parts[i:i + 4])) + 3
            if all(_small(p) for p in parts[i:i + 4]):
                found.append((pos, end, "ip"))
            pos = end + 1
    for kind, pattern, low, high in (("card", CARD, 13, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= low and low <= len(d := "".join(filter(str.isdigit, m.group()))) <= high:
                if kind == "phone" or luhn(d):
                    found.append((m.start(), m.end(), kind))
    return found


def _small(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of chunks that hold a digit or at sign, with their whole first chunk."""
    at = 0
    while (m := TRIGGER.search(text, at)) is not None:
        start = max(at, *(text.rfind(c, at, m.start()) + 1 for c in " \t\n\r\x0b\x0c"))
        end = ISLAND.match(text, start).end() if not text[start].isspace() else m.end()
        yield start, end
        at = max(end, m.end())


def shape(piece: str) -> str:
    """Digits as 9, letters as a run mark, signs as they are."""
    out = []
    for m in TOKEN.finditer(piece):
        t = m.group()
        out.append("9" * min(len(t), 20) if t[0].isascii() and t[0].isdigit() else "a" if t.isascii() and t.isalpha()
                   else " " if t.isspace() else t if t.isascii() else "u")
    return "".join(out)


def span_features(piece: str, before: str, after: str) -> list[str]:
    """Features of a whole candidate segment."""
    sh = shape(piece)
    digits = "".join(c for c in piece if "0" <= c <= "9")
    coarse = re.sub("9+", "9", sh)
    parts = piece.split(".")
    return [
        "bias", "shape " + sh[:40], "coarse " + coarse[:40], f"digits {min(len(digits), 20)}",
        "signs " + "".join(sorted(set(coarse) - {"9", "a"})), f"first {sh[0]}", f"last {sh[-1]}",
        f"before {_side(before)}", f"after {_side(after)}", f"at {min(piece.count('@'), 2)}",
        f"card {13 <= len(digits) <= 19 and luhn(digits)} {bool(set(sh) - set('9 -'))}",
        f"address {len(parts) == 4 and all(p.isdigit() and _small(p) for p in parts)}",
        f"host {'@' in piece and '.' in piece.partition('@')[2]}",
    ]


def _side(c: str) -> str:
    return "" if not c else "9" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c if c.isascii() else "u"


def candidates(text: str, start: int, end: int, opts: CrfOptions) -> tuple[list[int], dict[int, list[tuple[int, str, str, str]]]]:
    """Token edges of an island, and by last edge its candidate segments ``(first edge, piece, before, after)``."""
    edges = [start] + [m.end() for m in TOKEN.finditer(text, start, end)]
    by_end: dict[int, list] = {}
    for j in range(1, len(edges)):
        if not text[edges[j] - 1].isalnum():
            continue
        for i in range(max(0, j - opts.max_tokens), j):
            c = text[edges[i]]
            piece = text[edges[i]:edges[j]]
            if (c.isalnum() or c in "+(") and TRIGGER.search(piece) and "\n" not in piece and edges[j] - edges[i] >= 6:
                by_end.setdefault(j, []).append((i, piece, text[edges[i] - 1:edges[i]], text[edges[j]:edges[j] + 1]))
    return edges, by_end


def variants(text: str) -> Iterator[tuple[str, dict[tuple[int, int], int]]]:
    """An island's text with its labelled spans, then rewritten forms of single spans."""
    gold, free = {}, 0
    for s, e, kind in sorted(base_spans(text), key=lambda x: (x[0], -x[1])):
        if s >= free:
            gold[s, e], free = TYPES.index(kind), e
    yield text, gold
    for (s, e), kind in gold.items():
        piece = text[s:e]
        forms = ([piece[1:], piece.partition(" ")[2]] if TYPES[kind] == "phone"
                 else [re.sub("[ -]", ".", piece)] if TYPES[kind] == "card" else [])
        for form in forms:
            if form and form != piece and sum(map(str.isdigit, form)) >= 9:
                yield text[:s] + form + text[e:], {(s, s + len(form)): kind}


def train(examples: list[str], opts: CrfOptions) -> dict[str, list[float]]:
    """Feature weights (one per type; no entity scores 0) that maximise the segmentations' likelihood."""
    ids: dict[str, int] = {}
    data = []
    for text, gold in (v for x in examples for v in variants(x)):
        edges, by_end = candidates(text, 0, len(text), opts)
        segs = [(i, j, np.array([ids.setdefault(f, len(ids)) for f in span_features(p, b, a)]))
                for j, found in sorted(by_end.items()) for i, p, b, a in found]
        if not segs:
            continue
        data.append((len(edges), segs, [gold.get((edges[i], edges[j]), -1) for i, j, _ in segs]))
    weights, squares = np.zeros((len(ids), len(TYPES))), np.full((len(ids), len(TYPES)), 1e-6)
    for _ in range(opts.epochs):
        for n, segs, gold in data:
            scores = [weights[f].sum(axis=0) for _, _, f in segs]
            head, tail = [0.0] * n, [0.0] * n
            ends: dict[int, list[int]] = {}
            starts: dict[int, list[int]] = {}
            for k, (i, j, _) in enumerate(segs):
                ends.setdefault(j, []).append(k)
                starts.setdefault(i, []).append(k)
            for j in range(1, n):
                head[j] = _log_sum([head[j - 1]] + [head[segs[k][0]] + x for k in ends.get(j, ()) for x in scores[k]])
            for i in range(n - 2, -1, -1):
                tail[i] = _log_sum([tail[i + 1]] + [tail[segs[k][1]] + x for k in starts.get(i, ()) for x in scores[k]])
            for k, (i, j, f) in enumerate(segs):
                slope = -np.exp(np.minimum(0.0, head[i] + scores[k] + tail[j] - head[n - 1]))
                if gold[k] >= 0:
                    slope[gold[k]] += 1.0
                if np.abs(slope).max() > 1e-4:
                    squares[f] += slope * slope
                    weights[f] += opts.rate * slope / np.sqrt(squares[f])
    return {f: weights[k].tolist() for f, k in ids.items() if np.abs(weights[k]).max() > 1e-3}


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


class Field:
    """Learned weights, with the scores of segments met before."""

    def __init__(self, weights: dict[str, list[float]], opts: CrfOptions):
        self.weights, self.opts, self.known = weights, opts, {}

    def score(self, piece: str, before: str, after: str) -> tuple[float, int]:
        features = tuple(span_features(piece, before, after))
        hit = self.known.get(features)
        if hit is None:
            if len(self.known) > 50_000:
                self.known.clear()
            sums = np.sum([self.weights[f] for f in features if f in self.weights] or [[-9.0] * len(TYPES)], axis=0)
            hit = self.known[features] = (float(sums.max()), int(sums.argmax()))
        return hit

    def decode(self, text: str, start: int, end: int) -> list[tuple[int, int, str]]:
        """Best segmentation of an island: its entities with at least the margin."""
        edges, by_end = candidates(text, start, end, self.opts)
        if not by_end:
            return []
        best, back = [0.0], [None]
        for j in range(1, len(edges)):
            top, step = best[j - 1], None
            for i, piece, before, after in by_end.get(j, ()):
                x, kind = self.score(piece, before, after)
                if x >= self.opts.margin and best[i] + x > top:
                    top, step = best[i] + x, (i, kind)
            best.append(top)
            back.append(step)
        out, j = [], len(edges) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((edges[i], edges[j], f"crf_{TYPES[kind]}"))
                j = i
        return out[::-1]


def find_spans(text: str, field: Field | None) -> list[tuple[int, int, str]]:
    """All spans of a text by kind, then start."""
    base = base_spans(text)
    more = []
    if field is not None and field.weights:
        taken = sorted((s, e) for s, e, _ in base)
        for s, e in islands(text):
            near = [t for t in taken if t[0] < e and s < t[1]] if taken else []
            if any(a <= s and e <= b for a, b in near):
                continue
            more += [x for x in field.decode(text, s, e) if not any(a < x[1] and x[0] < b for a, b in near)]
    return sorted(base + more, key=lambda x: (KINDS.index(x[2]), x[0], x[1]))


def sample_of(docs: DataFrame, text_col: str = "text", opts: CrfOptions = CrfOptions()) -> DataFrame:
    """``kind, island``: a bounded number of different islands for each base kind and for ``none``.

    Islands with a base span come from all documents, so kinds that are rare among numbers are learned too;
    those without come from a bounded sample. Of each kind the islands with the smallest crc32 are taken,
    whatever the partitions; a task passes on no more of a kind than are taken in all.
    """
    texts = docs.select(whole_text(text_col).alias("text"))
    share = min(1.0, opts.sample_docs / max(1, texts.count()))
    place = F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53)
    most = dict.fromkeys(TYPES, opts.sample_kind) | {"none": opts.sample_islands}

    def smallest(found: set[str], n: int) -> set[str]:
        return set(sorted(found, key=lambda x: (zlib.crc32(x.encode()), x))[:n])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = {kind: set() for kind in most}
        for b in batches:
            for text, asked in zip(b["text"], b["asked"]):
                for s, e in islands(text):
                    if e - s > 20 * opts.island_tokens:
                        continue
                    island = text[max(0, s - 1):e + 1]
                    for kind in {k for _, _, k in base_spans(island)} or ({"none"} if asked else ()):
                        taken[kind].add(island)
                        if len(taken[kind]) > 4 * most[kind] + 100:
                            taken[kind] = smallest(taken[kind], most[kind])
        rows = [(kind, x) for kind, found in taken.items() for x in smallest(found, most[kind])]
        yield pd.DataFrame(rows, columns=["kind", "island"])

    first = Window.partitionBy("kind").orderBy(F.crc32("island"), "island")
    limit = F.when(F.col("kind") == "none", opts.sample_islands).otherwise(opts.sample_kind)
    return (texts.select("text", (place < share).alias("asked")).mapInPandas(read, "kind string, island string").distinct()
            .withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit).drop("n"))


def fit(docs: DataFrame, text_col: str = "text", opts: CrfOptions = CrfOptions()) -> dict[str, list[float]]:
    """Weights learned from a bounded sample of islands by kind, in one Spark group."""
    sample = written(sample_of(docs, text_col, opts).select("island").distinct(), "crf-sample")

    def learn(g: pd.DataFrame) -> pd.DataFrame:
        weights = train([x for x in sorted(g["island"]) if len(TOKEN.findall(x)) <= opts.island_tokens], opts)
        return pd.DataFrame({"feature": list(weights), "weights": list(weights.values())})

    rows = (sample.groupBy(F.lit(1).alias("all")).applyInPandas(learn, "feature string, weights array<double>").collect())
    return {r["feature"]: r["weights"] for r in rows}


def personal_spans(docs: DataFrame, weights: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text",
                   opts: CrfOptions = CrfOptions()) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)     # features of a bounded sample
    names = [f"n_{t}" for t in TYPES] + ["base_sha256", "spans"]

    def listed(spans) -> str:
        return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)

    @F.pandas_udf(", ".join(f"n_{t} bigint" for t in TYPES) + ", base_sha256 string, spans string")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        field = Field(shared.value, opts)
        for series in texts:
            rows = []
            for text in series:
                spans = find_spans(text, field)
                base = [x for x in spans if x[2] in TYPES]
                n = Counter(x[2] for x in base)
                rows.append((*(n[t] for t in TYPES), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col(id_col).alias("doc_id"), read(whole_text(text_col)).alias("r")).select("doc_id", "r.*")
