"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes its set of word shingles (as 64-bit hashes) and a MinHash signature whose
   bands are hashed. Texts with equal sets form a class; only class representatives go on.
2. Representatives that share a band are candidates. Small buckets are compared pair by pair. The
   members of a large bucket are first compared with its pivot; buckets of one group of near copies
   mostly share their pivots, and all members that have a pivot in common form a family. Where a
   family is not one component by then, its members outside the largest component are compared with
   all others, block against block inside tasks, and only links that join components are written.
   So every pair of candidates is either compared or already connected, and none is written out.
3. A candidate pair is read signature batch by signature batch. After n hashes with m agreements
   the similarity has the posterior Beta(m + 1, n - m + 1); the pair is dropped as soon as
   P(similarity >= threshold) falls under the chosen miss probability.
4. Survivors are verified exactly on the full shingle sets. Verified links are joined into
   components, whose smallest id is the one to keep.

Defined results: null or empty text and text without words has an empty set and links with
nothing; with fewer words than the shingle size the whole sequence is one shingle; a null id comes
after all others; rows that repeat an id are rows of their own with the same id. Only the id and
text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_lookup
from .common import free_name, text_rows, whole_text, written
from .components import connected_components


@dataclass(frozen=True)
class MinHashOptions:
    words: int = 5                 # words in a shingle
    percent: int = 75              # links: 100 * intersection >= percent * union
    bands: int = 40
    rows: int = 5                  # hashes in a band; at similarity 0.75 a pair is missed with 2e-5
    batch: int = 25                # hashes compared between two looks at the posterior
    miss: float = 1e-6             # posterior probability under which a pair is dropped
    small_bucket: int = 8          # buckets up to this size are compared pair by pair
    block: int = 256               # members of a family compared at once


BLOCK = 1 << 20                    # bytes of a text hashed at once


@lru_cache(maxsize=8)
def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
    data = text.encode("utf-8").lower()          # on bytes this changes A-Z only
    out, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > BLOCK:                     # cut after the first white space past the block
            tail = np.frombuffer(data, np.uint8, offset=at + BLOCK)
            cut = 0
            while cut < len(tail) and not (gap := _IS_SPACE[tail[cut:cut + BLOCK]]).any():
                cut += BLOCK
            if cut < len(tail):
                end = at + BLOCK + cut + int(gap.argmax()) + 1
        buf = np.frombuffer(data, np.uint8, count=end - at, offset=at)
        at = end
        inside = ~_IS_SPACE[buf]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, lengths = edge[::2], edge[1::2] - edge[::2]
        if not len(starts):
            continue
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = np.arange(len(first)) - first
        weight = _constants(1 << 16, 5)[place & 0xFFFF]
        if place.max() >> 16:                    # very long words: a factor of their own for each 64 KB
            weight = weight * (2 * (place >> 16) + 1).astype(np.uint64)
        values = (buf[inside].astype(np.uint64) + np.uint64(1)) * weight
        sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
        out.append(_mix(sums + lengths.astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    weight = _constants(64 + words, 11)
    total = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        total += w[k:len(w) - n + 1 + k] * weight[k]
        total = _mix(total)
    return np.unique(total)


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash signature: ``hashes`` 32-bit minima."""
    scale, shift = _constants(hashes, 17)[:, None], _constants(hashes, 19)[:, None]
    low = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        low = np.minimum(low, (shingles[None, at:at + 512] * scale + shift).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4")


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(bands, rows).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return total.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(opts: MinHashOptions) -> list[tuple[int, int]]:
    """``(hashes read, fewest agreements that keep a pair)`` for each look at the posterior.

    The Beta(m + 1, n - m + 1) mass above t equals P(Binomial(n + 1, t) <= m).
    """
    t, out = opts.percent / 100, []
    for n in [*range(opts.batch, opts.bands * opts.rows, opts.batch), opts.bands * opts.rows]:
        mass = 0.0
        for m in range(n + 1):
            mass += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if mass >= opts.miss:
                out.append((n, m))
                break
    return out


def plausible(a: np.ndarray, b: np.ndarray, opts: MinHashOptions, i: np.ndarray | None = None,
              j: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of signature rows (``a[i]`` with ``b[j]``) survive the sequential test."""
    i, j = (np.arange(len(a)), np.arange(len(b))) if i is None else (i, j)
    alive, matches, seen = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for n, least in least_matches(opts):
        matches[alive] += (a[i[alive], seen:n] == b[j[alive], seen:n]).sum(axis=1)
        alive, seen = alive[matches[alive] >= least], n
    keep = np.zeros(len(i), bool)
    keep[alive] = True
    return keep


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on full sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def shingled(rows: DataFrame, opts: MinHashOptions) -> DataFrame:
    """``row_key, doc_id, n_shingles, set_a, set_b, bands``: sets as a size and two sums, banded."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, one, two, bands = [], [], [], []
            for text in b.pop("text"):
                s = shingle_set(text, opts.words)
                n.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(_mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64)))
                bands.append(band_hashes(signature(s, opts.bands * opts.rows), opts.bands, opts.rows)
                             if len(s) else np.empty(0, np.int64))
            yield b.assign(n_shingles=n, set_a=one, set_b=two, bands=bands)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(read, f"row_key bigint, doc_id {id_type}, n_shingles bigint, set_a bigint, "
                                  "set_b bigint, bands array<bigint>")


def _prints(rows: DataFrame, opts: MinHashOptions) -> DataFrame:
    """``node, sig, text`` of candidate rows."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(sig=[signature(shingle_set(t, opts.words), opts.bands * opts.rows).tobytes()
                                for t in b["text"]])

    return rows.mapInPandas(read, "node bigint, text string, sig binary")


def _survivors(pairs: DataFrame, prints: DataFrame, opts: MinHashOptions) -> DataFrame:
    """Candidate pairs ``a, b`` that the sequential test keeps."""
    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                one, two = (np.frombuffer(b"".join(p[c]), "<u4").reshape(len(p), -1) for c in ("sig_a", "sig_b"))
                yield p.loc[plausible(one, two, opts), ["a", "b"]]

    def sig(end: str) -> DataFrame:
        return prints.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}"))

    return pairs.join(sig("a"), "a").join(sig("b"), "b").mapInPandas(test, "a bigint, b bigint")


def _verified(pairs: DataFrame, prints: DataFrame, opts: MinHashOptions) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}

        def of(node: int, text: str) -> np.ndarray:
            if node not in known:
                if len(known) >= 64:
                    known.clear()
                known[node] = shingle_set(text, opts.words)
            return known[node]

        for p in batches:
            keep = [linked(of(a, x), of(b, y), opts.percent)
                    for a, x, b, y in zip(p["a"], p["text_a"], p["b"], p["text_b"])]
            yield p.loc[np.array(keep, bool), ["a", "b"]]

    def text(end: str) -> DataFrame:
        return prints.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))

    return pairs.join(text("a"), "a").join(text("b"), "b").mapInPandas(test, "a bigint, b bigint")


def _in_order(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def near_links(members: DataFrame, prints: DataFrame, opts: MinHashOptions) -> DataFrame:
    """``node, label``: components of the representatives, from the buckets (``bucket, node, size, pivot``) they share."""
    small = members.where(F.col("size") <= opts.small_bucket).select("bucket", "node")
    families = written(members.where(F.col("size") > opts.small_bucket).select("pivot", "node").distinct(), "families")
    other = small.select("bucket", F.col("node").alias("other"))
    pairs = (small.join(other, "bucket").where("node < other").select("node", "other")
             .union(families.where("node <> pivot").select("node", "pivot")))
    kept = written(_survivors(_in_order(pairs, "node", "other"), prints, opts), "survivors")
    links = written(_verified(kept, prints, opts), "links")
    labels = written(connected_components(links), "labels")
    return connected_components(links.union(_family_links(families, labels, prints, opts)))


def _family_links(families: DataFrame, labels: DataFrame, prints: DataFrame, opts: MinHashOptions) -> DataFrame:
    """Links ``a, b`` that join components inside families.

    A family is cut into blocks, those of its largest component apart from the rest. A block of the rest
    meets every block; blocks of the largest component do not meet each other.
    """
    rows = families.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = rows.groupBy("pivot", "label").agg(F.count(F.lit(1)).alias("n"))
    open_ = (sizes.groupBy("pivot").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("total"))
             .where("total > top.n"))
    rest_blocks = F.ceil((F.col("total") - F.col("top.n")) / opts.block).cast("int")
    top_blocks = F.ceil(F.col("top.n") / opts.block).cast("int")
    u, is_top = F.xxhash64("node"), F.col("label") == F.col("top.label")
    # a family may hold a large share of all rows: its rows are salted, the one row about it is replicated
    met = (salted_lookup(rows, open_, ["pivot"], ["node"], 16)
           .withColumn("own", F.when(is_top, rest_blocks + F.pmod(u, top_blocks)).otherwise(F.pmod(u, rest_blocks)).cast("int"))
           .withColumn("meets", F.explode(F.sequence(F.lit(0), rest_blocks - 1 + F.when(is_top, 0).otherwise(top_blocks))))
           .select("pivot", "node", "label", "own", F.least("own", "meets").alias("low"),
                   F.greatest("own", "meets").alias("high"))
           .join(prints, "node"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node")
        sig = np.frombuffer(b"".join(g["sig"]), "<u4").reshape(len(g), -1)
        node, label, text = g["node"].to_numpy(), g["label"].to_numpy(), g["text"].to_list()
        in_low = (g["own"] == g["low"]).to_numpy()
        one = bool((g["low"] == g["high"]).all())
        left, right = np.flatnonzero(in_low), np.flatnonzero(in_low if one else ~in_low)
        root = {x: x for x in label.tolist()}
        sets: dict[int, np.ndarray] = {}
        out = []

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_set(text[k], opts.words)
            return sets[k]

        for at in range(0, len(left), 32):
            i, j = (x.ravel() for x in np.meshgrid(left[at:at + 32], right, indexing="ij"))
            differ = (label[i] != label[j]) & ((i < j) if one else True)
            i, j = i[differ], j[differ]
            keep = plausible(sig, sig, opts, i, j)
            for x, y in zip(i[keep].tolist(), j[keep].tolist()):
                a, b = find(label[x]), find(label[y])
                if a != b and linked(of(x), of(y), opts.percent):
                    root[max(a, b)] = min(a, b)
                    out.append((min(node[x], node[y]), max(node[x], node[y])))
        return pd.DataFrame(out, columns=["a", "b"])

    return met.groupBy("pivot", "low", "high").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    opts: MinHashOptions = MinHashOptions()) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``, and ``row_key``."""
    return _near_rows(written(text_rows(docs, id_col, text_col), "rows", "zstd"), opts)


def _near_rows(rows: DataFrame, opts: MinHashOptions) -> DataFrame:
    """``near_duplicates`` of a written table ``row_key, doc_id, text``: every scan sees the same keys."""
    shingles = written(shingled(rows, opts), "shingles")
    same = ["n_shingles", "set_a", "set_b"]
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    classes = written(
        shingles.where("n_shingles > 0").groupBy(*same)
        .agg(F.min(order).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
        .select(*same, F.col("rep.row_key").alias("node"), F.col("rep.doc_id").alias("rep_id"), "copies", "bands"),
        "classes")
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    # the pivot is the member lowest in one order of all nodes, so that buckets share their pivots
    shared = (banded.groupBy("bucket")
              .agg(F.count(F.lit(1)).alias("size"),
                   F.min(F.struct(F.xxhash64("node").alias("u"), "node")).alias("low"))
              .where("size > 1").select("bucket", "size", F.col("low.node").alias("pivot")))
    members = written(banded.join(shared, "bucket"), "members")
    candidates = members.select("node").distinct()
    prints = written(_prints(rows.select(F.col("row_key").alias("node"), "text")
                             .join(candidates, "node", "left_semi"), opts), "prints")
    labels = near_links(members, prints, opts)
    # a component's id is its smallest document id
    reps = classes.select("node", "rep_id", "copies", *same).join(labels, "node", "left")
    first = F.struct(F.col("rep_id").isNull().alias("no_id"), F.col("rep_id").alias("id"), F.col("node").alias("key"))
    tops = (reps.where("label is not null").groupBy("label").agg(F.min(first).alias("top")))
    resolved = (reps.where("label is not null").join(tops, "label").select(*same, "top")
                .unionByName(reps.where("label is null and copies > 1")
                             .select(*same, first.alias("top"))))
    out = shingles.select("row_key", "doc_id", *same).join(resolved, same, "left")
    alone = F.col("top").isNull()
    return out.select(
        "doc_id", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.id")).alias("component_id"),
        (alone | (F.col("row_key") == F.col("top.key"))).alias("kept"), "row_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     opts: MinHashOptions = MinHashOptions()) -> DataFrame:
    """``docs`` with one row of each group of near copies (that of the smallest id), all columns unchanged."""
    key = free_name(docs, "__row_key")
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed", "zstd")
    rows = keyed.select(F.col(key).alias("row_key"), F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    gone = _near_rows(rows, opts).where("not kept").select(F.col("row_key").alias(key))
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
