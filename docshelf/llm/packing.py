"""Lexical retrieval packing of documents into training sequences.

Every document is tokenised whole and closed with token 0. Its full windows are sequences of their own;
what remains is a tail shorter than a window. Tails are packed by lexical retrieval:

* document frequencies of tokens and the mean tail length are computed over all tails (at most one
  row per vocabulary entry comes to the driver);
* tails are routed into shards by their most telling tokens (highest BM25 weight), as a range
  partition that row keys split further, so that a common routing token is no hot shard;
* each shard holds a BM25 inverted index of its tails. A seed retrieves its best unused neighbours,
  which fill its window greedily; the last one is cut, and its rest is the next seed.

What is left at the end of a partition is cut into sequences whose lengths are powers of two, so no
sequence needs padding.

Defined results: null text counts as empty and is packed as the single token 0; rows that repeat an
id are packed one by one; an empty table gives no pieces; other columns are not read. Very long texts, runs of
white space or of one character among them, are read whole.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows, tokenizer_path, written
from .token_counts import _Spec, byte_symbols


@dataclass(frozen=True)
class PackingOptions:
    window: int = 1024
    shard: int = 1024              # tails in one inverted index
    k1: float = 1.2
    b: float = 0.75


# Fixed value: how the tokenizer file cuts text before merging (contractions, words, digits, signs, space).
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

_ENCODERS: dict[str, object] = {}


def encoder(spec: _Spec):
    """Byte-level BPE of a tokenizer file; its ids are merge ranks, as tiktoken needs them."""
    if spec.id not in _ENCODERS:
        import tiktoken

        model = json.loads(spec.value)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in text): token for text, token in model["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        _ENCODERS[spec.id] = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[spec.id]


def token_ids(text: str, enc, spec: _Spec) -> np.ndarray:
    """Ids of a whole text (special strings as in the tokenizer's default) and the closing 0.

    White space of half a million characters or more is beyond the backtracking of the fast encoder's
    pattern; such a text is read by the tokenizer library itself.
    """
    try:
        ids = enc.encode(text, allowed_special="all")
    except ValueError:
        from tokenizers import Tokenizer

        ids = Tokenizer.from_str(spec.value).encode(text, add_special_tokens=False).ids
    return np.array(ids + [0], dtype="<u4")


def tokenised(rows: DataFrame, spec: _Spec, opts: PackingOptions) -> DataFrame:
    """``row_key, doc_id, doc_tokens, full (checksums of the full windows), tail (16-bit ids)``."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(spec)
        for b in batches:
            n, full, tail = [], [], []
            for text in b.pop("text"):
                ids = token_ids(text, enc, spec)
                cut = len(ids) // opts.window * opts.window
                n.append(len(ids))
                full.append([zlib.crc32(ids[i:i + opts.window].tobytes()) for i in range(0, cut, opts.window)])
                tail.append(ids[cut:].astype("<u2").tobytes())
            yield b.assign(doc_tokens=n, full=full, tail=tail)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(read, f"row_key bigint, doc_id {id_type}, doc_tokens bigint, full array<bigint>, tail binary")


def tail_statistics(tails: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency by token id, number of tails and their mean length, over all tails."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << 16, np.int64)
        for b in batches:
            for tail in b["tail"]:
                seen[np.unique(np.frombuffer(tail, "<u2"))] += 1
        token = np.flatnonzero(seen)
        yield pd.DataFrame({"token": token, "n": seen[token]})

    frequency = np.zeros(1 << 16, np.int64)
    for r in (tails.select("tail").mapInPandas(count, "token int, n bigint")
              .groupBy("token").agg(F.sum("n").alias("n")).collect()):      # at most one row per vocabulary entry
        frequency[r["token"]] = r["n"]
    n, length = tails.agg(F.count(F.lit(1)), F.sum(F.octet_length("tail"))).first()
    return frequency, n, (length or 0) / 2 / max(n, 1)


def inverse_frequency(frequency: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - frequency + 0.5) / (frequency + 0.5))


def bm25_weights(tf: np.ndarray, length, mean: float, opts: PackingOptions) -> np.ndarray:
    return tf * (opts.k1 + 1) / (tf + opts.k1 * (1 - opts.b + opts.b * length / mean))


class ShardIndex:
    """BM25 inverted index of some tails."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float, opts: PackingOptions):
        lengths = np.array([len(t) for t in tails])
        doc = np.repeat(np.arange(len(tails)), lengths)
        keys, tf = np.unique(np.concatenate(tails).astype(np.int64) << 32 | doc, return_counts=True)
        token, self.doc = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int64)
        self.weight = bm25_weights(tf, lengths[self.doc], mean, opts) * idf[token]
        self.first = np.searchsorted(token, np.arange((1 << 16) + 1))
        self.n = len(tails)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Score of every tail for the tokens of a query."""
        terms = np.unique(query)
        start, lengths = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.repeat(start - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


class Packer:
    """Fills windows from one shard after another; an unfinished window is carried over."""

    def __init__(self, idf: np.ndarray, mean: float, opts: PackingOptions, sequence: int):
        self.idf, self.mean, self.opts, self.sequence = idf, mean, opts, sequence
        self.open: list[tuple] = []          # (row, start, ids) of the window being filled
        self.free = opts.window
        self.seed: np.ndarray | None = None
        self.pieces: list[tuple] = []

    def put(self, row: int, start: int, ids: np.ndarray) -> tuple[int, np.ndarray]:
        """Place as much of a piece as fits; the rest comes back."""
        used = ids[:self.free]
        self.open.append((row, start, used))
        self.free -= len(used)
        if self.seed is None:
            self.seed = ids
        if not self.free:
            self.close()
        return start + len(used), ids[len(used):]

    def close(self) -> None:
        offset = 0
        for (row, doc_id, n), start, ids in self.open:
            self.pieces.append((row, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n,
                                self.sequence, offset))
            offset += len(ids)
        self.sequence += 2
        self.open, self.free, self.seed = [], self.opts.window, None

    def fill(self, rows: list[tuple], starts: list[int], tails: list[np.ndarray]) -> None:
        """Pack all tails of a shard."""
        index, unused, rest = ShardIndex(tails, self.idf, self.mean, self.opts), np.ones(len(tails), bool), None
        todo = 0
        while True:
            if rest is not None:                           # a cut neighbour is the next seed
                row, start, ids = rest
                start, ids = self.put(row, start, ids)
                rest = (row, start, ids) if len(ids) else None
                continue
            if self.seed is None:
                while todo < len(tails) and not unused[todo]:
                    todo += 1
                if todo == len(tails):
                    return
                unused[todo] = False
                rest = (rows[todo], starts[todo], tails[todo])
                continue
            if not unused.any():
                return
            score = np.where(unused, index.scores(self.seed), -1.0)
            few = min(16, len(tails))
            best = np.argpartition(-score, few - 1)[:few]
            for i in best[np.argsort(-score[best], kind="stable")]:
                if not unused[i]:
                    break
                unused[i] = False
                start, ids = self.put(rows[i], starts[i], tails[i])
                if len(ids):
                    rest = (rows[i], start, ids)
                if self.seed is None:                      # the window is full
                    break

    def finish(self) -> None:
        """Cut the last open window into lengths that are powers of two."""
        left, self.open = self.open, []
        total = sum(len(ids) for _, _, ids in left)
        while total:
            self.free = 1 << (total.bit_length() - 1)
            total -= self.free
            while self.free != self.opts.window and left:
                row, start, ids = left.pop(0)
                start, ids = self.put(row, start, ids)
                if len(ids):
                    left.insert(0, (row, start, ids))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
         opts: PackingOptions = PackingOptions()) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    spec = _Spec(spark, path or tokenizer_path("byte_bpe_50k.json"))
    tokens = written(tokenised(text_rows(docs, id_col, text_col), spec, opts), "tokens")
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    full = (tokens.select("doc_id", "doc_tokens", F.posexplode("full").alias("k", "ids_crc32"))
            .select("doc_id", (F.col("k") * F.lit(opts.window).cast("bigint")).alias("start"),
                    F.lit(opts.window).cast("bigint").alias("length"), "ids_crc32", "doc_tokens",
                    (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
    tails = tokens.where(F.octet_length("tail") > 0).select("row_key", "doc_id", "doc_tokens", "tail")
    frequency, n, mean = tail_statistics(tails)
    idf = spark.sparkContext.broadcast(inverse_frequency(frequency, n))     # 2**16 numbers

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            telling = []
            for tail in b["tail"]:
                token, tf = np.unique(np.frombuffer(tail, "<u2"), return_counts=True)
                weight = bm25_weights(tf, len(tail) / 2, mean, opts) * idf.value[token]
                best = token[np.argsort(-weight, kind="stable")[:2]].tolist()
                telling.append((best + best)[:2])
            yield b.assign(one=[x[0] for x in telling], two=[x[1] for x in telling])

    routed = tails.mapInPandas(route, f"row_key bigint, doc_id {id_type}, doc_tokens bigint, tail binary, one int, two int")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (32 * opts.shard) + 1)
    columns = ["row_key", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(idf.value, mean, opts, TaskContext.get().partitionId() << 34 | 1)
        for b in batches:
            for at in range(0, len(b), opts.shard):
                s = b.iloc[at:at + opts.shard]
                ids = [np.frombuffer(t, "<u2") for t in s["tail"]]
                rows = list(zip(s["row_key"], s["doc_id"], s["doc_tokens"]))
                packer.fill(rows, [r[2] - len(t) for r, t in zip(rows, ids)], ids)
            yield pd.DataFrame(packer.pieces, columns=columns)
            packer.pieces = []
        packer.finish()
        yield pd.DataFrame(packer.pieces, columns=columns)

    packed = written(routed.repartitionByRange(parts, "one", "two", "row_key").sortWithinPartitions("one", "two", "row_key")
                     .mapInPandas(fill, f"row_key bigint, doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, "
                                        "doc_tokens bigint, sequence_id bigint, offset bigint"), "packed")
    return full.unionByName(packed.drop("row_key"))
