"""Terms of a few thousand documents at a time, as compressed columns.

One row per distinct term of each document is many times the text. What has to meet the other documents'
terms is therefore shuffled block by block: a block's terms are dealt to ``parts`` by a hash of the term, and
a row ``(block, part)`` holds each distinct term once with the documents that have it and how often. A part
holds all rows of its terms, so per-term facts are made, and read, inside one task for many terms at once.
Most of a row are the terms, which are nearly sorted: each leaves out the bytes that it begins with like the one before it.

``term_blocks`` is the counterpart of :func:`docshelf.operators.tokens.doc_terms`: the same occurrences, packed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .tokens import tokens

# What a block holds at most; a longer document is a block of its own.
BLOCK_ROWS = 2048
BLOCK_TOKENS = 1 << 20
HASHED_TERMS = 1 << 15      # terms whose parts are found at once

BLOBS = ["lengths", "chars", "df", "docs", "tf"]
FIELDS = [StructField("part", IntegerType()), StructField("n_terms", IntegerType()), StructField("n_occ", IntegerType()),
          *[StructField(c, BinaryType()) for c in BLOBS]]


# Bytes that a term leaves out at most.
MOST_SHARED = 31


def pack(values: np.ndarray) -> bytes:
    """Whole numbers with all their lowest bytes first, as the high ones are mostly alike; others as they are."""
    whole = np.ascontiguousarray(values).reshape(-1, 1).view(np.uint8)
    return pa.compress((whole.T if values.dtype.kind in "iu" else whole).tobytes(), codec="zstd", asbytes=True)


def unpack(blob, dtype, n: int) -> np.ndarray:
    dtype = np.dtype(dtype)
    whole = np.frombuffer(pa.decompress(blob, n * dtype.itemsize, codec="zstd", asbytes=True), np.uint8)
    if dtype.kind in "iu":
        whole = np.ascontiguousarray(whole.reshape(dtype.itemsize, n).T)
    return whole.reshape(-1).view(dtype)


def _pieces(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the bytes of pieces, one piece after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def pack_terms(terms: pa.Array) -> tuple[bytes, bytes]:
    """Lengths and characters of an array of strings."""
    n = len(terms)
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset:terms.offset + n + 1].astype(np.int64)
    starts, lengths = ends[:-1], np.diff(ends)
    chars = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
    most, shared = np.minimum(np.minimum(lengths[1:], lengths[:-1]), MOST_SHARED), np.zeros(n, np.int64)
    same = np.arange(1, n)      # the terms that are like the one before them so far
    for k in range(MOST_SHARED):
        same = same[most[same - 1] > k]
        same = same[chars[starts[same] + k] == chars[starts[same - 1] + k]]
        if not len(same):
            break
        shared[same] += 1
    own = lengths - shared
    return pack(np.concatenate([shared, own]).astype(np.uint32)), pack(chars[_pieces(starts + shared, own)])


def unpack_terms(lengths, chars, n: int) -> pa.Array:
    shared, own = unpack(lengths, np.uint32, 2 * n).astype(np.int64).reshape(2, n)
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(shared + own, out=ends[1:])
    starts, text = ends[:-1].astype(np.int64), np.empty(int(ends[-1]), np.uint8)
    text[_pieces(starts + shared, own)] = unpack(chars, np.uint8, int(own.sum()))
    for k in range(int(shared.max(initial=0))):
        left_out = shared > k
        giver = np.maximum.accumulate(np.where(left_out, 0, np.arange(n)))      # the last term that has this byte itself
        at = np.flatnonzero(left_out)
        text[starts[at] + k] = text[starts[giver[at]] + k]
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(text))


def _blocks(batch: pa.RecordBatch, toks: pa.Array) -> Iterator[tuple[int, int]]:
    """``(start, rows)`` of the blocks of a batch."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        fits = int(np.searchsorted(ends, before + BLOCK_TOKENS, "right"))
        to = min(at + BLOCK_ROWS, max(fits, at + 1), batch.num_rows)
        yield at, to - at
        at = to


def _occurrences(toks: pa.Array, ngram_range: tuple[int, int]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``terms, df, row, tf``: distinct terms, rows per term, and the rows with their counts, term after term."""
    flat, row = toks.flatten(), pc.list_parent_indices(toks).to_numpy().astype(np.int64)
    encoded = flat.dictionary_encode()
    order = pc.sort_indices(encoded.dictionary)
    words, n_words = encoded.dictionary.take(order), len(order)
    rank = np.empty(n_words, np.int64)
    rank[order.to_numpy()] = np.arange(n_words)
    word = rank[encoded.indices.to_numpy()]
    gram, names, base, rows, codes, terms = word, words, 0, [], [], []
    for n in range(1, ngram_range[1] + 1):
        if n > 1:       # the n-gram from a token on: its (n-1)-gram and one more word
            kept, gram = np.unique(gram[:-1] * n_words + word[n - 1:], return_inverse=True)
            names = pc.binary_join_element_wise(names.take(pa.array(kept // max(n_words, 1))),
                                                words.take(pa.array(kept % max(n_words, 1))), pa.scalar(" ", words.type))
        if n >= ngram_range[0]:
            inside = row[:len(gram)] == row[n - 1:]     # all n tokens are of one row
            rows.append(row[:len(gram)][inside])
            codes.append(gram[inside] + base)
            terms.append(names)
            base += len(names)
    n_rows = max(len(toks), 1)
    pairs, tf = np.unique(np.concatenate(codes) * n_rows + np.concatenate(rows), return_counts=True)
    used, df = np.unique(pairs // n_rows, return_counts=True)
    return pa.concat_arrays(terms).take(pa.array(used)), df, pairs % n_rows, tf


def _part_of(terms: pa.Array, parts: int) -> np.ndarray:
    """By a hash of the term; some terms at a time, as each becomes an object."""
    part = np.empty(len(terms), np.int32)
    for a in range(0, len(terms), HASHED_TERMS):
        some = terms.slice(a, HASHED_TERMS).to_numpy(zero_copy_only=False)
        part[a:a + HASHED_TERMS] = pd.util.hash_array(some, categorize=False) % parts
    return part


def _packer(n_keep: int, ngram_range: tuple[int, int], parts: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in _blocks(whole, whole.column(n_keep)):
                block = whole.slice(at, n)
                terms, df, row, tf = _occurrences(block.column(n_keep), ngram_range)
                if not len(terms):
                    continue
                part = _part_of(terms, parts)
                order = np.argsort(part, kind="stable")
                terms, starts, df = terms.take(pa.array(order)), (np.cumsum(df) - df)[order], df[order]
                ends = np.cumsum(df)
                at_occ = np.repeat(starts - (ends - df), df) + np.arange(len(row))
                row, tf = row[at_occ], tf[at_occ]
                held, first = np.unique(part[order], return_index=True)
                out, kept = [], []
                for p, a, b in zip(held, first, [*first[1:], len(terms)]):
                    lo, hi = int(ends[a] - df[a]), int(ends[b - 1])
                    docs, local = np.unique(row[lo:hi], return_inverse=True)
                    kept.append(docs)
                    steps, new = np.diff(local, prepend=0), ends[a:b] - df[a:b] - lo
                    steps[new] = local[new]     # a term's first document, then how far it is to the next
                    out.append((int(p), int(b - a), hi - lo, *pack_terms(terms.slice(a, b - a)), pack(df[a:b].astype(np.uint16)),
                                pack(steps.astype(np.uint16)), pack(tf[lo:hi].astype(np.uint32))))
                ends = np.cumsum([0, *map(len, kept)])
                docs = pa.array(np.concatenate(kept))
                cols = [pa.array([o[k] for o in out], t) for k, t in enumerate([pa.int32()] * 3 + [pa.binary()] * 5)]
                cols += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), block.column(k).take(docs)) for k in range(n_keep)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def term_blocks(df: DataFrame, keep: list[str], text_col: str, parts: int, ngram_range: tuple[int, int] = (1, 2),
                stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """``part, n_terms, n_occ, lengths, chars, df, docs, tf, *keep``: the occurrences of a block's terms, per part.

    ``keep`` columns become arrays with one entry for each document that the row names by its place in them.
    """
    step = df.select(*keep, tokens(text_col, stop_words).alias("_tok"))
    kept = [StructField(f.name, ArrayType(f.dataType)) for f in step.schema.fields[:-1]]
    schema = StructType([*FIELDS, *kept])
    return step.mapInArrow(_packer(len(keep), ngram_range, parts, schema.names), schema)


class Block:
    """One row of :func:`term_blocks`."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.batch, self.i = batch, i
        self.n_terms, self.n_occ = self.value("n_terms"), self.value("n_occ")

    def value(self, name: str):
        return self.batch.column(name)[self.i].as_py()

    def kept(self, name: str) -> pa.Array:
        return self.batch.column(name)[self.i].values

    def numbers(self, name: str) -> np.ndarray:
        """A column of numbers, 0 where it is null, as sums take it."""
        return pc.fill_null(self.kept(name), 0).to_numpy(zero_copy_only=False).astype(np.float64)

    def terms(self) -> pa.Array:
        return unpack_terms(self.value("lengths"), self.value("chars"), self.n_terms)

    def counts(self) -> np.ndarray:
        return unpack(self.value("tf"), np.uint32, self.n_occ)

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``term, doc, tf weight``: places in the block's terms and documents, and 1 + ln(tf)."""
        df = unpack(self.value("df"), np.uint16, self.n_terms).astype(np.int64)
        steps = unpack(self.value("docs"), np.uint16, self.n_occ).astype(np.int64)
        doc, new = np.cumsum(steps), np.cumsum(df) - df
        return np.repeat(np.arange(self.n_terms), df), doc - np.repeat(doc[new] - steps[new], df), 1.0 + np.log(self.counts())


def by_part(packed: DataFrame, parts: int) -> DataFrame:
    """Each part's rows in a partition of their own: a task reads one part, whatever their number."""
    return packed.repartitionById(parts, "part").sortWithinPartitions("part")


def whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Block]]]:
    """``part, its blocks`` of a partition of :func:`by_part`."""
    at, held = None, []
    for b in batches:
        for i, part in enumerate(b.column("part").to_pylist()):
            if part != at and held:
                yield at, held
                held = []
                pa.default_memory_pool().release_unused()
            at = part
            held.append(Block(b, i))
    if held:
        yield at, held
    pa.default_memory_pool().release_unused()      # the process is used again


def dictionary(blocks: list[Block]) -> tuple[pa.Array, list[np.ndarray]]:
    """Distinct terms of a part, and for each block the place of its terms among them."""
    encoded = pa.concat_arrays([b.terms() for b in blocks]).dictionary_encode()
    ends = np.cumsum([b.n_terms for b in blocks])
    return encoded.dictionary, np.split(encoded.indices.to_numpy(), ends[:-1])
