"""Token counts by compiled finite-state transducers.

Two deterministic transducers are compiled from a word-level BPE tokenizer file:

* the *word transducer* reads characters and cuts pre-tokens (contractions, letter runs, single
  digits, runs of other signs); white space resets it to its start state;
* the *piece transducer* reads the bytes of one pre-token. A state holds, for every suffix of what
  was read that can still begin a vocabulary entry, the last piece before that suffix and the
  difference in pieces emitted. A transition carries the number of pieces it adds (negative when
  the byte lets earlier pieces merge). States are built when first reached and interned.

BPE is finite state because the last piece of every prefix is unique: it is the one entry that ends
there and cannot merge across the boundary with the piece before it.

Texts are cut into chunks. A chunk's state map is known without its start state up to its first
reset: ``(head, count, tail)`` -- the characters before the first white space, the pieces between,
and the characters after the last. A chunk without ASCII white space is closed at special strings,
digits, and ideographic punctuation before a letter instead. Maps compose associatively: a tail joins the next head. The
joins ("seams") of all chunks are found by a prefix sum over the closed chunks and counted in
parallel. Only a run with none of these resets (one long word, say) is read in one piece.

Defined results: null and empty text have 0 tokens; rows that repeat an id are counted one by one;
special strings inside a text count as one token each, as in the tokenizer's default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of, text_rows, tokenizer_path, written

CHUNK_CHARS = 8192
STATE_LIMIT = 200_000     # interned states per Python worker; beyond it the lazy tables start anew
WORD_LIMIT = 400_000      # remembered words, and pre-tokens, per Python worker
INFINITE = 1 << 60

# Fixed value: the white space characters (Unicode White_Space) at which pre-tokens end.
WHITE_SPACE = set("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
# Fixed value: contraction endings that form a pre-token after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# Fixed value: places inside a run without ASCII white space at which a pre-token surely ends, whatever is around
# (a digit is a pre-token of its own; a letter never continues punctuation, nor composes with it).
SURE = "(?<=[0-9])|(?<=[\u3000\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[^\\W_])"
SIGNS = set(".,;:!?()\"%*$-")       # signs that are neither white space nor an apostrophe
ASCII_SPACE = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Transducers:
    """The compiled word and piece transducers of one tokenizer file."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab, suffix = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials))) or r"(?!)")
        self.sure = re.compile(rf"{self.special.pattern}|{SURE}")
        symbols = byte_symbols()
        #: token of byte b, and at 256 + b of byte b at the end of a word
        self.base = [vocab[s] for s in symbols] + [vocab[s + suffix] for s in symbols]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, (left, right) in enumerate(model["model"]["merges"]):
            token = vocab[left + right]
            self.rank[vocab[left], vocab[right]] = rank
            self.parts[token], self.born[token] = (vocab[left], vocab[right]), rank
        self._trie(vocab, suffix, {s: b for b, s in enumerate(symbols)})
        self.classes: dict[str, str] = {}
        self.words: dict[str, int] = {"": 0}
        self.pre_counts: dict[str, int] = {}
        self._reset()

    def _trie(self, vocab: dict[str, int], suffix: str, byte_of: dict[str, int]) -> None:
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for text, token in vocab.items():
            if token not in self.parts and token not in self.base:
                continue
            body = text[: -len(suffix)] if text.endswith(suffix) else text
            path = [byte_of[c] for c in body]
            if body != text:
                path[-1] += 256
            if token in self.parts and not self._stands_alone(token):
                continue
            node = 0
            for s in path:
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.token_at.append(-1)
                node = self.child[node][s]
            self.token_at[node] = token

    def _spine(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """Sub-pieces at one edge of ``token``, each with the rank at which it merges away."""
        dies = INFINITE
        while True:
            yield token, dies
            if token not in self.parts:
                return
            dies = self.born[token]
            token = self.parts[token][side]

    def _may_follow(self, left: int, right: int, ends: int = INFINITE) -> bool:
        """No merge across the boundary of two pieces comes before ``ends``."""
        for u, u_dies in self._spine(left, 1):
            for v, v_dies in self._spine(right, 0):
                r = self.rank.get((u, v))
                # of equal ranks the leftmost merge comes first
                if r is not None and r < min(u_dies, ends) and r <= min(v_dies, ends):
                    return False
        return True

    def _stands_alone(self, token: int) -> bool:
        """The entry is what its own text encodes to."""
        left, right = self.parts[token]
        return (self._may_follow(left, right, self.born[token])
                and all(t not in self.parts or self._stands_alone(t) for t in (left, right)))

    def _reset(self) -> None:
        # a state: (trie node, piece before it, pieces relative to now) for each live suffix
        start = ((0, -1, 0),)
        self.states, self.ids, self.steps, self.pairs = [start], {start: 0}, {}, {}

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """Build the transition of ``state`` on ``symbol``: the next state and the pieces it adds."""
        live, last, count = [], -1, None
        for node, before, at in self.states[state]:          # longest suffix first
            nxt = self.child[node].get(symbol)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if count is None and token >= 0 and (before < 0 or self._pair(before, token)):
                last, count = token, at + 1
            live.append((nxt, before, at))
        key = tuple((n, b, a - count) for n, b, a in live) + ((0, last, 0),)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
        return self.ids[key], count

    def _pair(self, left: int, right: int) -> bool:
        ok = self.pairs.get((left, right))
        if ok is None:
            ok = self.pairs[left, right] = self._may_follow(left, right)
        return ok

    def pieces(self, word: str) -> int:
        """Run the piece transducer over one pre-token."""
        data = word.encode("utf-8")
        if len(self.states) > STATE_LIMIT:
            self._reset()
        state = total = 0
        steps, end = self.steps, len(data) - 1
        for i, symbol in enumerate(data):
            if i == end:
                symbol += 256
            key = state << 9 | symbol
            step = steps.get(key)
            if step is None:
                step = steps[key] = self._step(state, symbol)
            state = step[0]
            total += step[1]
        return total

    def _class(self, c: str) -> str:
        kind = self.classes.get(c)
        if kind is None:
            major = unicodedata.category(c)[0]
            kind = self.classes[c] = "S" if c in WHITE_SPACE else major if major in "LN" else "O"
        return kind

    def pre_tokens(self, text: str) -> Iterator[str]:
        """Run the word transducer: the pre-tokens of normalised text."""
        start, state = 0, ""            # state: class of the open run, or "'" just after an opening apostrophe
        i, n = 0, len(text)
        while i < n:
            kind = self._class(text[i])
            if state == "'":
                for ending in CONTRACTIONS:
                    if text.startswith(ending, i):
                        i += len(ending)
                        yield text[start:i]
                        state = ""
                        break
                else:
                    state = "O"
                if not state:
                    continue
            if state and kind != state:
                yield text[start:i]
                state = ""
            if kind == "N":
                yield text[i]
            elif kind != "S" and not state:
                start, state = i, "'" if text[i] == "'" else kind
            i += 1
        if state:
            yield text[start:]

    @staticmethod
    def normalise(text: str) -> str:
        if text.isascii():
            return text.lower()
        # one character at a time: no lower-casing rule looks at its neighbours
        return "".join(c.lower() for c in unicodedata.normalize("NFC", text))

    def count(self, segment: str) -> int:
        """Tokens of a text without seams: special strings count 1, the rest by the transducers."""
        # leftmost special first, as the specials do not overlap one another
        parts = self.special.split(segment) if any(s in segment for s in self.specials) else [segment]
        n, known = len(parts) - 1, self.pre_counts
        for part in parts:
            text = self.normalise(part)
            # a run of letters is one pre-token, and so is a single sign after it
            if text.isalpha():
                words = (text,)
            elif text[:-1].isalpha() and text[-1] in SIGNS:
                words = (text[:-1], text[-1])
            else:
                words = self.pre_tokens(text)
            for w in words:
                k = known.get(w)
                n += self._pre_count(w) if k is None else k
        return n

    def _pre_count(self, word: str) -> int:
        if len(self.pre_counts) > WORD_LIMIT:
            self.pre_counts.clear()
        n = self.pre_counts[word] = self.pieces(word)
        return n

    def word(self, segment: str) -> int:
        n = self.words.get(segment)
        if n is None:
            if len(self.words) > WORD_LIMIT:
                self.words = {"": 0}
            n = self.words[segment] = self.count(segment)
        return n

    def chunk_map(self, chunk: str, first: bool, last: bool) -> tuple[int, bool, str, str]:
        """``(count, closed, head, tail)`` of a chunk; known ends of the text close it."""
        segments = chunk.translate(ASCII_SPACE).split(" ")
        if len(segments) == 1 and not (first and last):
            segments = self.sure.sub(lambda m: f" {m[0]} ", chunk).split(" ")
        if len(segments) == 1 and not (first and last):
            if not first and not last:
                return 0, False, segments[0], ""
            return 0, True, *(("", segments[0]) if first else (segments[0], ""))
        head, tail = "" if first else segments.pop(0), "" if last else segments.pop()
        words, known = self.words, 0
        for s in segments:
            n = words.get(s)
            known += self.word(s) if n is None else n
            words = self.words
        return known, True, head, tail


_COMPILED: dict[int, Transducers] = {}


def compiled(spec) -> Transducers:
    """The transducers of a broadcast tokenizer file, compiled once per Python worker."""
    if spec.id not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[spec.id] = Transducers(spec.value)
    return _COMPILED[spec.id]


class _Spec:
    """A broadcast tokenizer file (a fixed size of a few MB) and a key for the worker's cache."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            self._text = spark.sparkContext.broadcast(f.read())
        self.id = path

    @property
    def value(self) -> str:
        return self._text.value


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
                 path: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens)."""
    spec = _Spec(docs.sparkSession, path or tokenizer_path("word_bpe_49k.json"))

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fst = compiled(spec)
        for b in batches:
            known = [fst.chunk_map(c, p == 0, p == n - 1) if n else (0, True, "", "")
                     for c, p, n in zip(b.pop("chunk"), b["pos"], b["n_chunks"])]
            yield b.assign(**dict(zip(("n", "closed", "head", "tail"), zip(*known) if known else [[]] * 4)))

    rows = text_rows(docs, id_col, text_col).select(
        "row_key", "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"),
        pieces_of(F.col("text"), chunk_chars).alias("chunks"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    chunks = rows.select("row_key", "doc_id", "n_bytes", F.size("chunks").alias("n_chunks"),
                         F.posexplode_outer("chunks").alias("pos", "chunk"))
    mapped = written(chunks.mapInPandas(
        maps, f"row_key bigint, doc_id {id_type}, n_bytes bigint, n_chunks int, pos int, "
              "n bigint, closed boolean, head string, tail string"), "chunk-maps")

    # prefix sum over the closed chunks numbers the seams of each text
    before = (Window.partitionBy("row_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    seams = (mapped.where("n_chunks > 1")
             .withColumn("seam", F.coalesce(F.sum(F.col("closed").cast("int")).over(before), F.lit(0)))
             .select("row_key", "pos", F.explode(F.array(
                 F.struct("seam", F.col("head").alias("part")),
                 F.struct((F.col("seam") + 1).alias("seam"),
                          F.when(F.col("closed"), F.col("tail")).otherwise("").alias("part")))).alias("s"))
             .where("s.part <> ''")
             .groupBy("row_key", "s.seam")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s.part"))),
                                           lambda x: x["part"]), "").alias("segment")))

    @F.pandas_udf("bigint")
    def count_words(segments: pd.Series) -> pd.Series:
        fst = compiled(spec)
        return segments.map(fst.word)

    joined = seams.select("row_key", F.lit(None).cast(id_type).alias("doc_id"),
                          F.lit(None).cast("bigint").alias("n_bytes"), count_words("segment").alias("n"))
    return (mapped.select("row_key", "doc_id", "n_bytes", "n").unionByName(joined)
            .groupBy("row_key").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                    F.sum("n").alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
