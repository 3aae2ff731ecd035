"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

Text is written with a marker for each space and one in front. Between two characters that stand side by
side in no piece, no piece can cross, so there the piece lattice falls into independent units. For
each distinct unit the forward sums of its lattice are computed once, for all new units of a batch
together, and kept as the probability of each piece that ends at a node. Backward sampling then draws, for all units of a batch at once, the
last piece, the one before it, and so on. A draw is a hash of the seed, the row's key and its place, so
the result does not depend on batches or partitions.

The probability of a piece falls with its rank in the vocabulary, ``(rank + 1) ** -alpha``; a greater
``alpha`` gives fewer and longer pieces. Characters that are no piece, and marker characters of the text
itself, are written as byte pieces, so decoding gives back every text exactly.

Defined results: null and empty text have no pieces; rows that repeat an id get the same draws for the
same text; a null id is a key like any other; other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path, whole_text

MARKER = "▁"
LITERAL = "\udc81"             # stands for a marker character of the text itself; UTF-8 text never holds it
UNIT_LIMIT = 75_000              # units remembered per Python worker
UNIT_CHARS = 64                  # longer units are sampled but not remembered
BLOCK_CHARS = 1 << 18            # characters sampled, and written, at once
LEAST_SUM = 1e-200               # forward sums below this are scaled
BYTE_WEIGHT = 1e-6               # of a character that is no piece


class Pieces:
    """A piece vocabulary and the sampling tables of the units met so far."""

    def __init__(self, model: bytes, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:-1], 16)] = i
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        rank = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        self.weight = {sp.id_to_piece(i): ((rank[i] + 1.0) ** -alpha, i) for i in plain}
        self.longest = max(map(len, self.weight))
        #: (weight, id) of each piece; None for what only begins one
        self.found = {p[:k]: None for p in self.weight for k in range(1, len(p))} | self.weight
        # which characters stand side by side in some piece: elsewhere no piece crosses, and a unit ends
        together = {pair for p in self.weight for pair in zip(p, p[1:])}
        signs = {c: k for k, c in enumerate(sorted({c for pair in together for c in pair}), 1)}
        self.sign = np.zeros(0x110000, np.int32)
        self.joined = np.zeros((len(signs) + 1, len(signs) + 1), bool)
        for c, k in signs.items():
            self.sign[ord(c)] = k
        for a, b in together:
            self.joined[signs[a], signs[b]] = True
        # the pieces as a trie: state 0 is the root and, as a next state, none; those that are only ends come last
        inner = {p[:k] for p in self.weight for k in range(len(p))}
        states = {p: k for k, p in enumerate(sorted({*self.found, ""}, key=lambda p: (p not in inner, p)))}
        kind = np.min_scalar_type(len(states))
        self.begin, self.next = np.zeros(0x110000, kind), np.zeros((len(inner) + 1, len(signs) + 1), kind)
        self.hit, self.hit_weight = np.full(len(states), -1, np.int32), np.zeros(len(states))
        for p, k in states.items():
            if len(p) == 1:
                self.begin[ord(p)] = k
            elif p:
                self.next[states[p[:-1]], signs[p[-1]]] = k
            if p in self.weight:
                self.hit_weight[k], self.hit[k] = self.weight[p]
        # so many characters cannot bring a forward sum below LEAST_SUM
        lowest = min(BYTE_WEIGHT, *(w for w, _ in self.weight.values()))
        self.unscaled = min(UNIT_CHARS, int(np.log(LEAST_SUM) / np.log(lowest)))
        self.bytes = [sp.id_to_piece(i).replace(MARKER, " ").encode() if i in rank else b"" for i in range(n)]
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes[i] = bytes([b])
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        self.nodes = 0
        self.cumulative, self.step_back, self.piece = array("d"), array("i"), array("i")

    def learn(self, unit: str) -> int:
        """Add the lattice of a unit; its last node. A node n has edges with cumulative n .. n + 1."""
        n, base, found = len(unit), self.nodes, self.found
        ends: list = [[] for _ in range(n + 1)]
        cumulative, step_back, piece = [], [], []
        now = 1.0                                    # forward sum of node i
        for i in range(n + 1):
            if i:
                if unit[i - 1] not in self.weight:
                    # no piece of its own: written as bytes, marked by the negative code point
                    ends[i].append((now * BYTE_WEIGHT, 1, -1 - ord(unit[i - 1])))
                now = 0.0
                for weight, _, _ in ends[i]:
                    now += weight
                at, top = base + i + 0.0, base + i + 1.0
                for weight, back, hit in ends[i]:
                    at += weight / now
                    cumulative.append(at if at < top else top)
                    step_back.append(back)
                    piece.append(hit)
                cumulative[-1] = top
                ends[i] = ()
                if now < LEAST_SUM:                  # rescale long lattices: only ratios count
                    for k in range(i + 1, min(n, i + self.longest) + 1):
                        ends[k] = [(w / now, b, p) for w, b, p in ends[k]]
                    now = 1.0
            for j in range(i + 1, n + 1):
                hit = found.get(unit[i:j], 0)
                if hit == 0:
                    break
                if hit is not None:
                    ends[j].append((now * hit[0], j - i, hit[1]))
        self.cumulative.extend(cumulative)
        self.step_back.extend(step_back)
        self.piece.extend(piece)
        self.nodes += n + 1
        if n <= UNIT_CHARS:
            self.units[unit] = base + n
        return base + n

    def learn_all(self, units: list[str]) -> None:
        """:meth:`learn` for many distinct units of at most ``unscaled`` characters, one position of all at a time."""
        if not units:
            return
        size = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.cumsum(size + 1) - size - 1                     # a unit's first node
        start = np.arange(len(chars)) + np.repeat(np.arange(len(units)), size)
        n_nodes = len(chars) + len(units)
        sign = np.zeros(n_nodes, np.int32)                         # of the character behind a node; a last node has none
        sign[start] = self.sign[chars]
        live, state, length = start, self.begin[chars], 1
        single = self.hit[state] >= 0
        found = [(start[~single] + 1, np.ones((~single).sum(), np.int64), np.full((~single).sum(), BYTE_WEIGHT),
                  -1 - chars[~single].astype(np.int64))]
        while len(live):
            live, state = live[state > 0], state[state > 0]
            ends = self.hit[state] >= 0
            found.append((live[ends] + length, np.full(ends.sum(), length), self.hit_weight[state[ends]], self.hit[state[ends]]))
            state = self.next[np.minimum(state, len(self.next) - 1), sign[live + length]]
            length += 1
        node, back, weight, piece = map(np.concatenate, zip(*found))
        order = np.lexsort((-back, node))
        node, back, weight, piece = node[order], back[order], weight[order], piece[order]

        place = np.arange(n_nodes) - np.repeat(first, size + 1)    # of a node in its unit
        sums = np.zeros(n_nodes)
        sums[first] = 1.0
        by_place = np.argsort(place[node], kind="stable")
        for edges in np.split(by_place, np.cumsum(np.bincount(place[node]))[:-1])[1:]:
            at = node[edges]
            weight[edges] *= sums[at - back[edges]]
            new = np.cumsum(np.append(0, at[1:] != at[:-1]))
            sums[at[np.append(True, at[1:] != at[:-1])]] = np.bincount(new, weight[edges])
        share = weight / sums[node]
        heads = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        nth = np.arange(len(node)) - np.repeat(heads, np.diff(np.append(heads, len(node))))
        low = self.nodes + np.arange(n_nodes) + 0.0
        cumulative, reached = np.empty(len(node)), low.copy()
        for k in range(int(nth.max()) + 1):
            edges = np.flatnonzero(nth == k)
            reached[node[edges]] += share[edges]
            cumulative[edges] = np.minimum(reached[node[edges]], low[node[edges]] + 1.0)
        tails = np.append(heads[1:], len(node)) - 1
        cumulative[tails] = low[node[tails]] + 1.0

        self.cumulative.frombytes(cumulative.tobytes())
        self.step_back.frombytes(back.astype(np.intc).tobytes())
        self.piece.frombytes(piece.astype(np.intc).tobytes())
        self.units.update(zip(units, (self.nodes + first + size).tolist()))
        self.nodes += n_nodes

    def sample(self, units: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all units in order, and how many each unit has."""
        if len(self.units) > UNIT_LIMIT or self.nodes > 16 * UNIT_LIMIT:
            self.forget()
        known = self.units
        self.learn_all([u for u in dict.fromkeys(units) if len(u) <= self.unscaled and u not in known])
        last = [known.get(u, -1) for u in units]
        for k, node in enumerate(last):
            if node < 0:
                last[k] = known[units[k]] if units[k] in known else self.learn(units[k])
        left = np.fromiter(map(len, units), np.int64, len(units))
        node, live = np.array(last, np.int64), np.arange(len(units))
        cumulative, back, piece = (np.frombuffer(x, t) for x, t in
                                   ((self.cumulative, np.float64), (self.step_back, np.intc), (self.piece, np.intc)))
        drawn, step = [], 0
        while len(live):
            edge = np.searchsorted(cumulative, node[live] + _uniform(seeds[live], step), side="right")
            drawn.append((live, piece[edge]))
            node[live] -= back[edge]
            left[live] -= back[edge]
            live, step = live[left[live] > 0], step + 1
        count = np.zeros(len(units), np.int64)
        for at, _ in drawn:
            count[at] += 1
        ends, out = np.cumsum(count), np.empty(count.sum(), np.int64)
        for k, (at, ids) in enumerate(drawn):        # drawn from the last piece to the first
            out[ends[at] - 1 - k] = ids
        del cumulative, back, piece                  # the tables can grow again
        return out, count

    def encode(self, texts: list[str], keys: np.ndarray, seed: int = 0) -> list[np.ndarray]:
        """A sampled segmentation of each text; ``keys`` are the rows' 64-bit keys."""
        units, owner, place = [], [], []
        for k, text in enumerate(texts):
            own = self._units(self._marked(text)) if text else []
            units += own
            owner.append(np.full(len(own), k))
            place.append(np.arange(len(own)))
        owner, place = np.concatenate(owner or [[]]).astype(np.int64), np.concatenate(place or [[]]).astype(np.uint64)
        if not len(units):
            return [np.empty(0, np.int64) for _ in texts]
        seeds = _scramble(keys.astype(np.uint64)[owner] ^ _scramble(place + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)))
        ids, count = self.sample(units, seeds)
        ids, times = self._with_bytes(ids)
        sizes = np.bincount(np.repeat(owner, count), weights=times, minlength=len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(sizes)[:-1])

    def _units(self, marked: str) -> list[str]:
        sign = self.sign[np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4")]
        ends = (np.flatnonzero(~self.joined[sign[:-1], sign[1:]]) + 1).tolist() + [len(marked)]
        return [marked[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _marked(text: str) -> str:
        return MARKER + text.replace(MARKER, LITERAL).replace(" ", MARKER)

    def _with_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces with the byte pieces of characters that have none, and how many each of ``ids`` became."""
        times, odd = np.ones(len(ids), np.int64), ids < 0
        if not odd.any():
            return ids, times
        points = -1 - ids[odd]
        points[points == ord(LITERAL)] = ord(MARKER)
        times[odd] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        out = np.repeat(ids, times)
        written = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
        out[np.repeat(odd, times)] = self.byte_ids[np.frombuffer(written, np.uint8)]
        return out, times

    def decode(self, ids: np.ndarray) -> str:
        """The text of some pieces: exactly the one that was encoded."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:].decode("utf-8")


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1), by seed and step."""
    odd = np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (_scramble(seeds + odd) >> np.uint64(22)) / float(1 << 42)


_LOADED: dict[tuple, Pieces] = {}


def sampled_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, alpha: float = 1.0,
                   path: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_pieces, pieces_crc32, lossless`` (decoding gave the text back), ``pieces``."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())      # a fixed size below 1 MB
    names = ["doc_id", "n_pieces", "pieces_crc32", "lossless", "pieces"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, alpha) not in _LOADED:
            _LOADED[path, alpha] = Pieces(model.value, alpha)
        pieces = _LOADED[path, alpha]
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:      # a block is read, sampled and handed on before the next
                before = int(ends[at - 1]) if at else 0
                end = max(int(np.searchsorted(ends, before + BLOCK_CHARS, "right")), at + 1)
                block, at = batch.slice(at, end - at), end
                texts = block.column(2).to_pylist()
                ids = pieces.encode(texts, block.column(1).to_numpy(), seed)
                count = np.fromiter(map(len, ids), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays([
                    block.column(0), pa.array(count),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([pieces.decode(x) == text for x, text in zip(ids, texts)], pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]), pa.int32()), pa.array(np.concatenate(ids), pa.int32())),
                ], names=names)

    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), whole_text(text_col).alias("text"))
    kind = rows.schema.fields[0].dataType.simpleString()
    return rows.mapInArrow(read, f"doc_id {kind}, n_pieces bigint, pieces_crc32 bigint, lossless boolean, pieces array<int>")
