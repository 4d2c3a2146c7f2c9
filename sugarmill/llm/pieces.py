"""Sampled segmentation into SentencePiece pieces, and lossless decoding.

A text, with a space before it, is cut before each run of spaces and around each line feed into units, which no piece
crosses; within a unit, the lattice has an edge for each piece that stands there. A forward pass sums the weights of all paths to each place, and a backward pass
draws a path edge by edge, so a path's probability is in proportion to its weight. A draw is a hash of the row's key, the
seed and the place, so a segmentation depends on these alone. A unit's forward sums depend on the unit alone and are
kept for many units at once; the backward pass runs over all units of a slice of rows together.

A character without a piece is written as the pieces of its bytes, as is U+2581, which stands for the space; decoding
joins bytes and gives back every text. A piece's weight is the inverse of its rank in the vocabulary, raised to ``alpha``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugarmill.llm.common import slices
from sugarmill.llm.ngram_join import mixed

SPACE = "▁"
#: Units of a text with a space before it.
UNIT = re.compile(r"\n| *[^ \n]+| +")
#: Units that a worker keeps forward sums of, and characters of all of them.
UNITS_HELD, CHARACTERS_HELD = 200_000, 1_500_000
#: Sums below this are scaled up.
SMALL = 1e-120


def stepped(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of substrings with one more code point."""
    h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Vocabulary:
    """The pieces of a model file: by length, sorted hashes with ids and weights; bytes for decoding."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw: list[bytes] = []
        self.byte = [0] * 256
        self.weight: dict[str, tuple[int, float]] = {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
                bare = piece.lstrip(SPACE)
                if SPACE not in bare and "\n" not in piece:  # a unit has its spaces at the start
                    self.weight[piece.replace(SPACE, " ")] = (k, (1.0 / (k + 1)) ** alpha)
        self.longest = max(map(len, self.weight), default=1)
        self.fallback = (1.0 / len(self.raw)) ** alpha
        #: by length: sorted hashes of pieces and of beginnings of longer ones, with ids (-1: no piece), weights, and whether there are longer ones
        self.tables: list[tuple[np.ndarray, ...]] = []
        for n in range(1, self.longest + 1):
            longer = {p[:n] for p in self.weight if len(p) > n}
            own = sorted(longer.union(p for p in self.weight if len(p) == n))
            h = np.zeros(len(own), np.uint64)
            c = codes("".join(own)).reshape(-1, n)
            for i in range(n):
                h = stepped(h, c[:, i])
            at = np.argsort(h)
            found = [self.weight.get(p, (-1, 0.0)) for p in own]
            self.tables.append((h[at], np.array([k for k, _ in found], np.int32)[at], np.array([w for _, w in found])[at], np.array([p in longer for p in own])[at]))


class Lattices:
    """Forward sums of units, as edges grouped by the place where they end."""

    def __init__(self, vocabulary: Vocabulary, best: bool):
        self.v, self.best = vocabulary, best
        self.clear()

    def clear(self) -> None:
        self.first: dict[str, int] = {}
        self.groups = self.edges = 0
        #: of groups: the first edge; of edges: cumulative share, length, piece (below 0: a character's bytes)
        self.starts, self.shares, self.sizes, self.ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 17, np.float32), np.zeros(1 << 17, np.int8), np.zeros(1 << 17, np.int32)

    def stored(self, name: str, at: int, values: np.ndarray) -> None:
        """Values from a place on, in an array that doubles when full."""
        a = getattr(self, name)
        if at + len(values) > len(a):
            a = np.concatenate([a, np.zeros(max(len(a), len(values)), a.dtype)])
            setattr(self, name, a)
        a[at : at + len(values)] = values

    def add(self, units: list[str]) -> None:
        """Sums the paths of the units' lattices, all units together, place by place from left to right."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        first = np.cumsum(size) - size
        self.first.update(zip(units, (first + self.groups).tolist(), strict=True))
        c = codes("".join(units))
        place = np.arange(len(c)) - np.repeat(first, size)
        left = np.repeat(size, size) - place
        i, h = np.arange(len(c)), np.zeros(len(c), np.uint64)
        begin, length, piece, weight = [], [], [], []
        for n, (keys, ids, weights, extends) in enumerate(self.v.tables, 1):
            if n > 1:
                more = left[i] >= n
                i, h = i[more], h[more]
            h = stepped(h, c[i + n - 1])
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            there = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            hit = there & (ids[at] >= 0) if len(keys) else there
            if n == 1:
                miss = i[~hit]
                begin.append(miss)
                length.append(np.ones(len(miss), np.int64))
                piece.append(-c[miss].astype(np.int64) - 1)
                weight.append(np.full(len(miss), self.v.fallback))
            begin.append(i[hit])
            length.append(np.full(int(hit.sum()), n))
            piece.append(ids[at[hit]].astype(np.int64))
            weight.append(weights[at[hit]])
            if len(keys):
                there &= extends[at]
            i, h = i[there], h[there]
        begin, length, piece, weight = map(np.concatenate, (begin, length, piece, weight))
        group = begin + length - 1
        order = np.argsort(group, kind="stable")
        begin, length, piece, weight, group = (x[order] for x in (begin, length, piece, weight, group))
        count = np.bincount(group, minlength=len(c))
        start = np.cumsum(count) - count
        before, after, part = np.zeros(len(c) + 1), np.zeros(len(c)), np.zeros(len(group))
        before[first] = 1.0
        by_place = np.argsort(place[group], kind="stable")
        cuts = np.searchsorted(place[group][by_place], np.arange(int(size.max()) + 1))
        join = np.maximum if self.best else np.add
        for e in range(int(size.max())):
            edge = by_place[cuts[e] : cuts[e + 1]]
            part[edge] = before[begin[edge]] * weight[edge]
            ends = np.flatnonzero(np.r_[True, group[edge][1:] != group[edge][:-1]])
            g = group[edge][ends]
            after[g] = join.reduceat(part[edge], ends)
            on = g[left[g] > 1]
            before[on + 1] = after[on]
            if e % 16 == 15:
                low = on[after[on] < SMALL]
                for k in range(min(self.v.longest, e + 1)):
                    before[low + 1 - k] /= SMALL
        if self.best:
            share = np.where(part == after[group], 2.0, -1.0)
        else:
            share = np.cumsum(part / after[group]) - np.repeat(np.arange(len(c)), count)
        share[start + count - 1] = 2.0
        self.stored("starts", self.groups, start + self.edges)
        self.stored("shares", self.edges, share)
        self.stored("sizes", self.edges, length)
        self.stored("ids", self.edges, piece)
        self.groups += len(c)
        self.edges += len(group)


def units_of(text: str) -> list[str]:
    """The text's units; joined they are the text with a space before it."""
    return UNIT.findall(" " + text)


def draws(row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from rows' keys and places."""
    return (mixed(row ^ mixed(place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def encode_rows(lattices: Lattices, keys: list[int], texts: list[str]) -> list[bytes]:
    """The ids of each text, as little-endian 32-bit bytes."""
    units = [units_of(t) for t in texts]
    if len(lattices.first) > UNITS_HELD or lattices.groups > CHARACTERS_HELD:
        lattices.clear()
    if new := set().union(*units).difference(lattices.first):
        lattices.add(list(new))
    starts, shares, sizes, ids = lattices.starts, lattices.shares, lattices.sizes, lattices.ids
    n = np.fromiter(map(len, units), np.int64, len(units))
    flat = [u for row in units for u in row]
    group = np.fromiter(map(lattices.first.__getitem__, flat), np.int64, len(flat))
    left = np.fromiter(map(len, flat), np.int64, len(flat))
    row = np.repeat(np.array(keys, np.uint64), n)
    begin = np.cumsum(left) - left
    begin -= np.repeat(begin[np.minimum(np.cumsum(n) - n, max(len(flat) - 1, 0))], n) if len(flat) else 0
    live = np.arange(len(flat))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        e = left[live]
        edge = starts[group[live] + e - 1].astype(np.int64)
        u = draws(row[live], begin[live] + e)
        more = np.flatnonzero(u >= shares[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] >= shares[edge[more]]]
        steps.append((live, ids[edge]))
        left[live] = e - sizes[edge]
        live = live[left[live] > 0]
    count = np.zeros(len(flat), np.int64)
    for k, (at, _) in enumerate(steps):
        count[at] = k + 1
    ends = np.cumsum(count)
    out = np.zeros(ends[-1] if len(ends) else 0, np.int64)
    for k, (at, piece) in enumerate(steps):
        out[ends[at] - 1 - k] = piece
    bounds = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(units)), n), count, len(units)))]).astype(np.int64)
    result = []
    for k in range(len(units)):
        piece = out[bounds[k] : bounds[k + 1]]
        if (piece < 0).any():
            piece = np.array([x for p in piece.tolist() for x in ([p] if p >= 0 else [lattices.v.byte[b] for b in chr(-p - 1).encode("utf-8", "surrogatepass")])])
        result.append(piece.astype("<u4").tobytes())
    return result


def row_keys(keys: list, seed: int) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(repr(k).encode(), seed) for k in keys]


_LATTICES: dict[tuple, Lattices] = {}


def encode(docs: DataFrame, model: str, seed: int = 0, alpha: float = 0.5, best: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids): a sampled segmentation of every row, or the best one; ids as little-endian 32-bit bytes.

    Null texts count as empty, which is one space's pieces; null ids are a key of their own; rows of equal id and text
    get equal pieces; other columns are left out; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model, alpha, best) not in _LATTICES:
            _LATTICES[model, alpha, best] = Lattices(Vocabulary(model, alpha), best)
        lattices = _LATTICES[model, alpha, best]
        for piece in slices(batches):
            out = encode_rows(lattices, row_keys(piece.column(0).to_pylist(), seed), [t or "" for t in piece.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(out, pa.binary())], names=["doc_id", "text", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, ids binary")


def decode(ids, model: str):
    """The text of a column of ids."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = np.array(Vocabulary(model, 1.0).raw, object)
        for batch in batches:
            yield pa.array([None if x is None else b"".join(raw[np.frombuffer(x, "<u4")]).decode("utf-8", "surrogatepass")[1:] for x in batch.to_pylist()], pa.string())

    return run(ids)
