"""Sum-of-squares online packing of token sequences into windows of a fixed size.

A document's tokens are cut into full windows and a rest. The rest goes to the fill level ``h`` for which
the sum of squared counts of partly filled windows grows least; ``counts[h]`` is the level array. Windows that
are still partly filled when a partition ends are emptied into each other: their pieces are cut so that all
windows but the last are full, and the last is cut into powers of two, which need no padding.

Every partition packs by itself in one pass, with memory for at most ``window - 1`` levels of open windows, so
nothing is shuffled and a lost task repeats with the same result.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sugarmill.llm.common import slices, tidy

WINDOW = 1024
#: Windows of a partition get the ids from partition << PART_BITS on.
PART_BITS = 36
#: Distinct words in each of the two generations of a worker's token cache.
CACHE_WORDS = 800_000

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


#: White space besides space and line feed; a text with any is encoded whole.
OTHER_BLANKS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def separable(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters, and no control string can occur."""
    return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ("  ", " \n", "\n ", "\n\n", "<|", *OTHER_BLANKS))


class WordCache:
    """Token ids, as little-endian 32-bit bytes, of the words of byte-level BPE.

    The pre-tokenizer never joins a lone space or line feed to what stands before it, so a separable text has the ids
    of its words, each with the space or line feed before it. Other texts are encoded whole. Words are looked up without
    their space. Two generations bound the cache.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.stops = dict(zip(".,", self.direct([".", ","]), strict=True))

    def direct(self, texts: list[str]) -> list[bytes]:
        """The ids of whole strings, as bytes."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(self, words: list[str]) -> list[bytes]:
        """The ids of words with a space before them, or with their own line feed."""
        tokenize = self.tokenizer.model.tokenize
        plain = [w.isascii() and w.isalpha() for w in words]  # one piece for the pre-tokenizer, which writes the space as U+0120
        rest = iter(self.direct([w if w[:1] == "\n" else " " + w for w, p in zip(words, plain, strict=True) if not p]))
        return [array("I", [t.id for t in tokenize("\u0120" + w)]).tobytes() if p else next(rest) for w, p in zip(words, plain, strict=True)]

    def known(self, words: set[str]) -> dict[str, bytes]:
        """A table that holds the ids of all of ``words``. A stop after a letter is a token of its own."""
        young, old = self.young, self.old
        missing = []
        stopped = []
        for w in words.difference(young):
            ids = old.get(w)
            if ids is not None:
                young[w] = ids
            elif w[-1] in ".," and w[-2:-1].isalpha():
                stopped.append(w)
            else:
                missing.append(w)
        for w in {w[:-1] for w in stopped}.difference(young, missing):
            ids = old.get(w)
            if ids is not None:
                young[w] = ids
            else:
                missing.append(w)
        if missing:
            young.update(zip(missing, self.spaced(missing), strict=True))
        for w in stopped:
            young[w] = young[w[:-1]] + self.stops[w[-1]]
        if len(young) > self.limit:
            self.old, self.young = {w: b for w, b in young.items() if len(w) < 64}, {}
        return young

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        split = [t.replace("\n", " \n").split(" ") if separable(t) else None for t in texts]
        words: set[str] = set()
        for parts in split:
            if parts:
                words.update(parts[1:])
        ids = self.known(words)
        whole = iter(self.direct([t if parts is None else parts[0] for t, parts in zip(texts, split, strict=True)]))
        return [next(whole) if parts is None else next(whole) + b"".join(map(ids.__getitem__, parts[1:])) for parts in split]


class Levels:
    """Open windows by fill level; a rest goes where the sum of squared level counts grows least."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]

    def place(self, piece: tuple, size: int) -> list[tuple] | None:
        """Puts a piece into a window; the window's pieces if that filled it."""
        n, w = self.counts, self.window
        top = w - size
        # moving a window from h to h + size changes the sum by 2 (n[h + size] - n[h] + 1); a new window has no h, a full one no target
        change = 2 * (n[size : w + 1] - n[: top + 1] + 1)
        change[n[: top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] + 1 if size < w else 0
        if top > 0 and n[top]:
            change[top] = 1 - 2 * n[top]
        h = int(change.argmin())
        pieces = self.open[h].pop() if h else []
        pieces.append(piece)
        if h:
            n[h] -= 1
        if h + size == w:
            return pieces
        n[h + size] += 1
        self.open[h + size].append(pieces)
        return None

    def rest(self) -> list[tuple]:
        """The pieces of all windows still open, fullest first."""
        return [p for level in reversed(self.open) for pieces in level for p in pieces]


def refill(pieces: list[tuple], window: int) -> Iterator[list[tuple]]:
    """Windows made of (doc, start, bytes, total) pieces in order: all full, but the last ones powers of two."""
    left = sum(len(p[2]) // 4 for p in pieces)
    room, out = 0, []
    for doc, start, ids, total in pieces:
        at, n = 0, len(ids) // 4
        while at < n:
            if not room:
                if out:
                    yield out
                room, out = (window if left >= window else 1 << (left.bit_length() - 1)), []
            take = min(room, n - at)
            out.append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
            at, room, left = at + take, room - take, left - take
    if out:
        yield out


def pack_partition(encode: Callable[[list[str]], list[bytes]], batches: Iterator[pa.RecordBatch], part: int, window: int, end: bytes) -> Iterator[pa.RecordBatch]:
    """Packs the (doc_id, text) rows of one partition."""
    levels, sequence = Levels(window), part << PART_BITS
    rows: list[tuple] = []

    def emit(pieces: list[tuple]) -> None:
        nonlocal sequence
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            rows.append((doc, start, n, ids, total, sequence, offset))
            offset += n
        sequence += 1

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=PIECES.names)
        rows.clear()
        return batch

    for piece in slices(batches):
        texts = [t or "" for t in piece.column(1).to_pylist()]
        for doc, ids in zip(piece.column(0).to_pylist(), encode(texts), strict=True):
            ids += end
            total = len(ids) // 4
            full = total - total % window
            for at in range(0, full, window):
                emit([(doc, at, ids[4 * at : 4 * (at + window)], total)])
            if full < total and (filled := levels.place((doc, full, ids[4 * full :], total), total - full)):
                emit(filled)
        if len(rows) >= 2000:
            yield flush()
    for pieces in refill(levels.rest(), window):
        emit(pieces)
    if rows:
        yield flush()


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 0, cache_words: int = CACHE_WORDS, outlives: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of windows of ``window`` tokens.

    ``tokenizer`` is the path of a byte-level BPE file that every worker has. ``ids`` holds little-endian
    unsigned 32-bit ids; every document ends with ``end_id``. Null texts count as empty (one piece with the
    end only), null ids stay null, repeated rows are packed each, other columns are left out, an empty table
    gives no pieces. ``cache_words`` bounds the memory of a worker's tokens of words, which the worker keeps for its next task
    unless ``outlives`` is false. A window is full or, for the last few of a partition, a power of two long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        words = cached(tokenizer, cache_words) if outlives else WordCache(tokenizer, cache_words)
        yield from pack_partition(words.encode, batches, TaskContext.get().partitionId(), window, int(end_id).to_bytes(4, "little"))
        del words
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


_CACHES: dict[tuple[str, int], WordCache] = {}


def cached(path: str, limit: int = CACHE_WORDS) -> WordCache:
    """The worker's cache for a tokenizer file; it outlives a task."""
    if (path, limit) not in _CACHES:
        _CACHES[path, limit] = WordCache(path, limit)
    return _CACHES[path, limit]


def ids_crc32(ids: Column) -> Column:
    """The unsigned CRC-32 of a piece's bytes."""
    return F.crc32(ids)
