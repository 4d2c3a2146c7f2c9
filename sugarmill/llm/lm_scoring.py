"""Language-model scoring with a weighted backoff automaton over all pairs of words.

Documents are dealt to blocks of bounded size. A block states its distinct tokens and pairs as 64-bit hashes with their
counts in its training texts, sorted and packed by ranges of hashes; the rows of a range are summed together, and the sums go
back to each block in the order in which it stated the hashes. So every token and every pair of the corpus counts, none is left out for being rare, what is gathered grows
with the corpus, and nothing of it is broadcast or comes to the driver (four numbers do).

A block then holds its part of the automaton: a state for each context of one token, an arc for each pair seen in training,
and a failure arc to the state without context. Smoothing is hierarchical: an arc weighs (c(x, w) + strength * p(w)) /
(c(x) + strength), a failure arc strength / (c(x) + strength), so the probabilities after any context sum to one. p(w) is by
absolute discounting; all tokens that training never saw are one kind, with the mass that discounting takes. Each document is
scored in one traversal from left to right. Two different tokens or pairs among 10^9 share a hash with a chance of about 0.1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarmill.llm.common import slices

#: Weight of the shorter context, in occurrences of the longer one. Held-out log10 of sf0.1: -2.20 M at 2, -2.09 M at 8, -2.02 M at 30, -1.98 M at 100.
STRENGTH = 30.0
#: Tokens of a block of documents, about.
BLOCK_TOKENS = 2_500_000
HELD = 200_000
#: The end of a text; words hold no line feed. It also stands before the first word.
END = b"\n"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Totals:
    """Counts of the training texts: tokens, kinds of tokens, and the discount of a token's own probability."""

    n_tokens: int = 0
    n_kinds: int = 0
    discount: float = 0.5


def held_out(doc_id: Column) -> Column:
    """Rows that training leaves out: CRC-32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def pair_hashes(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of each pair of hashes; the order within a pair matters."""
    k = x * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    k = (k ^ (k >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return k ^ (k >> np.uint64(29))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) of a table with one text column; tokens as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(hashes(list(n)).view(np.int64)), pa.array(list(n.values()), pa.int64())], names=["token", "c"])
            n.clear()
            return out

        for piece in slices(batches):
            for t in piece.column(0).to_pylist():
                n.update(tokens(t or ""))
            if len(n) > HELD:
                yield flush()
        if n:
            yield flush()

    return texts.mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def fit(docs: DataFrame, text: str = "text") -> Totals:
    """The totals of the training texts."""
    single = lambda k: F.count(F.when(F.col("c") == k, 1))
    r = count_tokens(docs.select(F.col(text).cast("string").alias("text"))).agg(F.sum("c").alias("n"), F.count("*").alias("v"), single(1).alias("n1"), single(2).alias("n2")).first()
    return Totals(r.n or 0, r.v, r.n1 / (r.n1 + 2 * r.n2) if r.n1 and r.n2 else 0.5)


def packed(x: np.ndarray) -> bytes:
    """64-bit integers as bytes: first the lowest byte of each, then the next, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, size * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


@dataclass
class Block:
    """Texts as ids of their distinct tokens. Id 0 is the end, so what stands before a text is the end of the one before it."""

    ids: dict[bytes, int] = field(default_factory=lambda: {END: 0})
    texts: list[np.ndarray] = field(default_factory=list)
    train: list[bool] = field(default_factory=list)

    def add(self, text: str, train: bool) -> None:
        ids = self.ids
        self.texts.append(np.array([ids.setdefault(w, len(ids)) for w in tokens(text)], np.int32))
        self.train.append(train)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as first * number of ids + second; hashes of the tokens by id and then of the pairs; their counts in training."""
        base = len(self.ids)
        w = np.concatenate(self.texts).astype(np.int64)
        mask = np.repeat(np.array(self.train, np.float64), [len(t) for t in self.texts])
        pairs, at = np.unique(np.concatenate([w[:1] * 0, w[:-1]]) * base + w, return_inverse=True)
        h = hashes(list(self.ids))
        c = np.concatenate([np.bincount(w, mask, base), np.bincount(at, mask)]).astype(np.int64)
        return pairs, np.concatenate([h, pair_hashes(h[pairs // base], h[pairs % base])]), c


ASKED = "block long, span long, size long, keys binary, counts binary"
ANSWERED = "block long, span long, size long, counts binary"


def stated(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """``ASKED``: hashes of the tokens and pairs of each block with their training counts, a row for each range of hashes (by their
    first ``bits`` bits) that the block has any of; rows come block by block."""
    now, held = None, Block()
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def flush() -> Iterator[pa.RecordBatch]:
        _, keys, c = held.counted()
        order = np.argsort(keys)
        keys, c = keys[order], c[order]
        cuts = [*np.searchsorted(keys, edges).tolist(), len(keys)]
        rows = [(now, k, j - i, packed(np.diff(keys[i:j], prepend=np.uint64(0))), packed(c[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
        for k in range(0, len(rows), 100):
            columns = zip(*rows[k : k + 100], strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["block", "span", "size", "keys", "counts"])

    for piece in slices(batches):
        for block, text, train in zip(piece.column("block").to_pylist(), piece.column("text").to_pylist(), piece.column("train").to_pylist(), strict=True):
            if block != now:
                if held.texts:
                    yield from flush()
                now, held = block, Block()
            held.add(text or "", train)
    if held.texts:
        yield from flush()


def summed(asked: pa.Table) -> pa.Table:
    """The rows of one range of hashes with the sums over all of them in place of the counts."""
    size = asked.column("size").to_pylist()
    keys = np.concatenate([np.cumsum(unpacked(x, n), dtype=np.uint64) for x, n in zip(asked.column("keys").to_pylist(), size, strict=True)])
    own = np.concatenate([unpacked(x, n) for x, n in zip(asked.column("counts").to_pylist(), size, strict=True)])
    _, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, own.astype(float)).astype(np.uint64)[at]
    ends = np.cumsum(size)
    return asked.drop_columns(["keys", "counts"]).append_column("counts", pa.array([packed(total[e - n : e]) for e, n in zip(ends, size, strict=True)], pa.binary()))


@dataclass
class Automaton:
    """States with arcs and failure arcs. State 0 has no context and an arc for every token; state 1 + id has that token before it."""

    #: log10 weight of the arcs of state 0, by id
    own: list[float]
    #: (state - 1) * number of ids + id -> log10 weight; the next state is 1 + id
    arcs: dict[int, float]
    #: log10 weight of each state's failure arc, which leads to state 0
    failure: list[float]

    def traverse(self, words: list[int]) -> float:
        """log10 probability of a text's tokens."""
        own, arcs, failure, base = self.own, self.arcs, self.failure, len(self.own)
        state, total = 1, 0.0
        for w in words:
            weight = arcs.get((state - 1) * base + w)
            total += failure[state] + own[w] if weight is None else weight
            state = 1 + w
        return total


def built(totals: Totals, base: int, pairs: np.ndarray, c: np.ndarray, strength: float) -> Automaton:
    """The automaton of a block from the counts of its tokens, by id, and then of its pairs."""
    one, two = c[:base].astype(float), c[base:].astype(float)
    n = max(totals.n_tokens, 1)
    rest = max(totals.discount * totals.n_kinds, 1.0) / n
    own = np.where(one > 0, np.maximum(one - totals.discount, 1e-9) / n, rest)
    x, w = pairs // base, pairs % base
    seen = two > 0
    weight = np.log10((two[seen] + strength * own[w[seen]]) / (one[x[seen]] + strength))
    return Automaton(np.log10(own).tolist(), dict(zip(pairs[seen].tolist(), weight.tolist(), strict=True)), [0.0, *np.log10(strength / (one + strength)).tolist()])


def scored(totals: Totals, docs: pa.Table, answers: pa.Table, strength: float) -> pa.Table:
    """One row of ``SCORES`` for each (doc_id, text, held_out, train) of a block, given the ``ANSWERED`` rows of all its ranges."""
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    block = Block()
    for batch in slices(iter(docs.select(["text", "train"]).to_batches())):
        for text, train in zip(batch.column("text").to_pylist(), batch.column("train").to_pylist(), strict=True):
            block.add(text or "", train)
    if not block.texts:
        return pa.table([pa.array([], k) for k in kinds], names=list(names))
    base = len(block.ids)
    pairs, keys, c = block.counted()
    order = np.argsort(keys)
    answers = answers.sort_by("span")
    c[order] = np.concatenate([unpacked(x, n) for x, n in zip(answers.column("counts").to_pylist(), answers.column("size").to_pylist(), strict=True)])
    a = built(totals, base, pairs, c, strength)
    known, plain = c[:base] > 0, np.log10((c[:base] + 1) / (totals.n_tokens + totals.n_kinds + 1))
    size = [len(t) for t in block.texts]
    columns = (
        docs.column("doc_id"), docs.column("held_out"), size, [int(known[t].sum()) for t in block.texts], [totals.n_tokens] * len(size),
        [math.fsum(plain[t]) for t in block.texts], [a.traverse(t.tolist()) for t in block.texts],
    )
    return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=list(names))


def score(docs: DataFrame, totals: Totals, id_col: str = "doc_id", text_col: str = "text", strength: float = STRENGTH) -> DataFrame:
    """Scores of every row under the model of those not held out, whose totals are given.

    Null texts count as empty and have the end only, repeated rows are scored each, null ids stay null and are not trained on,
    other columns are left out, an empty table gives none. There are about as many ranges as blocks, and a block states a hash once
    however often it occurs, so a range has about as many hashes as a block.
    """
    n = max(1, math.ceil(totals.n_tokens * 7 / 6 / BLOCK_TOKENS))
    out = held_out(F.col(id_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), out.alias("held_out"), (~out & F.col(id_col).isNotNull()).alias("train"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n))).repartition(n, "block")
    # all columns go along, so that both uses of the documents are one exchange
    bits = max(1, math.ceil(math.log2(n)))
    asked = rows.sortWithinPartitions("block").mapInArrow(lambda x: stated(x, bits), ASKED)
    answers = asked.groupBy("span").applyInArrow(summed, ANSWERED)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda x, y: scored(totals, x, y, strength), SCORES)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows under the model of those not held out."""
    return score(docs, fit(docs.filter(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()), text_col), id_col, text_col)
