"""Quality rules: plain counts, and perplexity bands by language under an n-gram model of words.

The model is interpolated modified Kneser-Ney over pairs of words, of a vocabulary for each language: the words that stand at least twice.
Words that stand once are one kind, whose probability is shared by the number of them. Pairs that stand at least twice have a weight of their
own; the mass of the others goes to the single words, which are weighed by the distinct words before them. Nothing else is left out and no
table is broadcast: documents become blocks of one language and bounded size, in which words are hashed, and three times a block asks and is
answered by ranges of hashes: which of its words are in the vocabulary, how often its pairs stand in all texts, and what its words
sum up to as contexts and behind others. Keys are sorted, and packed by their bytes. A few numbers for each language come to the driver.

A text's perplexity is per word. Words without a letter or digit are counted, and a text with more than ``MOST_SIGNS`` percent of them fails
a rule of its own, beside the bands.
A language's bands lie around the median of its documents, each distinct result counted once, in units of the distance
from the median to the upper quartile. There is an upper band for the whole model and one for its single words, which are weighed
by what stands before them: copies of a text teach their pairs to the model and would hide it from the first, but not from the second.
For the same reason the lower band is for single words: copies do not lower it, texts made of very frequent words alone do.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarmill.llm.common import discard, free_name, removed, shared_dir, slices, tidy, written

#: Shares of a language's words, for each language there is, that words and pairs need besides standing twice; at 0 no share is asked for.
MIN_WORD, MIN_PAIR = 0.0, 0.0
#: Languages with a smaller share of all words are one, with those of no name.
MIN_LANG = 0.01
#: Bands below and above the median, in distances from it to the upper quartile: for single words, for the whole model, for single words.
BELOW, ABOVE, ABOVE_ALONE = 10.0, 7.0, 10.0
#: Words without a letter or digit that a text may have, in percent.
MOST_SIGNS = 5
#: Words of a block, of all blocks that a task holds while it fills them, and of the texts behind one range of hashes.
BLOCK, HELD, RANGE = 2_000_000, 3_000_000, 2_000_000
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
COUNTED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_sign_words"]
COUNTS = f"struct<{','.join(f'{x}:bigint' for x in COUNTED)}>"
SIGNS = re.compile(r"[\W_]+")
#: Longest word in bytes that is hashed together with others.
LONG = 64
#: By byte: whether it is white space; 1 for a letter or digit, 2 for a part of a character beyond ASCII; masks of the first bytes of eight.
IS_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))
KIND = np.array([2 if k > 127 else int(chr(k).isalnum()) for k in range(256)], np.uint8)
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Ids of words in a language; those of its vocabulary come after. A range is a language's number and a number of its own.
UNKNOWN, BEGIN, FIRST = 0, 1, 2
OWN = 20
BLOCKS = "block long, lang long, n_keys long, n_words long, n_texts long, keys binary, counts binary, every binary, words binary, texts array<binary>"
ASKED = "block long, range long, size long, keys binary, values array<binary>"
ANSWERED = "block long, range long, size long, values array<binary>, stats array<long>"
LOGS = "h1 long, h2 long, log_ppl double, log_low double"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def edges(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined, where words begin and end there, and how many each text has."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n" + b"\n".join(parts) + b"\n" * 9
    blank = IS_BLANK[np.frombuffer(joined, np.uint8)]
    found = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = found[0::2], found[1::2]
    bounds = np.cumsum([1, *(len(x) + 1 for x in parts)])
    return joined, starts, ends, np.diff(np.searchsorted(starts, bounds)).astype(np.int64)


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, and how many each has; the last bit tells whether a word has a letter or digit.

    All words of a few texts are hashed together, eight bytes at a time. Longer words than ``LONG`` bytes are hashed one by one.
    """
    import xxhash

    joined, starts, ends, n = edges(texts)
    data = np.frombuffer(joined, np.uint8)
    if not len(starts):
        return np.zeros(0, np.uint64), n
    eight = np.ndarray(len(data) - 7, "<u8", joined, strides=(1,))
    size = ends - starts
    h = mixed(size.astype(np.uint64))
    at = np.arange(len(starts))
    for k in range(0, min(int(size.max()), LONG), 8):
        at = at[size[at] > k]
        h[at] = mixed((h[at] + np.uint64(k)) ^ (eight[starts[at] + k] & FIRST_BYTES[np.minimum(size[at] - k, 8)]))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]])
    kind = np.bitwise_or.reduceat(KIND[data], starts)
    letters = kind & 1 > 0
    other = np.flatnonzero(kind == 2)  # words of signs and of characters beyond ASCII: whether these are letters is looked up once each
    if len(other):
        _, first, back = np.unique(h[other], return_index=True, return_inverse=True)
        found = [SIGNS.fullmatch(joined[starts[i] : ends[i]].decode("utf-8", "surrogatepass")) is None for i in other[first].tolist()]
        letters[other] = np.array(found)[back]
    return h & ~np.uint64(1) | letters, n


def packed(x: np.ndarray) -> bytes:
    """Numbers as bytes: first the lowest byte of each, then the next, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, kind: type = np.uint64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * width, codec="zstd", asbytes=True), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


@dataclass
class Model:
    """The documents that a model is made of, with what comes to the driver of them: languages and how many words each has."""

    docs: DataFrame
    lang: str
    text: str
    min_word: float = MIN_WORD
    min_pair: float = MIN_PAIR
    #: language -> number; number 0 is all others
    langs: dict[str, int] = field(default_factory=dict)
    n_words: list[int] = field(default_factory=lambda: [0])

    def least(self, share: float) -> list[float]:
        """By language: how often a word or pair has to stand."""
        return [max(2.0, share * len(self.n_words) * n) for n in self.n_words]

    def bits(self) -> list[int]:
        """By language: the first bits of a hash that give its range."""
        return [max(1, math.ceil(math.log2(n / RANGE))) if n else 1 for n in self.n_words]

    def number(self, lang: Column) -> Column:
        known = [F.lit(x) for kv in self.langs.items() for x in kv]
        return F.coalesce(F.create_map(*known)[lang.cast("string")], F.lit(0)) if known else F.lit(0)


@dataclass
class Sums:
    """By language: discounts of pairs; discounts, number of words and number of pairs for single words; words out of the vocabulary."""

    pairs: list[np.ndarray] = field(default_factory=list)
    single: list[tuple[np.ndarray, float, float, float]] = field(default_factory=list)
    rest: list[float] = field(default_factory=list)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", min_word: float = MIN_WORD, min_pair: float = MIN_PAIR) -> Model:
    """The model of all documents. Null and rare languages count as one, null texts have no words. Words and pairs are counted when
    documents are scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(edges(piece.column(1).to_pylist())[3])], names=["lang", "n"])

    counted = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(run, "lang string, n long")
    counted = written(counted.groupBy("lang").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n").alias("n")).first().n or 0
    model = Model(docs, lang, text, min_word, min_pair)
    if total:
        often = counted.filter((F.col("n") >= MIN_LANG * total) & (F.col("lang") != "")).orderBy("lang").collect()  # at most 1 / MIN_LANG
        model.langs = {r.lang: k for k, r in enumerate(often, 1)}
        model.n_words = [total - sum(r.n for r in often), *(r.n for r in often)]
    discard(counted)
    return model


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``BLOCKS`` of (lang, text, h1, h2, train): texts of one language as their distinct hashes, counts of these in the texts for training
    and in all, and the words as places in the hashes, which are numbered by falling count. Texts without words are left out."""
    held: dict[int, list[tuple]] = {}
    size: dict[int, int] = {}

    def flush(k: int) -> pa.RecordBatch:
        parts = held.pop(k)
        size.pop(k)
        h, n, train, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, at, every = np.unique(h, return_inverse=True, return_counts=True)
        own = every if train.all() else np.bincount(at, np.repeat(train, n), len(keys))
        place = np.empty(len(keys), np.uint32)
        place[by_count(every)] = np.arange(len(keys), dtype=np.uint32)
        del parts, h
        texts = [packed(n), packed(train.astype(np.uint8)), packed(h1), packed(h2)]
        row = (uuid.uuid4().int >> 66, k, len(keys), len(at), len(n), packed(np.diff(keys, prepend=np.uint64(0))), packed(own.astype(np.uint32)), packed(every.astype(np.uint32)), packed(place[at]), texts)
        return batch(BLOCKS, [row])

    for piece in slices(batches):
        lang, h1, h2, train = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "h1", "h2", "train"))
        h, n = hashed(piece.column("text").to_pylist())
        owner = np.repeat(lang, n)
        for k in np.unique(owner).tolist():
            mine = (lang == k) & (n > 0)
            held.setdefault(k, []).append((h[owner == k], n[mine], train[mine], h1[mine], h2[mine]))
            size[k] = size.get(k, 0) + int(n[mine].sum())
            if size[k] >= BLOCK:
                yield flush(k)
        while sum(size.values()) > HELD:
            yield flush(max(size, key=size.get))
    for k in list(held):
        yield flush(k)
    tidy()


def by_count(every: np.ndarray) -> np.ndarray:
    return np.argsort(-every.astype(np.int64), kind="stable")


def asked(block: int, lang: int, of: np.ndarray, keys: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``ASKED`` of one block: its keys and their values by range; ``of`` are the ranges, in rising order, and keys rise in each."""
    ranges, first = np.unique(of, return_index=True)
    ends = [*first[1:].tolist(), len(of)]
    rows = [
        (block, (lang << OWN) + int(k), j - i, packed(np.diff(keys[i:j], prepend=np.uint64(0))), [packed(v[i:j]) for v in values])
        for k, i, j in zip(ranges.tolist(), first.tolist(), ends, strict=True)
    ]
    for at in range(0, len(rows), 100):
        yield batch(ASKED, rows[at : at + 100])


def answered(asks: DataFrame, rule: Callable[[int, list[np.ndarray]], tuple[list[np.ndarray], list[int]]], counted_by_one: bool = False) -> DataFrame:
    """``ANSWERED``: what ``rule`` makes of the sums of each key's values over all blocks, in the order in which each block asked. It takes
    the language and the sums of the range's keys, in their order, and gives values by key and numbers of the range. With
    ``counted_by_one`` values are doubled, and one of the blocks that ask for a key gets one more."""

    def run(rows: pa.Table) -> pa.Table:
        size = rows.column("size").to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(x, n), dtype=np.uint64) for x, n in zip(rows.column("keys").to_pylist(), size, strict=True)])
        keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
        keys = len(keys)
        parts = rows.column("values").to_pylist()
        sums = [np.bincount(at, np.concatenate([unpacked(p[k], n, np.uint32) for p, n in zip(parts, size, strict=True)]), keys).astype(np.int64) for k in range(len(parts[0]))]
        values, stats = rule(rows.column("range")[0].as_py() >> OWN, sums)
        ends = np.cumsum(size)
        values = [v.astype(np.uint64)[at] for v in values]
        if counted_by_one:
            values = [2 * v for v in values]
            for v in values:
                v[first] += np.uint64(1)
        out = [[packed(v[e - n : e]) for v in values] for e, n in zip(ends.tolist(), size, strict=True)]
        columns = [*(rows.column(c).combine_chunks() for c in ("block", "range", "size")), pa.array(out, pa.list_(pa.binary())), pa.array([stats] + [None] * (len(size) - 1), pa.list_(pa.int64()))]
        del keys, first, at, parts, sums, values, out
        tidy()
        return pa.table(columns, names=["block", "range", "size", "values", "stats"])

    return written(asks.groupBy("range").applyInArrow(run, ANSWERED))


def totals(answers: DataFrame, n: int) -> dict[int, list[int]]:
    """By language: sums of the numbers of all ranges, and the greatest last one."""
    stats = F.col("stats")
    rows = answers.filter(stats.isNotNull()).groupBy(F.shiftright("range", OWN).alias("lang"))
    return {r.lang: list(r[1:]) for r in rows.agg(*(F.sum(stats[k]).alias(f"s{k}") for k in range(n)), F.max(stats[n - 1]).alias("most")).collect()}


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from the counts of counts."""
    n = [0, n1, n2, n3, n4]
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1 * k), 0.9 * k) if n[k] else 0.5 * k for k in (1, 2, 3))])


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


class Block:
    """A block with the answers that it has so far."""

    def __init__(self, row: dict, answers: pa.Table, bits: list[int], width: int):
        self.lang = row["lang"]
        self.bits = bits[self.lang]
        self.width = width
        self.answers = answers.sort_by([("round", "ascending"), ("range", "ascending")]).to_pylist()
        every = unpacked(row["every"], row["n_keys"], np.uint32)
        self.n, train, self.h1, self.h2 = (unpacked(x, row["n_texts"], k) for x, k in zip(row["texts"], (np.int64, np.uint8, np.int64, np.int64), strict=True))
        self.starts = np.cumsum(self.n) - self.n
        self.train = np.repeat(train, self.n)
        known = [r for r in self.answers if r["round"] == 1]
        ids = np.concatenate([self.ids(r) for r in known])
        self.words = np.concatenate([np.array([UNKNOWN, BEGIN], np.uint64), ids[ids > 0]])
        b = ids[by_count(every)][unpacked(row["words"], row["n_words"], np.uint32)]
        a = np.concatenate([b[:1], b[:-1]])
        a[self.starts] = BEGIN
        a <<= np.uint64(32)
        a |= b
        del b
        self.pairs, self.at = np.unique(a, return_inverse=True)
        del a
        self.at = self.at.astype(np.int32)
        a, b = self.pairs >> np.uint64(32), self.pairs & np.uint64((1 << 32) - 1)
        self.first, self.second = np.searchsorted(self.words, a), np.searchsorted(self.words, b)
        of = (a + b) & np.uint64((1 << self.bits) - 1)  # gives the last bits of b where a is known, and spreads the pairs of frequent words
        self.order = np.argsort(of, kind="stable")
        self.of = of[self.order]
        self.keys = ((a << np.uint64(32)) | (b >> np.uint64(self.bits)))[self.order]

    def ids(self, r: dict) -> np.ndarray:
        """The ids of a range's words, 0 for those out of the vocabulary."""
        place = unpacked(r["values"][0], r["size"])
        own = r["range"] & ((1 << OWN) - 1)
        return np.where(place > 0, place + np.uint64(FIRST - 1 + (own << self.width)), np.uint64(0))

    def own_pairs(self) -> np.ndarray:
        """How often each pair stands in the texts for training."""
        return np.bincount(self.at, self.train, len(self.pairs)).astype(np.uint32)

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each pair stands in all blocks, and whether this is the one to count it."""
        found = np.concatenate([unpacked(r["values"][0], r["size"]) for r in self.answers if r["round"] == 2])
        out = np.empty_like(found)
        out[self.order] = found
        return (out >> np.uint64(1)).astype(np.int64), (out & np.uint64(1)) > 0

    def word_sums(self, least: float) -> list[np.ndarray]:
        """By word: as contexts, what its kept pairs sum up to, and how many of them stand twice and more often, and its count; words before it."""
        c, mine = self.all_pairs()
        kept = mine & (c >= least)
        by = lambda at, x: np.bincount(at, x, len(self.words)).astype(np.uint32)
        return [by(self.first, kept * c), by(self.first, kept & (c == 2)), by(self.first, kept & (c > 2)), by(self.first, self.own_pairs()), by(self.second, mine & (c > 0))]

    def word_ranges(self) -> np.ndarray:
        return np.where(self.words < FIRST, 0, (self.words - np.uint64(FIRST)) >> np.uint64(self.width))

    def logs(self, sums: Sums, least: float) -> Iterator[pa.RecordBatch]:
        """``LOGS`` of the texts, per word."""
        c, _ = self.all_pairs()
        last = [r for r in self.answers if r["round"] == 3]
        total, twice, more, n, before = (np.concatenate([unpacked(r["values"][k], r["size"]) for r in last]).astype(np.float64) for k in range(5))
        off, (d, kinds, seen, left) = sums.pairs[self.lang], sums.single[self.lang]
        alone = np.where(before > 0, (before - d[np.minimum(before, 3).astype(int)]) / max(seen, 1) + left / max(seen, 1) / (kinds + 1), 1e-9)[self.second]
        rest = np.where(n > 0, np.maximum(1 - (total - off[2] * twice - off[3] * more) / np.maximum(n, 1), 1e-9), 1.0)[self.first]
        p = np.where(c >= least, (c - off[np.minimum(c, 3)]) / np.maximum(n[self.first], 1), 0.0) + rest * alone
        shared = np.where(self.pairs & np.uint64((1 << 32) - 1) == UNKNOWN, np.log(sums.rest[self.lang]), 0.0)
        ppl, low = (-np.add.reduceat((np.log(x) - shared)[self.at], self.starts) / self.n for x in (p, alone))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.h1, self.h2, ppl, low)], names=["h1", "h2", "log_ppl", "log_low"])


def text_logs(docs: DataFrame, model: Model, lang: str, text: str) -> DataFrame:
    """``LOGS``, written: the mean negative log-probability of a text's words, after the word before and alone, by hashes of language and text.

    Texts that the model is not made of are asked for along with its own, but count nothing.
    """
    spark = docs.sparkSession
    rows = lambda df, name, body, train: df.select(model.number(F.col(name)).cast("long").alias("lang"), F.col(body).cast("string").alias("text"), *text_hashes(F.col(name), F.col(body)), F.lit(train).alias("train"))
    every = rows(model.docs, model.lang, model.text, True)
    if docs is not model.docs:
        every = every.unionByName(rows(docs, lang, text, False))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * sum(model.n_words) // BLOCK))
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    # a block is a row of its own file, of some MB; by buckets it meets its answers without being shuffled
    every.mapInArrow(filled, BLOCKS).write.bucketBy(buckets, "block").option("path", path).option("maxRecordsPerFile", 4).option("compression", "none").saveAsTable(name)
    blocks = spark.table(name)
    bits = model.bits()
    n_langs = len(bits)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys = np.cumsum(unpacked(r["keys"], r["n_keys"]), dtype=np.uint64)
                yield from asked(r["block"], r["lang"], keys >> np.uint64(64 - bits[r["lang"]]), keys, [unpacked(r["counts"], r["n_keys"], np.uint32)])
        tidy()

    least_word, least_pair = model.least(model.min_word), model.least(model.min_pair)

    def word_rule(lang: int, sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
        known = sums[0] >= least_word[lang]
        return [np.where(known, np.cumsum(known), 0)], [int((sums[0] > 0).sum()), int(known.sum())]

    ans = [answered(blocks.select("block", "lang", "n_keys", "keys", "counts").mapInArrow(ask_words, ASKED), word_rule)]
    found = totals(ans[0], 2)
    width = max([r[2] for r in found.values()], default=0).bit_length()
    if any(FIRST + (1 << bits[k] + width) >= 1 << 32 for k in found):
        raise ValueError("a language has more than 2^31 words in its vocabulary")
    sums = Sums(rest=[max(float(found[k][0] - found[k][1]), 1.0) if k in found else 1.0 for k in range(n_langs)])

    def met(f: Callable[[dict, Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = pa.Table.from_batches([x for r in left.to_pylist() for x in f(r, Block(r, right, bits, width))])
            tidy()
            return out

        answers = ans[0].withColumn("round", F.lit(1))
        for k, x in enumerate(ans[1:], 2):
            answers = answers.unionByName(x.withColumn("round", F.lit(k)))
        return blocks.drop("keys", "counts").groupBy("block").cogroup(answers.drop("stats").groupBy("block")).applyInArrow(run, schema)

    def pair_rule(lang: int, sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
        return sums, counts_of_counts(sums[0])

    def ask_pairs(r: dict, b: Block) -> Iterator[pa.RecordBatch]:
        return asked(r["block"], r["lang"], b.of, b.keys, [b.own_pairs()[b.order]])

    ans.append(answered(met(ask_pairs, ASKED), pair_rule, counted_by_one=True))
    found = totals(ans[1], 4)
    sums.pairs = [discounts(*found[k][:4]) if k in found else discounts(0, 0, 0, 0) for k in range(n_langs)]

    def sum_rule(lang: int, sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
        return sums, [*counts_of_counts(sums[4]), int((sums[4] > 0).sum()), int(sums[4].sum())]

    def ask_sums(r: dict, b: Block) -> Iterator[pa.RecordBatch]:
        return asked(r["block"], r["lang"], b.word_ranges(), b.words, b.word_sums(least_pair[r["lang"]]))

    ans.append(answered(met(ask_sums, ASKED), sum_rule))
    found = totals(ans[2], 6)
    for k in range(n_langs):
        n1, n2, n3, n4, kinds, seen = found[k][:6] if k in found else [0] * 6
        d = discounts(n1, n2, n3, n4)
        sums.single.append((d, kinds, seen, d[1] * n1 + d[2] * n2 + d[3] * (kinds - n1 - n2)))
    logs = met(lambda r, b: b.logs(sums, least_pair[r["lang"]]), LOGS)
    out = written(logs.groupBy("h1", "h2").agg(F.min("log_ppl").alias("log_ppl"), F.min("log_low").alias("log_low")))
    spark.sql(f"DROP TABLE {name}")
    removed(spark, [path])
    discard(*ans)
    return out


def text_hashes(lang: Column, text: Column) -> list[Column]:
    """Two hashes of a row's language and text."""
    x, y = F.coalesce(lang.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(x, y).alias("h1"), F.xxhash64(y, x).alias("h2")]


def repeated(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For texts of ``n`` words, the words in 3-word windows that stand in the text twice or more."""
    owner = np.repeat(np.arange(len(n)), n)
    out = np.zeros(len(n), np.int64)
    if len(h) < 3:
        return out
    w = mixed(mixed(mixed(h[:-2]) + h[1:-1]) + h[2:])
    inside = owner[:-2] == owner[2:]
    at = np.flatnonzero(inside)
    w = mixed(w[at] + mixed(owner[at].astype(np.uint64) + np.uint64(7)))
    order = np.argsort(w)
    same = w[order][1:] == w[order][:-1]
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    again = np.zeros(len(h), bool)
    for k in range(3):
        again[at[twice] + k] = True
    return np.bincount(owner[again], minlength=len(n))


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def measured(texts: list[str | None]) -> list[pa.Array]:
    """The columns of ``COUNTS`` for a few texts."""
    h, n = hashed(texts)
    texts = [t or "" for t in texts]
    full, signs = n > 0, n.copy()
    if full.any():
        signs[full] -= np.add.reduceat((h & np.uint64(1)).astype(np.int64), (np.cumsum(n) - n)[full])
    chars = [len(t) - sum(map(t.count, BLANKS)) for t in texts]
    symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
    return [pa.array(n), pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()), pa.array(list(map(repeated_lines, texts)), pa.int64()), pa.array(repeated(h, n)), pa.array(signs)]


def measures(text: Column) -> Column:
    """The struct of counts of a text."""

    @F.arrow_udf(COUNTS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [pa.StructArray.from_arrays(measured(texts[at : at + 256].to_pylist()), names=COUNTED) for at in range(0, len(texts), 256)]
            yield pa.concat_arrays(out) if out else pa.StructArray.from_arrays([pa.array([], pa.int64()) for _ in COUNTED], names=COUNTED)
        tidy()

    return run(text.cast("string"))


def base_failed(m: Column) -> Column:
    """Too few words, or too many in repeated windows."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def sign_failed(m: Column) -> Column:
    """Too many words without a letter or digit."""
    return 100 * m["n_sign_words"] > MOST_SIGNS * m["n_words"]


def bands(rows: DataFrame, model: Model, lang: Column, m: Column, below: float = BELOW, above: float = ABOVE, above_alone: float = ABOVE_ALONE) -> tuple[Column, Column, Column]:
    """The least ``log_low``, the greatest ``log_ppl`` and the greatest ``log_low`` of a row's language, from the documents that pass the rules."""
    number = model.number(lang)
    once = rows.filter(~base_failed(m) & ~sign_failed(m)).select(number.alias("k"), m["n_words"].alias("n"), F.round(m["log_ppl"], 6).alias("x"), F.round(m["log_low"], 6).alias("y")).distinct()
    quartiles = [F.percentile_approx(x, [0.5, 0.75], 10000).alias(x) for x in ("x", "y")]
    found = once.groupBy("k").agg(*quartiles).collect()  # a row for each language

    def edge(of: str, distances: float) -> Column:
        at = [F.lit(v) for r in found for v in (r.k, float(r[of][0] + distances * (r[of][1] - r[of][0])))]
        return F.create_map(*at)[number] if at else F.lit(None).cast("double")

    return edge("y", -below), edge("x", above), edge("y", above_alone)


def verdict(m: Column, lower: Column, upper: Column, upper_alone: Column) -> Column:
    """Kept: passes the base rules and that of signs and lies in its language's bands."""
    ppl, alone = F.round(m["log_ppl"], 6), F.round(m["log_low"], 6)
    return F.coalesce(~base_failed(m) & ~sign_failed(m) & (alone >= lower) & (ppl <= upper) & (alone <= upper_alone), F.lit(False))


def score(docs: DataFrame, model: Model, lang: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` with a struct ``quality``: counts and log-perplexity. Other columns stay.

    Null or blank texts have zero counts and null log-perplexity; very long texts are measured whole; repeated rows are scored
    each; an empty table stays empty. If ``docs`` has a column ``quality``, it stays and the struct is named ``quality_``.
    """
    name, *extra = (free_name(docs, x) for x in ("quality", "counts", "text_h1", "text_h2"))
    logs = text_logs(docs, model, lang, text)
    h1, h2 = text_hashes(F.col(lang), F.col(text))
    rows = docs.select("*", measures(F.col(text)).alias(extra[0]), h1.alias(extra[1]), h2.alias(extra[2]))
    rows = rows.join(logs.withColumnsRenamed({"h1": "other_h1", "h2": "other_h2"}).select("other_h1", "other_h2", F.struct("log_ppl", "log_low").alias("logs")), (F.col(extra[1]) == F.col("other_h1")) & (F.col(extra[2]) == F.col("other_h2")), "left")
    whole = F.struct(*(F.col(extra[0])[x].alias(x) for x in COUNTED), F.col("logs")["log_ppl"].alias("log_ppl"), F.col("logs")["log_low"].alias("log_low"))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), whole.alias(name))


def keep(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The documents that pass the rules and their language's bands, with their own columns. Each text is measured once."""
    packed_rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    model = fit(packed_rows)
    rows = written(score(packed_rows, model).select("row", "quality"))
    return rows.filter(verdict(F.col("quality"), *bands(rows, model, F.col("row")[lang], F.col("quality")))).select("row.*")
