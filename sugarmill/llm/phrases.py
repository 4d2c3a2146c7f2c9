"""Phrase collocations by SON partitioning.

Documents are tokenised once into blocks of bounded size, and blocks belong to a few shards (by the input partition that they come from).
A phrase that reaches the global support reaches, in at least one shard, the support lowered to the shard's share of its
language's words. So each shard is mined completely at its own support, level by level: pairs first, then triples of which both
pairs are frequent there. The locally frequent phrases of all shards are united as candidates, and a last pass counts those,
and no others, over all documents. Support is absolute, so a shard prunes only where its share leaves a support of 2 or
more; hence few shards, each of which is many blocks and tasks, not one task.

While mining, 64-bit hashes stand for phrases, stated by each block once with their counts, packed by ranges of hashes and summed
range by range. What is frequent comes back as filters with a bit for each of ``2 ** FILTER_BITS`` ranges of hashes, so their size is fixed.
Hashes that meet by chance only add candidates; the last count is of exact words, as hashes of words are tested for being distinct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sugarmill.llm.common import slices, tidy, written
from sugarmill.llm.lm_scoring import packed, pair_hashes, unpacked

SUPPORT, SHARE, BEST = 10, 50, 2000
SHARDS = 2
#: Tokens of a block, about; bytes of text looked at once; hashes of a range, about.
BLOCK_TOKENS, CHUNK, RANGE = 1_500_000, 1 << 20, 2_000_000
#: Hashes that a task holds until it states them, each once.
HELD = 1_500_000
#: A filter has 2 ** 27 bits (16 MB); there is one for each shard and level.
FILTER_BITS = 27
#: Languages and shards whose totals are broadcast; more are joined by shuffling.
TOTALS = 10_000
SEPARATORS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
TOKEN = re.compile(rb"[^ \t\n]+|\n")
BLOCKS = "lang string, shard int, n long, words array<string>, counts array<long>, size long, ids binary"


class Ids(dict):
    """Numbers of words in the order of their coming; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def chunks(data: bytes) -> Iterator[bytes]:
    """A text in parts that end where a piece ends."""
    at = 0
    while len(data) - at > CHUNK and (end := data.find(b"\n", at + CHUNK)) >= 0:
        yield data[at : end + 1]
        at = end + 1
    yield data[at:]


def tokenised(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """``BLOCKS`` of (lang, text) rows."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() % shards
    held: dict[str, tuple[Ids, list[np.ndarray]]] = {}
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (ids, parts) in held.items():
            x = np.concatenate(parts)
            counts = np.bincount(x, minlength=len(ids))[1:]
            words = [w.decode() for w in ids][1:]
            row = [lang, shard, int(counts.sum()), words, counts.tolist(), len(x), pa.compress(x.tobytes(), codec="zstd", asbytes=True)]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["lang", "shard", "n", "words", "counts", "size", "ids"])
        held.clear()

    for piece in slices(batches):
        for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
            for part in chunks((text or "").encode("utf-8", "surrogatepass").lower().translate(SEPARATORS)):
                found = TOKEN.findall(part)
                ids, parts = held.setdefault(lang, (Ids({b"\n": 0}), []))
                parts.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
                n += len(found)
                if n >= BLOCK_TOKENS:
                    yield from flush()
                    n = 0
            if lang in held:
                held[lang][1].append(np.zeros(1, np.int32))  # no phrase goes from one text to the next
    yield from flush()
    tidy()


class Block:
    """One row of ``BLOCKS``: hashes of its words by id, and its distinct pairs in place of positions."""

    def __init__(self, words: list[str], size: int, ids: bytes, seed: int) -> None:
        self.ids = np.frombuffer(pa.decompress(ids, size * 4, codec="zstd", asbytes=True), np.int32).astype(np.int64)
        self.base = len(words) + 1
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in ["", *words]), np.uint64, self.base)
        at = np.flatnonzero((self.ids[:-1] > 0) & (self.ids[1:] > 0))
        self.pairs, of, self.pair_counts = np.unique(self.ids[at] * self.base + self.ids[at + 1], return_inverse=True, return_counts=True)
        self.pair_at = np.full(len(self.ids), -1, np.int64)
        self.pair_at[at] = of
        self.pair_hashes = pair_hashes(self.hashes[self.pairs // self.base], self.hashes[self.pairs % self.base])

    def triples(self, pair_passes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first pair, last word, count) of the distinct triples of which both pairs pass."""
        ok = np.append(pair_passes, False)[self.pair_at]  # -1 is the False at the end
        at = np.flatnonzero(ok[:-1] & ok[1:])
        keys, counts = np.unique(self.pair_at[at] * self.base + self.ids[at + 2], return_counts=True)
        return keys // self.base, keys % self.base, counts

    def triple_hashes(self, pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
        return pair_hashes(self.pair_hashes[pairs], ~self.hashes[words])


def in_language(hashes: np.ndarray, lang: str) -> np.ndarray:
    return pair_hashes(hashes, np.full(len(hashes), xxhash.xxh64_intdigest(lang), np.uint64))


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash is in a filter."""
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


STATED = "span long, shard int, least long, size long, keys binary, counts binary"


def stated(hashes: np.ndarray, counts: np.ndarray, shard: int, least: int, span_bits: int) -> pa.RecordBatch:
    """``STATED`` rows of hashes with counts: one for each range of hashes that has any."""
    order = np.argsort(hashes)
    keys, c = hashes[order], counts[order].astype(np.uint64)
    edges = np.arange(1, 1 << span_bits, dtype=np.uint64) << np.uint64(64 - span_bits) if span_bits else np.zeros(0, np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    rows = [(k, shard, least, j - i, packed(np.diff(keys[i:j], prepend=np.uint64(0))), packed(c[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], names=["span", "shard", "least", "size", "keys", "counts"])


FREQUENT = "span long, shard int, n long, bits binary"


def frequent(rows: pa.Table, span_bits: int) -> pa.Table:
    """``FREQUENT`` rows of one range of hashes: for each shard how many hashes reach its support, and their part of its filter."""
    out = []
    span = rows.column("span")[0].as_py()
    for shard in sorted(set(rows.column("shard").to_pylist())):
        own = rows.filter(pc.equal(rows.column("shard"), shard))
        size = own.column("size").to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(x, n), dtype=np.uint64) for x, n in zip(own.column("keys").to_pylist(), size, strict=True)])
        c = np.concatenate([unpacked(x, n) for x, n in zip(own.column("counts").to_pylist(), size, strict=True)]).astype(np.int64)
        least = np.repeat(np.array(own.column("least").to_pylist(), np.int64), size)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        good = np.add.reduceat(c[order], first) >= np.minimum.reduceat(least[order], first)
        at = (keys[first[good]] >> np.uint64(64 - FILTER_BITS)) & np.uint64((1 << (FILTER_BITS - span_bits)) - 1)
        bits = np.zeros(1 << (FILTER_BITS - span_bits), np.uint8)
        bits[at] = 1
        out.append((span, shard, int(good.sum()), pa.compress(np.packbits(bits, bitorder="little").tobytes(), codec="zstd", asbytes=True)))
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["span", "shard", "n", "bits"])


def filters(said: DataFrame, shards: int, span_bits: int) -> list[np.ndarray]:
    """A filter of the locally frequent hashes for each shard. What comes to the driver is the filters, whatever the input."""
    part = 1 << (FILTER_BITS - span_bits - 3)
    out = [np.zeros(1 << (FILTER_BITS - 3), np.uint8) for _ in range(shards)]
    for r in said.groupBy("span").applyInArrow(lambda rows: frequent(rows, span_bits), FREQUENT).toLocalIterator():
        out[r["shard"]][r["span"] * part : (r["span"] + 1) * part] = np.frombuffer(pa.decompress(r["bits"], part, codec="zstd", asbytes=True), np.uint8)
    return out


def each_block(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, Block(row.pop("words"), row["size"], row.pop("ids"), seed)
    tidy()


class Held:
    """What a task has counted and not yet handed on, by language, shard and support: hashes, counts, and columns that belong to a hash."""

    def __init__(self) -> None:
        self.parts: dict[tuple[str, int, int], list[tuple[np.ndarray, ...]]] = {}
        self.size = 0

    def add(self, row: dict, *columns: np.ndarray) -> bool:
        """Takes hashes, counts and more; whether it holds enough to hand on."""
        self.parts.setdefault((row["lang"], row["shard"], row["least"]), []).append(columns)
        self.size += len(columns[0])
        return self.size > HELD

    def merged(self) -> Iterator[tuple[tuple[str, int, int], list[np.ndarray]]]:
        """Each key with its columns, a hash once with the sum of its counts. Hashes that meet by chance stay apart where columns differ."""
        for key, parts in self.parts.items():
            hashes, counts, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
            kept, first, of = np.unique(hashes, return_index=True, return_inverse=True)
            if all((x[first][of] == x).all() for x in more):
                yield key, [kept, np.bincount(of, counts, len(kept)).astype(np.int64), *(x[first] for x in more)]
            else:
                yield key, [hashes, counts, *more]
        self.parts, self.size = {}, 0


def counted(blocks: DataFrame, support: int, shards: int, seed: int) -> DataFrame:
    """(lang, h1, h2, h3, a): all phrases of two or three words that occur ``support`` times or more in a language, as hashes of words."""
    spark = blocks.sparkSession
    shares = blocks.groupBy("lang", "shard").agg(F.sum("n").alias("own"))
    least = written(shares.withColumn("n", F.sum("own").over(Window.partitionBy("lang"))).filter("n > 0").select("lang", "shard", F.expr(f"greatest(1, ({support} * own + n - 1) div n)").alias("least")))
    rows = blocks.select("lang", "shard", "words", "size", "ids").join(F.broadcast(least) if least.count() <= TOTALS else least, ["lang", "shard"])
    total = blocks.agg(F.sum("n")).first()[0] or 0
    span_bits = min(FILTER_BITS - 3, max(0, ceil(log2(max(1, total) / RANGE))))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for row, b in each_block(batches, seed):
            if held.add(row, in_language(b.pair_hashes, row["lang"]), b.pair_counts):
                yield from (stated(h, c, shard, least, span_bits) for (_, shard, least), (h, c) in held.merged())
        yield from (stated(h, c, shard, least, span_bits) for (_, shard, least), (h, c) in held.merged())

    two = filters(rows.mapInArrow(pairs, STATED), shards, span_bits)
    sent = [spark.sparkContext.broadcast(x) for x in two]

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for row, b in each_block(batches, seed):
            p, w, n = b.triples(passes(in_language(b.pair_hashes, row["lang"]), sent[row["shard"]].value))
            if held.add(row, in_language(b.triple_hashes(p, w), row["lang"]), n):
                yield from (stated(h, c, shard, least, span_bits) for (_, shard, least), (h, c) in held.merged())
        yield from (stated(h, c, shard, least, span_bits) for (_, shard, least), (h, c) in held.merged())

    three = filters(rows.mapInArrow(triples, STATED), shards, span_bits)
    any_two, any_three = (spark.sparkContext.broadcast(np.bitwise_or.reduce(x)) for x in (two, three))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, three = Held(), Held()

        def flush() -> Iterator[pa.RecordBatch]:
            for held in (two, three):
                for (lang, _, _), (_, c, *words) in held.merged():
                    last = [pa.array(x) for x in words] if held is three else [*(pa.array(x) for x in words), pa.nulls(len(c), pa.int64())]
                    columns = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(c), np.int32)), [lang]).dictionary_decode(), *last, pa.array(c)]
                    for at in range(0, len(c), 100_000):
                        yield pa.RecordBatch.from_arrays([x.slice(at, 100_000) for x in columns], names=["lang", "h1", "h2", "h3", "c"])

        for row, b in each_block(batches, seed):
            row |= {"shard": 0, "least": 0}  # counts are of all shards
            h = b.hashes.view(np.int64)
            words = lambda x, b=b, h=h: (h[b.pairs[x] // b.base], h[b.pairs[x] % b.base])
            own = in_language(b.pair_hashes, row["lang"])
            ok = passes(own, any_two.value)
            p, w, n = b.triples(ok)
            own_three = in_language(b.triple_hashes(p, w), row["lang"])
            good = passes(own_three, any_three.value)
            p, w = p[good], w[good]
            full = two.add(row, own[ok], b.pair_counts[ok], *words(np.flatnonzero(ok)))
            if three.add(row, own_three[good], n[good], *words(p), h[w]) or full:
                yield from flush()
        yield from flush()

    found = rows.mapInArrow(candidates, "lang string, h1 long, h2 long, h3 long, c long")
    out = written(found.groupBy("lang", "h1", "h2", "h3").agg(F.sum("c").alias("a")).filter(F.col("a") >= support))
    for x in (*sent, any_two, any_three):
        x.unpersist()
    return out


def score(a: str, left: str, right: str) -> str:
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits."""
    wide = lambda x: f"cast({x} as decimal(19,0))"
    return f"(cast(1000000 as decimal(7,0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})"


def mine(docs: DataFrame, support: int = SUPPORT, share: int = SHARE, best: int = BEST, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``best`` phrases of each language.

    A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and at line ends, words at spaces and tabs. Phrases have two or three words and occur
    ``a >= support`` times within pieces. Of the cuts of a phrase in two parts, which occur l and r times, the one with the lowest
    score floor(10^6 a^2 / (l r)) counts, ties to the shorter left part. A phrase goes if a longer one that holds it has at least ``share``
    percent of its occurrences. n is the language's number of words. Order: score and a descending, then the phrase by its bytes.

    Null languages are ``und``, null texts are empty; each repeated row counts; ids and other columns are not read. No rows, or none
    with a phrase of that support, give none.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    blocks = written(texts.mapInArrow(lambda x: tokenised(x, shards), BLOCKS), rows_per_file=4)
    one = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    words, salt = written(one), 0
    while True:  # hashes of words that differ must differ; a second round has a chance of 1 in 40 for 10^9 words
        hashed = words.withColumn("h", F.xxhash64("word") if not salt else F.xxhash64(F.lit(salt), "word"))
        if hashed.groupBy("lang", "h").count().filter("count > 1").isEmpty():
            break
        salt += 1
    seed = 42 if not salt else spark.range(1).select(F.xxhash64(F.lit(salt))).first()[0] % 2**64
    found = counted(blocks, support, shards, seed)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = hashed.filter(F.col("f") >= support)
    part = lambda k: known.select("lang", F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"))
    two = written(found.filter("h3 is null").select("lang", "h1", "h2", "a").join(part(1), ["lang", "h1"]).join(part(2), ["lang", "h2"]))
    three = found.filter("h3 is not null")
    inside = three.select("lang", "h1", "h2", "a").unionByName(three.select("lang", F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a")).groupBy("lang", "h1", "h2").agg(F.max("a").alias("longer"))
    pairs = two.join(inside, ["lang", "h1", "h2"], "left").filter(f"longer is null or 100 * longer < {share} * a")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), F.expr(score("a", "f1", "f2")).alias("score"))
    left = two.select("lang", "h1", "h2", F.concat_ws(" ", "w1", "w2").alias("begin"), "f1", F.col("a").alias("a12"))
    right = two.select("lang", F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("a23"))
    whole = three.join(left, ["lang", "h1", "h2"]).join(right, ["lang", "h2", "h3"]).withColumns({"s1": F.expr(score("a", "f1", "a23")), "s2": F.expr(score("a", "a12", "f3"))})
    triples = whole.select("lang", F.concat_ws(" ", "begin", "w3").alias("phrase"), "a", *(F.expr(f"if(s1 <= s2, {x}, {y})").alias(z) for x, y, z in (("f1", "a12", "l"), ("a23", "f3", "r"), ("s1", "s2", "score"))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each of 64 parts hold the first of all, so no task ranks all phrases of a language
    some = pairs.unionByName(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
