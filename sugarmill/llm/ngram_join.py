"""Exact Jaccard self-join of word n-gram sets by universe-partition pigeonhole.

Sets are put into bands by size; each band is a scheme for the pairs whose larger set is in it, so a set takes part in its own
band and in those that a larger set linked with it may be in. Sets that link differ in at most ``H`` n-grams, so when hashing deals the n-grams to more than ``H`` segments, one segment of both is the same.
A scheme has ``q`` more segments than that, so that a set with at most ``q`` empty ones has an equal segment which
is not empty; only sets with more empty ones also index those. For small sets an allocation by cost may instead
take segments that tolerate one difference, indexed with all their one-deletion neighbours, which count twice.

A set is indexed by the hash of each segment. Sets that meet in a bucket are candidates. First each is compared with the
bucket's smallest, its pivot. Buckets whose other sets still span several components are open; their sets form a group by
pivot, cut into blocks of bounded size, and blocks that span components are compared pair by pair of blocks, handing on a
forest of links. So rows grow with the documents, not with the pairs of a group. Texts with equal sets are one class from
the start.

All comparisons come in two steps. A sketch has a bit for each of a few hundred cells, the parity of the n-grams that fall
into it, so two sketches differ in no more bits than the sets differ in n-grams: a bound that is never wrong and sorts out most
pairs. What it lets pass is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sugarmill.llm.common import cut, discard, slices, tidy, written
from sugarmill.llm.components import components

#: Size bands grow by this factor.
RATIO = 1.5
#: Cost of a segment with at most one n-gram, in index rows.
THIN = 4.0
#: Bytes of sets, or of sketches, in a block of a group; a larger set is a block of its own.
BLOCK_BYTES, SKETCH_BYTES = 1_000_000, 500_000
#: Classes that a task indexes once only.
CLASSES_HELD = 200_000
#: Ids that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000
WORDS_HELD = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word n-grams, with a bounded memory of word hashes."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted 64-bit hashes of the distinct n-grams; a shorter text is one n-gram; no words, none."""
        import xxhash

        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        new = set(words).difference(self.words)
        if new:
            if len(self.words) + len(new) > WORDS_HELD:
                self.words, new = {}, set(words)
            for w in new:
                self.words[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - k + 1 + i])
        return np.unique(out)


    def hashed(self, words: list[bytes]) -> np.ndarray:
        """The words' hashes."""
        import xxhash

        new = set(words).difference(self.words)
        if new:
            if len(self.words) + len(new) > WORDS_HELD:
                self.words, new = {}, set(words)
            for w in new:
                self.words[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def many(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The sets of many lists of lower-case words, each of ``n`` words at least, one after the other, and their sizes."""
        h = self.hashed([w for t in texts for w in t])
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        grams = np.full(max(len(h) - self.n + 1, 0), self.n, np.uint64)
        for i in range(self.n):
            grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(grams)])
        owner = np.repeat(np.arange(len(texts)), size)
        inside = owner[: len(grams)] == owner[self.n - 1 :]
        grams, owner = grams[inside], owner[: len(grams)][inside]
        at = 0
        for k in (size - self.n + 1).tolist():
            grams[at : at + k].sort()
            at += k
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        return grams[first], np.bincount(owner[first], minlength=len(texts))


def fingerprints(grams: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The fingerprint of each of many sets that follow each other."""
    starts = np.cumsum(size) - size
    return (np.add.reduceat(mixed(grams ^ np.uint64(0x5851F42D4C957F2D)), starts) ^ size.astype(np.uint64)).astype(np.int64)


def fingerprint(grams: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int((mixed(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ np.uint64(len(grams))).astype(np.int64))


@dataclass(frozen=True)
class Scheme:
    """Sizes ``low`` to ``high`` with ``exact`` plain segments, then ``tolerant`` ones; ``spare`` of the plain ones may be empty."""

    number: int
    low: int
    high: int
    exact: int
    tolerant: int
    spare: int


def allocated(number: int, low: int, high: int, h: int) -> Scheme:
    """The cheapest allocation of segments for sets that differ in at most ``h`` n-grams."""
    size = (low + high) / 2
    m, q = h + 1, 0
    for _ in range(8):
        m = h + 1 + q
        empty = m * exp(-low / m) if m > 1 else 0.0
        q = ceil(empty + 4 * sqrt(empty) + 1) if m > 1 else 0
    m = h + 1 + q
    t = size / m
    best = (m * (1 + THIN * exp(-t) * (1 + t)), m, 0, q)
    if h <= 2:
        for tolerant in range(1, (h + 2) // 2 + 1):
            exact = max(0, h + 1 - 2 * tolerant)
            t = size / (exact + tolerant)
            best = min(best, (exact + tolerant * (1 + t) + (exact + tolerant) * THIN * exp(-t) * (1 + t), exact, tolerant, exact))
    return Scheme(number, low, high, best[1], best[2], best[3])


@lru_cache(maxsize=64)
def edges_until(size: int) -> list[int]:
    """First sizes of the bands, to above ``size``."""
    out = [1]
    while out[-1] <= size:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


@lru_cache(maxsize=100_000)
def schemes_of(size: int, percent: int) -> list[Scheme]:
    """The schemes that a set of this size takes part in."""
    edges = edges_until(1 << (2 * max(size, 1)).bit_length())
    found = []
    for k in range(len(edges) - 1):
        if edges[k + 1] > size and edges[k] * percent <= 100 * size:
            most = edges[k + 1] - 1
            found.append(cached_scheme(k, -(-edges[k] * percent // 100), most, (100 - percent) * 2 * most // (100 + percent)))
    return found


@lru_cache(maxsize=4096)
def cached_scheme(number: int, low: int, high: int, h: int) -> Scheme:
    return allocated(number, low, high, h)


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """The distinct index hashes of a set."""
    out = []
    for s in schemes_of(len(grams), percent):
        m = s.exact + s.tolerant
        salt = np.uint64(s.number * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        segment = ((mixed(grams ^ salt) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        weight = mixed(grams + np.uint64(1))
        order = np.argsort(segment, kind="stable")
        count = np.bincount(segment, minlength=m)
        at = np.concatenate([[0], np.cumsum(count)[:-1]])
        total = np.zeros(m, np.uint64)
        full = count > 0
        total[full] = np.add.reduceat(weight[order], at[full])
        key = (np.arange(m, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) ^ salt
        plain = np.arange(m) < s.exact
        use = full | ~plain if (~full & plain).sum() <= s.spare and s.exact > s.spare else np.ones(m, bool)
        out.append(mixed(total[use] ^ mixed(key[use])))
        if s.tolerant:
            less = ~plain[segment]
            out.append(mixed((total[segment] - weight)[less] ^ mixed(key[segment][less])))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def keyed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, fp, sigs) of every document; the index hashes stand only where a task first meets a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(n), set()
        for piece in slices(batches):
            sets = [shingle(t or "") for t in piece.column(1).to_pylist()]
            fps = [fingerprint(s) for s in sets]
            sigs = []
            for s, fp in zip(sets, fps, strict=True):
                new = len(s) and fp not in seen
                if new:
                    if len(seen) >= CLASSES_HELD:
                        seen.clear()
                    seen.add(fp)
                sigs.append(signatures(s, percent).view(np.int64) if new else None)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp", "sigs"])
        del shingle, seen
        tidy()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, fp long, sigs array<long>")


SETS = "fp long, n long, sketch binary, grams binary"


def as_sets(fps: list[int] | np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
    """A batch of ``SETS``."""
    return pa.RecordBatch.from_arrays(
        [pa.array(fps, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "n", "sketch", "grams"]
    )


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """``SETS`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for piece in slices(batches):
            sets = [shingle(t or "") for t in piece.column(1).to_pylist()]
            yield as_sets([fingerprint(s) for s in sets], sets)
        del shingle
        tidy()

    return docs.mapInArrow(run, SETS)


def linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The (a, b) of those (a, b, ga, gb) rows whose sets link."""
    for piece in slices(batches):
        keep = []
        for x, y in zip(piece.column(2), piece.column(3), strict=True):
            r, s = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([r, s])
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            keep.append(100 * same >= percent * (len(both) - same))
        yield pa.RecordBatch.from_arrays(piece.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def width_of(size: int) -> int:
    """The cells of a set's sketch."""
    return max(512, 1 << (3 * size - 1).bit_length())


def sketch(grams: np.ndarray) -> bytes:
    """The parity of the n-grams in each cell."""
    width = width_of(len(grams))
    cells = np.bincount((mixed(grams ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((cells & 1).astype(np.uint8)).tobytes()


def folded(x: bytes, width: int) -> bytes:
    """A sketch over fewer cells."""
    while len(x) > width:
        half = len(x) // 2
        x = (int.from_bytes(x[:half]) ^ int.from_bytes(x[half:])).to_bytes(half)
    return x


def passing(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, d) of those (a, b, na, nb, sa, sb) rows whose sketches allow a link; ``d`` bits differ."""
    for piece in slices(batches):
        na, nb = piece.column(2).to_pylist(), piece.column(3).to_pylist()
        d, keep = [], []
        for r, s, x, y in zip(na, nb, piece.column(4).to_pylist(), piece.column(5).to_pylist(), strict=True):
            width = min(len(x), len(y))
            d.append((int.from_bytes(folded(x, width)) ^ int.from_bytes(folded(y, width))).bit_count())
            keep.append(d[-1] * (100 + percent) <= (100 - percent) * (r + s))
        yield pa.RecordBatch.from_arrays([*piece.columns[:2], pa.array(d, pa.int64())], names=["a", "b", "d"]).filter(pa.array(keep, pa.bool_()))


def likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For (low, a, b) rows of two blocks of (fp, c, n, data), data a sketch, the (low, fp) that may link with another component's."""
    for batch in batches:
        for row in range(batch.num_rows):
            low = batch.column(0)[row].as_py()
            sides = [batch.column(k)[row].values for k in (1, 2) if batch.column(k)[row].is_valid]
            width = min(len(x) for side in sides for x in side.field("data").to_pylist())
            parts = []
            for side in sides:
                bits = np.stack([np.unpackbits(np.frombuffer(folded(x, width), np.uint8)) for x in side.field("data").to_pylist()]).astype(np.float32)
                parts.append((bits, side.field("fp").to_numpy(), side.field("c").to_numpy(), side.field("n").to_numpy()))
            (x, fx, cx, nx), (y, fy, cy, ny) = parts[0], parts[-1]
            hit = np.zeros(len(fy), bool)
            found = []
            ones = y.sum(axis=1)
            for at in range(0, len(fx), 512):
                part = slice(at, at + 512)
                d = x[part].sum(axis=1)[:, None] + ones[None, :] - 2 * (x[part] @ y.T)
                good = (d * (100 + percent) <= (100 - percent) * (nx[part, None] + ny[None, :])) & (cx[part, None] != cy[None, :])
                found.append(fx[part][good.any(axis=1)])
                hit |= good.any(axis=0)
            fps = np.unique(np.concatenate([*found, fy[hit]]))
            if len(fps):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), low)), pa.array(fps)], names=["low", "fp"])
    tidy()


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For links between places 0 to n - 1, the smallest place that each reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The intersection sizes of all sets of ``a`` with all of ``b``, by products of 0/1 matrices of the n-grams both sides have."""
    out = np.zeros((len(a), len(b)), np.float32)
    values = [np.concatenate(x) for x in (a, b)]
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    both = np.intersect1d(*values)
    places = []
    for v, o in zip(values, owners, strict=True):
        at = np.minimum(np.searchsorted(both, v), max(len(both) - 1, 0))
        has = both[at] == v if len(both) else np.zeros(len(v), bool)
        order = np.argsort(at[has], kind="stable")
        places.append((at[has][order], o[has][order]))
    for start in range(0, len(both), 2048):
        sides = []
        for (at, o), n in zip(places, (len(a), len(b)), strict=True):
            lo, hi = np.searchsorted(at, [start, start + 2048])
            m = np.zeros((n, min(2048, len(both) - start)), np.float32)
            m[o[lo:hi], at[lo:hi] - start] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def blocked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For (low, a, b) rows of two blocks of (fp, c, n, data), data a set, a forest of the links between different components."""
    for batch in batches:
        for row in range(batch.num_rows):
            sides = []
            for side in (batch.column(k)[row].values for k in (1, 2) if batch.column(k)[row].is_valid):
                sides.append((side.field("fp").to_numpy(), side.field("c").to_numpy(), [np.frombuffer(x, np.uint64) for x in side.field("data").to_pylist()]))
            (fa, ca, sa), (fb, cb, sb) = sides[0], sides[-1]
            same = common(sa, sb)
            total = np.array([len(s) for s in sa])[:, None] + np.array([len(s) for s in sb])[None, :]
            x, y = np.nonzero((100 * same >= percent * (total - same)) & (ca[:, None] != cb[None, :]))
            if len(x):
                ids = fa if len(sides) == 1 else np.concatenate([fa, fb])
                root = spanning(x, y if len(sides) == 1 else y + len(fa), len(ids))
                moved = root != np.arange(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])
    tidy()


def few(ids: DataFrame) -> DataFrame:
    """Ids for a join: broadcast if counted to be few, else shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def of_ids(grams: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``grams`` whose ``fp`` is among ``ids``."""
    return grams.select("fp", *columns).join(few(ids), "fp", "left_semi")


def verified(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b) that link."""
    wanted = of_ids(grams, written(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()), "grams")
    rows = pairs.join(wanted.select(F.col("fp").alias("a"), F.col("grams").alias("ga")), "a").join(wanted.select(F.col("fp").alias("b"), F.col("grams").alias("gb")), "b")
    return rows.select("a", "b", "ga", "gb").mapInArrow(lambda x: linked(x, percent), "a long, b long")


def block_pairs(member: DataFrame, limit: int) -> DataFrame:
    """(low, a, b): the pairs of blocks of each group that span components; ``b`` is null for a block by itself.

    ``member`` is (low, fp, c, n, data). A component with more than ``limit`` bytes has blocks of its own, dealt by a hash;
    the others are dealt to blocks by a hash of the component.
    """
    size = F.sum(F.octet_length("data"))
    of_component = member.groupBy("low", "c").agg(size.alias("bytes"))
    small = of_component.filter(F.col("bytes") <= limit).groupBy("low").agg(F.sum("bytes").alias("rest"))
    parts = lambda x: F.ceil(x / limit).cast("long")
    sized = of_component.join(small, "low", "left").select("low", "c", "bytes", F.coalesce("rest", F.lit(0)).alias("rest"))
    large = F.col("bytes") > limit
    placed = member.join(sized, ["low", "c"]).select(
        "low", "fp", "c", "n", "data", F.when(large, F.col("c")).alias("own"),
        F.when(large, F.pmod(F.xxhash64("fp"), parts(F.col("bytes")))).otherwise(F.pmod(F.xxhash64("c"), parts(F.greatest("rest", F.lit(1))))).alias("k"),
    )
    blocks = placed.groupBy("low", F.struct(F.coalesce("own", F.lit(0)).alias("own"), F.col("own").isNotNull().alias("is_own"), "k").alias("block"))
    blocks = written(blocks.agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.collect_list(F.struct("fp", "c", "n", "data")).alias("sets")))
    alone = blocks.filter("c0 < c1").select("low", F.col("sets").alias("a"), F.lit(None).cast(blocks.schema["sets"].dataType).alias("b"))
    one = blocks.select("low", F.col("block").alias("i"), F.col("c0").alias("p0"), F.col("c1").alias("p1"))
    two = blocks.select("low", F.col("block").alias("j"), F.col("c0").alias("q0"), F.col("c1").alias("q1"))
    pairs = written(one.join(two, "low").filter("i < j and least(p0, q0) < greatest(p1, q1)").select("low", "i", "j"))
    n = pairs.count()
    if not n:
        return alone
    spread = pairs.repartition(max(1, min(2000, n // 16)), "low", "i", "j")
    return alone.unionByName(spread.join(blocks.select("low", F.col("block").alias("i"), F.col("sets").alias("a")), ["low", "i"]).join(blocks.select("low", F.col("block").alias("j"), F.col("sets").alias("b")), ["low", "j"]).select("low", "a", "b"))


def links(index: DataFrame, classes: DataFrame, grams_of: Callable[[DataFrame], DataFrame], percent: int, indexed: Callable[[], None]) -> DataFrame:
    """(a, b) class fingerprints that link, enough of them to give all components.

    ``index`` is (sig, fp); ``classes`` is (fp, rep): fingerprint and where the class is first found; ``grams_of``
    gives ``SETS`` for the classes it is handed, each once. ``indexed`` is called when the index has been read.
    """
    bucket = Window.partitionBy("sig")
    shared = written(index.withColumn("low", F.min("fp").over(bucket)).withColumn("high", F.max("fp").over(bucket)).filter("low < high").select("sig", "fp", "low").distinct())
    indexed()
    involved = written(shared.select("fp").distinct().join(classes.select("fp", "rep"), "fp"))
    grams = written(grams_of(involved))
    met = shared.filter("fp != low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
    side = lambda x: grams.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    pairs = written(met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lambda x: passing(x, percent), "a long, b long, d long"))
    # each class with its likeliest pivot, then with those of other components
    first = written(pairs.groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a")).select("a", "b"))
    found = cut(verified(first, grams, percent))
    comp = components(found)
    named = lambda df, x, c: df.join(comp.select(F.col("id").alias(x), F.col("component").alias(c)), x, "left").withColumn(c, F.coalesce(c, x))
    rest = named(named(pairs.join(first, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").filter("ca != cb").select("a", "b")
    found = cut(found.unionByName(verified(written(rest), grams, percent)))
    # what pivots left open: buckets whose other members are of two components or more
    comp = components(found)
    of_bucket = written(named(shared.filter("fp != low"), "fp", "c"))
    open_buckets = of_bucket.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("sig")
    member = written(of_bucket.join(open_buckets, "sig", "left_semi").select("low", "fp", "c").distinct())
    discard(of_bucket)
    rows = member.join(grams.select("fp", "n", F.col("sketch").alias("data")), "fp").select("low", "fp", "c", "n", "data")
    left = written(block_pairs(rows, SKETCH_BYTES).mapInArrow(lambda x: likely(x, percent), "low long, fp long").distinct())
    rows = member.join(left, ["low", "fp"]).join(of_ids(grams, written(left.select("fp").distinct()), "n", "grams").withColumnRenamed("grams", "data"), "fp").select("low", "fp", "c", "n", "data")
    more = block_pairs(rows, BLOCK_BYTES).mapInArrow(lambda x: blocked(x, percent), "a long, b long")
    out = cut(found.unionByName(more))
    discard(shared, involved, grams, pairs, first, member, left)
    return out


def join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link if their n-gram sets' Jaccard is at least ``percent`` / 100.

    Null and blank texts have no n-grams and link with nothing. Repeated rows come out each. A null id takes part
    under its text's class but is never a component's name unless it stands alone. An empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with_sigs = written(keyed(rows, n, percent))
    keys = written(with_sigs.drop("sigs"))
    classes = written(keys.filter("n_shingles > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    again = keys.groupBy("doc_id").count().filter("count > 1").limit(1).count()

    def grams_of(involved: DataFrame) -> DataFrame:
        chosen = rows.join(few(involved.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
        sets = of_ids(sets_of(chosen, n), involved.select("fp"), "n", "sketch", "grams")
        return sets.dropDuplicates(["fp"]) if again else sets  # a set comes twice only where an id does

    found = links(with_sigs.select(F.explode("sigs").alias("sig"), "fp"), classes, grams_of, percent, lambda: discard(with_sigs))
    reps = classes.select("fp", "rep")
    named = found.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    comp = components(named.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    of_class = written(reps.join(comp, reps.rep == comp.id, "left").select("fp", F.coalesce("component", "rep").alias("component")))
    empty = keys.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = keys.filter("n_shingles > 0").select("doc_id", "n_shingles", "fp").join(of_class, "fp", "left")
    return full.select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionByName(empty)


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest id; rows that repeat an id stay together; blank texts stay."""
    found = join(docs, n, percent)
    names = written(found.filter("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("kept_id")).distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    stay = rows.join(few(names), F.col("row")["doc_id"].eqNullSafe(F.col("kept_id")), "left_semi")
    return stay.select("row.*")
