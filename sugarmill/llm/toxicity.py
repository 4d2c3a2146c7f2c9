"""Toxicity: a learned lexicon in a trie, intersected with Levenshtein automata, and context-window scores.

Fitting takes at most about ``SAMPLE`` labelled rows, chosen by a hash of the id. Spark counts in how many toxic
and clean documents each word and word beginning stands; those frequent in toxic and rare in clean documents are
candidates, and a greedy cover of the toxic documents picks the lexicon. The intersection of the trie with the
automata of all terms is made deterministic as words arrive, so most words die after a few characters. A term's
misspellings count only if they are rare in clean documents. Hits with quotation marks on both sides in the window
count as quoted. A logistic function of the counts, fitted with priors, gives the score.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarmill.llm.common import free_name, slices, tidy

#: Labelled rows used for fitting, about.
SAMPLE = 40_000
#: A lexicon term's share of toxic documents is so many times its share of clean ones.
LIFT = 40.0
#: Clean documents, as a share, that a term's misspellings may hit.
FUZZY_CLEAN = 0.002
#: Words on each side of a hit that are searched for quotation marks.
WINDOW = 12
#: Words of a text's beginning part of a term: lengths of beginnings that may become terms.
PREFIXES = (4, 5, 6)
#: Toxic documents that a term must add for each clean document it stands in.
PENALTY = 3
WORDS_HELD = 150_000
STATES_HELD = 20_000
EDGES = ".,;:!?\"'()[]{}“”«»„‘’‹›*#$%&|<>-–—_/\\"
QUOTES = frozenset("\"“”«»„‘‹›")
EXACT, OBFUSCATED, FUZZY = 0, 1, 2
RESULT = "struct<score:double,exact:bigint,obfuscated:bigint,fuzzy:bigint,quoted:bigint,hits:array<struct<term:string,word:string,at:bigint,kind:string,quoted:boolean>>>"
KINDS = ("exact", "obfuscated", "fuzzy")
#: Prior weights: constant, exact, obfuscated, misspelled, quoted.
PRIOR = np.array([-3.0, 5.0, 4.5, 3.0, 0.5])


def in_training(doc_id: Column) -> Column:
    """Rows whose labels may be used: CRC-32 of the id as text, modulo 4, is not 2. Null ids are not used."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def allowed_edits(term: str, prefix: bool) -> int:
    """Edits within which a word still counts as the term."""
    return (0 if len(term) < 5 else 1 if len(term) < 9 or prefix else 2) if not prefix or len(term) >= 5 else 0


class Automaton:
    """The lexicon's trie run with the Levenshtein automata of its terms, determinised on demand."""

    def __init__(self, terms: list[tuple[str, bool]], fuzzy: list[bool] | None = None):
        self.terms = terms
        self.fuzzy = fuzzy or [True] * len(terms)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]  # the most edits that any term below a node allows
        for k, (term, prefix) in enumerate(terms):
            node, e = 0, allowed_edits(term, prefix)
            self.reach[0] = max(self.reach[0], e)
            for ch in term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][ch]
                self.reach[node] = max(self.reach[node], e)
            self.ends[node].append(k)
        self.reset()

    def reset(self) -> None:
        self.sets: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple | None] = []
        self.state(self.closed({(0, 0, 0)}))

    def closed(self, items: set[tuple[int, int, int]]) -> frozenset:
        """With the trie's characters that the word may leave out."""
        todo, out = list(items), set(items)
        while todo:
            node, e, _ = todo.pop()
            if e < self.reach[node]:
                for child in self.children[node].values():
                    x = (child, e + 1, FUZZY)
                    if e + 1 <= self.reach[child] and x not in out:
                        out.add(x)
                        todo.append(x)
        return frozenset(out)

    def state(self, items: frozenset) -> int:
        if items in self.ids:
            return self.ids[items]
        self.ids[items] = k = len(self.sets)
        self.sets.append(items)
        self.moves.append({})
        best = None
        for node, e, kind in items:
            for t in self.ends[node]:
                term, prefix = self.terms[t]
                if e <= allowed_edits(term, prefix) and (kind != FUZZY or self.fuzzy[t]):
                    x = (kind, e, t)
                    best = x if best is None or x < best else best
        self.found.append(best)
        return k

    def step(self, k: int, ch: str) -> int:
        moved = set()
        letter = ch.isalpha()
        for node, e, kind in self.sets[k]:
            child = self.children[node].get(ch)
            if child is not None and e <= self.reach[child]:
                moved.add((child, e, kind))
            if e < self.reach[node]:
                worse = FUZZY if letter else max(kind, OBFUSCATED)
                moved.add((node, e + 1, worse))
                for other, c in self.children[node].items():
                    if other != ch and e + 1 <= self.reach[c]:
                        moved.add((c, e + 1, worse))
        return self.state(self.closed(moved)) if moved else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """The best (kind, term) of a word: whole terms against the word, beginnings against its beginning."""
        k, best = 0, None
        for ch in word:
            nxt = self.moves[k].get(ch)
            if nxt is None:
                if len(self.sets) > STATES_HELD:
                    held = self.sets[k]
                    self.reset()
                    k = self.state(held)
                nxt = self.moves[k][ch] = self.step(k, ch)
            k = nxt
            if k < 0:
                return best[0::2] if best else None
            hit = self.found[k]
            if hit and self.terms[hit[2]][1] and (best is None or hit < best):
                best = hit
        hit = self.found[k] if word else None
        if hit and (best is None or hit < best):
            best = hit
        return best[0::2] if best else None


def cleaned(word: str) -> str:
    return word.strip(EDGES)


def terms_of(text: str) -> set[str]:
    """Distinct words of a text and their beginnings, which end in a star."""
    words = {w for w in map(cleaned, text.lower().split()) if w}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def features(counts: np.ndarray) -> np.ndarray:
    """A constant, and for each count whether there is any, with a little for more."""
    return np.hstack([np.ones((len(counts), 1)), np.minimum(counts, 1) + 0.25 * np.log1p(np.maximum(counts - 1, 0))])


@dataclass
class Model:
    """The lexicon with what may be misspelled, and the weights of the counts."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    fuzzy: list[bool] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def score(self, counts: np.ndarray) -> np.ndarray:
        x = features(counts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


class Finder:
    """Hits of texts, with a bounded memory of words without one."""

    def __init__(self, terms: list[tuple[str, bool]], fuzzy: list[bool] | None = None):
        self.automaton = Automaton(terms, fuzzy)
        self.seen: set[str] = set()
        self.hit: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str) -> list[tuple[int, str, int, int, bool]]:
        """(place, word, term, kind, quoted) of each hit."""
        words = text.lower().split()
        own = set(words)
        for w in own.difference(self.seen):
            bare = cleaned(w)
            m = self.automaton.match(bare)
            if m is None and w != bare:
                m = self.automaton.match(w.strip(".,;:!?\"'()“”«»„"))
            if m:
                self.hit[w] = m
        self.seen |= own
        found = own.intersection(self.hit)
        out = []
        if found:
            for i, w in enumerate(words):
                if w in found:
                    kind, term = self.hit[w]
                    before = any(QUOTES.intersection(x) for x in words[max(0, i - WINDOW) : i]) or w[0] in QUOTES
                    after = any(QUOTES.intersection(x) for x in words[i + 1 : i + 1 + WINDOW]) or any(c in QUOTES for c in w[1:])
                    out.append((i, w, term, kind, before and after))
        if len(self.seen) > WORDS_HELD:
            self.seen, self.hit = set(), {}
        return out


def tallied(hits: list[tuple[int, str, int, int, bool]]) -> list[int]:
    """Exact, obfuscated and misspelled hits outside quotation, and quoted hits."""
    n = [0, 0, 0, 0]
    for _, _, _, kind, quoted in hits:
        n[3 if quoted else kind] += 1
    return n


def count_terms(rows: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents with the term by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            terms = list(set(n[0]) | set(n[1]))
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([n[1][t] for t in terms], pa.int64()), pa.array([n[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])
            n[0].clear()
            n[1].clear()
            return out

        for piece in slices(batches):
            for label, text in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                n[label].update(terms_of(text or ""))
            if len(n[0]) + len(n[1]) > WORDS_HELD:
                yield flush()
        yield flush()

    return rows.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def cover(by_doc: dict[int, list[str]], clean: dict[str, int], least: int) -> list[str]:
    """Terms picked greedily by the toxic documents that have none yet, less ``PENALTY`` for each clean document; longer terms win ties.

    A term must add ``least`` documents, or one if it stands in five times ``least`` of them and in no clean one. Every pick adds a
    document, so there are no more terms than documents. What a term adds only falls, so a queue in order of what it added when last
    looked at needs to look again at its first terms only.
    """
    has = defaultdict(set)
    for k, terms in by_doc.items():
        for t in terms:
            has[t].add(k)
    total = {t: len(x) for t, x in has.items()}
    wide = {t for t in has if total[t] >= 5 * least and not clean.get(t)}
    rank = {t: k for k, t in enumerate(sorted(has, key=lambda x: (not x.endswith("*"), len(x), x), reverse=True))}
    loss = lambda t: PENALTY * clean.get(t, 0) - len(has[t])
    by_gain, by_size = (lambda t: (loss(t), rank[t])), (lambda t: (-len(has[t]), -total[t], rank[t]))
    every, sure = sorted((by_gain(t), t) for t in has), sorted((by_size(t), t) for t in wide)
    covered: set[int] = set()

    def best(queue: list[tuple], key: Callable[[str], tuple]) -> str | None:
        while queue:
            before, t = queue[0]
            has[t] = has[t] - covered
            now = key(t)
            if not has[t]:
                heappop(queue)
            elif now == before:
                return t
            else:
                heapreplace(queue, (now, t))
        return None

    picked: list[str] = []
    while (t := best(every, by_gain)) is not None:
        if -loss(t) < least and t not in wide:
            t = best(sure, by_size)
            if t is None:
                break
        picked.append(t)
        covered |= has[t]
    return picked


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from labelled training rows; without any, the prior weights and no terms.

    Rows without a label, label null, are not used. Repeated label rows count once each.
    """
    known = labels.filter(in_training(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("label")).distinct()
    n = known.count()
    if not n:
        return Model()
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "label", "text").persist()
    size = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    least = max(2, math.ceil(0.002 * toxic))
    lift = ((F.col("toxic") + 0.0) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    listed = count_terms(rows).filter((F.col("toxic") >= least) & (lift >= F.lit(min(LIFT, 0.25 * clean / max(toxic, 1) * least + 1))))
    in_clean = {r.term: r.clean for r in listed.collect()}  # each stands in 0.2 % of the toxic documents, so at most 500 times as many as a document has
    candidates = frozenset(in_clean)

    def candidates_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = [sorted(candidates & terms_of(t or "")) for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "terms"])

    by_doc = {k: r.terms for k, r in enumerate(rows.filter("label = 1").select("doc_id", "text").mapInArrow(candidates_of, "doc_id long, terms array<string>").collect())}
    terms = [(t.rstrip("*"), t.endswith("*")) for t in cover(by_doc, in_clean, least)]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(terms)
        for piece in slices(batches):
            for label, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                hits = find(text or "")
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([[[h[2], h[3], int(h[4])] for h in hits]], pa.list_(pa.list_(pa.int64())))], names=["label", "hits"])
        del find
        tidy()

    seen = rows.select("label", "text").mapInArrow(tally, "label int, hits array<array<long>>").groupBy("label", "hits").agg(F.count("*").alias("n")).collect()
    rows.unpersist()
    wrong = Counter()
    for r in seen:
        if r.label == 0:
            for t in {h[0] for h in r.hits if h[1] == FUZZY}:
                wrong[t] += r.n
    fuzzy = [wrong[t] <= FUZZY_CLEAN * clean for t in range(len(terms))]
    counts, label, weight = [], [], []
    for r in seen:
        counts.append(tallied([(0, "", h[0], h[1], bool(h[2])) for h in r.hits if h[1] != FUZZY or fuzzy[h[0]]]))
        label.append(r.label)
        weight.append(r.n)
    return Model(terms, fuzzy, logistic(np.array(counts, float), np.array(label, float), np.array(weight, float)))


def logistic(counts: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights by Newton's method with normal priors; the other kinds of hits have priors in proportion to exact hits."""
    x, prior, w = features(counts), PRIOR, PRIOR.copy()
    for spread in (np.array([4, 4, 0.01, 0.01, 0.01]), np.array([4, 4, 1, 2, 3])):
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (label - p)) - (w - prior) / spread**2
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(1 / spread**2)
            move = np.linalg.solve(h, g)
            w = w + move * min(1.0, 3 / max(np.abs(move).max(), 1e-9))
            if np.abs(move).max() < 1e-8:
                break
        fitted, prior = w, np.array([*PRIOR[:2], *(w[1] * PRIOR[2:] / PRIOR[1])])
        w = np.array([*w[:2], *prior[2:]])
    return fitted


def verdict(model: Model, docs: DataFrame, text: Column) -> Column:
    """The struct of score, counts and hits of a text. Null and empty texts have no hits and the constant's score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        find = Finder(m.terms, m.fuzzy)
        hit = pa.struct([("term", pa.string()), ("word", pa.string()), ("at", pa.int64()), ("kind", pa.string()), ("quoted", pa.bool_())])
        for texts in batches:
            counts, hits = [], []
            for at in range(0, len(texts), 256):
                for t in texts[at : at + 256].to_pylist():
                    found = find(t) if t else []
                    counts.append(tallied(found))
                    hits.append([{"term": m.terms[k][0], "word": w, "at": i, "kind": KINDS[kind], "quoted": q} for i, w, k, kind, q in found])
            n = np.array(counts, float).reshape(-1, 4)
            names = ("exact", "obfuscated", "fuzzy", "quoted")
            yield pa.StructArray.from_arrays([pa.array(m.score(n)), *(pa.array(n[:, k].astype(np.int64)) for k in range(4)), pa.array(hits, pa.list_(hit))], names=["score", *names, "hits"])
        del find  # its words and states, before unused memory goes back
        tidy()

    return run(text.cast("string"))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``toxicity``; other columns stay, repeated rows are scored each, an empty table stays empty.

    Null and blank texts have no hits. If ``docs`` has a column ``toxicity``, it stays and the struct is named ``toxicity_``.
    """
    return docs.withColumn(free_name(docs, "toxicity"), verdict(model, docs, F.col(text)))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score below ``threshold``, with their own columns."""
    model = fit(docs, labels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.filter(verdict(model, docs, F.col("row")["text"])["score"] < threshold).select("row.*")
