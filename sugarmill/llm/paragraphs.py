"""Substring deduplication by paragraph: MinHash bands, exact Jaccard, components.

A paragraph is a line with at least ``MIN_WORDS`` words. Paragraphs with equal sets of 5-word shingles are one class.
Each class has a MinHash signature in bands, tuned so that a pair at the limit collides in a band with a
probability of ``RECALL`` at least. Classes that collide are compared on the shingles themselves, components of linked classes
are clusters, and of each cluster the first paragraph, by document id and line, stays.

What stands in no removed paragraph is then compared word by word, line breaks ignored. A window of ``WINDOW`` words that
stands earlier, by document id and place, is removed, so that of a longer shared passage the union of its windows goes.
Each window names the least hash of its ``GRAM``-word parts; equal windows name the same one, so only windows whose part is
found twice are listed at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugarmill.llm.common import discard, slices, written
from sugarmill.llm.components import components
from sugarmill.llm.ngram_join import SETS, Shingler, as_sets, few, fingerprints, links, mixed, of_ids

MIN_WORDS, SHINGLE, PERCENT = 25, 5, 80
RECALL, MOST_HASHES = 0.999, 32
#: Words of the shortest passage found inside and across lines, and of its parts that are looked up first.
WINDOW, GRAM = 50, 20
WORD = re.compile(rb"[^\t\n\r\x0b\x0c ]+")


@lru_cache(maxsize=32)
def tuned(percent: int, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows in a band, and the fewest bands, that reach the recall at the limit with at most ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        miss, bands = 1 - (percent / 100) ** rows, 1
        while bands * rows <= most and miss**bands > 1 - recall:
            bands += 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def band_hashes(grams: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of band hashes for each set; ``ends`` are the sets' ends in ``grams``."""
    starts = np.concatenate([[0], ends[:-1]])
    out = []
    for b in range(bands):
        h = np.full(len(ends), b + 1, np.uint64)
        for r in range(rows):
            k = np.uint64(2 * (b * rows + r) + 1)
            least = np.minimum.reduceat((grams ^ (k << np.uint64(7))) * (k * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)), starts)
            h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + least)
        out.append(h)
    return np.stack(out, axis=1)


def cut_up(text: str) -> list[tuple[int, list[bytes]]]:
    """(line, lower-case words) of the paragraphs."""
    out = []
    for k, line in enumerate(text.split("\n")):
        if len(line) >= 2 * MIN_WORDS - 1:
            words = line.encode("utf-8", "surrogatepass").lower().split()
            if len(words) >= MIN_WORDS:
                out.append((k, words))
    return out


def per_paragraph(docs: DataFrame, of, schema: str) -> DataFrame:
    """Runs ``of(doc ids, lines, n-grams, sizes)`` over the paragraphs of slices of (doc_id, text) rows; the sets follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(SHINGLE)
        for piece in slices(batches):
            ids, lines, texts = [], [], []
            for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                for k, words in cut_up(text or ""):
                    ids.append(doc)
                    lines.append(k)
                    texts.append(words)
            if texts:
                yield of(ids, lines, *shingle.many(texts))

    return docs.mapInArrow(run, schema)


def keyed(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, line, n, fp, sigs) of every paragraph; the band hashes stand only where a slice first meets a set."""
    bands, rows = tuned(percent)

    def of(ids: list, lines: list, grams: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        fps = fingerprints(grams, size)
        sigs = band_hashes(grams, np.cumsum(size), bands, rows).view(np.int64)
        new = np.zeros(len(fps), bool)
        new[np.unique(fps, return_index=True)[1]] = True
        offsets = np.concatenate([[0], np.cumsum(new * bands)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sigs[new].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(size, pa.int64()), pa.array(fps), lists], names=["doc_id", "line", "n", "fp", "sigs"])

    return per_paragraph(docs, of, "doc_id long, line long, n long, fp long, sigs array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """``SETS`` of every paragraph."""

    def of(ids: list, lines: list, grams: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        return as_sets(fingerprints(grams, size), np.split(grams, np.cumsum(size)[:-1]))

    return per_paragraph(docs, of, SETS)


def clusters(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, n_shingles, cluster_doc, cluster_line, removed) of every paragraph that has a near copy.

    ``cluster_doc`` and ``cluster_line`` tell the paragraph that stays. Null texts and short lines have no paragraphs; rows
    of null id are left alone; rows that repeat an id are the same document; other columns are left out; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    with_sigs = written(keyed(rows, percent))
    keys = written(with_sigs.drop("sigs"))
    place = F.struct("doc_id", "line")
    classes = written(keys.groupBy("fp").agg(F.first("n").alias("n"), F.min(place).alias("place"), F.max(place).alias("last"))).withColumn("rep", F.col("place.doc_id"))

    def grams_of(involved: DataFrame) -> DataFrame:
        chosen = rows.join(few(involved.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
        return of_ids(sets_of(chosen), involved.select("fp"), "n", "sketch", "grams").dropDuplicates(["fp"])

    found = links(with_sigs.select(F.explode("sigs").alias("sig"), "fp"), classes.select("fp", "rep"), grams_of, percent, lambda: discard(with_sigs))
    comp = components(found).withColumnRenamed("id", "cid")
    joined = classes.join(comp, classes.fp == comp.cid, "left").select("fp", "n", "place", "last", F.coalesce("component", "fp").alias("c"))
    keeper = joined.groupBy("c").agg(F.min("place").alias("keeper"), F.max("last").alias("end")).filter("keeper < end")
    member = written(joined.join(keeper, "c").select("fp", "keeper"))
    out = keys.join(member, "fp")
    return out.select("doc_id", "line", F.col("n").alias("n_shingles"), F.col("keeper.doc_id").alias("cluster_doc"), F.col("keeper.line").alias("cluster_line"), (place != F.col("keeper")).alias("removed"))


def rolled(h: np.ndarray, size: int, join) -> np.ndarray:
    """``join`` over all runs of ``size`` values; runs beyond the end are left out."""
    out, done, power, width = None, 0, h, 1
    while True:
        if size & width:
            out = power if out is None else join(out[: max(len(h) - done - width + 1, 0)], power[done:])
            done += width
        width *= 2
        if width > size:
            return out
        power = join(power[: max(len(h) - width + 1, 0)], power[width // 2 :])


def chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


def windows(h: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the ``GRAM``-word parts, the least of each window of ``WINDOW`` words, and which windows lie in one part of the text."""
    inside = part[: len(h) - WINDOW + 1] == part[WINDOW - 1 :]
    grams = rolled(h, GRAM, chained)
    return grams, rolled(grams, WINDOW - GRAM + 1, np.minimum), inside


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id, c): the parts that windows name, and how often a document has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(1)
        for piece in slices(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in piece.column(1).to_pylist()]
            size = [len(t) for t in texts]
            h = shingle.hashed([w for t in texts for w in t])
            if len(h) < WINDOW:
                continue
            owner = np.repeat(np.arange(len(texts)), size)
            grams, least, inside = windows(h, owner)
            pad = np.zeros(WINDOW - GRAM, np.uint64)
            # a part is named if it is the least of one of the windows around it
            named = rolled(np.concatenate([pad, np.where(inside, least, np.uint64(0)), pad]), WINDOW - GRAM + 1, np.maximum) == grams
            pairs = np.stack([owner[: len(grams)][named].astype(np.uint64), grams[named]], axis=1)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            first = np.ones(len(pairs), bool)
            first[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
            at = np.flatnonzero(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[at, 1].view(np.int64)), piece.column(0).take(pa.array(pairs[at, 0].astype(np.int64))), pa.array(np.diff(np.append(at, len(pairs))).astype(np.int32))], names=["anchor", "doc_id", "c"]
            )

    return docs.mapInArrow(run, "anchor long, doc_id long, c int")


def listed(docs: DataFrame) -> DataFrame:
    """(window, doc_id, start): the windows of (doc_id, text, gone, anchors) rows that name one of the anchors and hold no word of a line that is gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(1)
        for piece in slices(batches):
            for k, (doc, text) in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)):
                gone, wanted = set(piece.column(2)[k].as_py() or ()), np.sort(piece.column(3)[k].values.to_numpy().view(np.uint64))
                lines = [x.encode("utf-8", "surrogatepass").lower().split() for x in (text or "").split("\n")]
                size = np.array([len(x) for x in lines])
                place = np.flatnonzero(np.repeat(np.array([x not in gone for x in range(len(lines))]), size))
                if len(place) < WINDOW:
                    continue
                h = shingle.hashed([w for x, ws in enumerate(lines) if x not in gone for w in ws])
                _, least, inside = windows(h, place - np.arange(len(place)))  # what is gone before tells the parts
                at = np.minimum(np.searchsorted(wanted, least), len(wanted) - 1)
                found = np.flatnonzero(inside & (wanted[at] == least))
                if len(found):
                    whole = rolled(h, WINDOW, chained)[found]
                    yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(np.full(len(found), doc, np.int64)), pa.array(place[found].astype(np.int32))], names=["window", "doc_id", "start"])

    return docs.mapInArrow(run, "window long, doc_id long, start int")


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_words, kept_doc) of the passages that the (start, own) windows of a document make up; ``own`` is where
    the same document has the window first, null if another has it."""
    for piece in slices(batches):
        out = []
        for doc, found, kept in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
            # of a text that repeats itself at a shorter distance, one window stays
            starts = [x["start"] if x["own"] is None else max(x["start"], x["own"] + WINDOW) for x in found]
            end = -1
            for start, x in sorted(zip(starts, found, strict=True), key=lambda y: (y[0], y[1]["start"])):
                if start > end:
                    out.append([doc, start, 0, kept])
                end = max(end, x["start"] + WINDOW)
                out[-1][2] = end - out[-1][1]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_words", "kept_doc"])


def passages(docs: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_words, kept_doc) of the passages of ``WINDOW`` words or more to remove beside whole lines.

    ``lines`` is (doc_id, gone), the removed lines by document. ``start`` counts the document's words, ``kept_doc`` is the
    first document in which a window of the document's passages stays. Rows that repeat an id are the same document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    named = written(anchors(rows))
    twice = named.groupBy("anchor").agg(F.sum("c").alias("n")).filter("n > 1").select("anchor")
    asked = named.select("anchor", "doc_id").join(twice, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    asked = written(asked.join(lines, "doc_id", "left"))
    discard(named)
    found = written(listed(rows.join(asked, "doc_id").select("doc_id", "text", "gone", "anchors")))
    discard(asked)
    first = found.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select("window", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"))
    later = found.join(first, "window").filter("doc_id != first_doc or start > first_start")
    own = F.when(F.col("doc_id") == F.col("first_doc"), F.col("first_start")).alias("own")
    of_doc = later.groupBy("doc_id").agg(F.collect_set(F.struct("start", own)).alias("found"), F.min("first_doc").alias("kept"))
    return of_doc.mapInArrow(merged, "doc_id long, start long, n_words long, kept_doc long")


def gone_lines(found: DataFrame) -> DataFrame:
    """(doc_id, gone) of the removed paragraphs."""
    return found.filter("removed").groupBy("doc_id").agg(F.collect_set("line").alias("gone"))


def without(text: str, gone: list[int] | None, spans: list | None) -> str:
    """A text without lines and passages of (start, n_words); lines that lose all their words go."""
    gone, out, at = set(gone or ()), [], 0
    removed = {k for s in spans or () for k in range(s["start"], s["start"] + s["n_words"])}
    for number, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        words = [m.span() for m in WORD.finditer(line)]
        stays = [at + k not in removed for k in range(len(words))]
        at += len(words)
        if number in gone:
            continue
        if all(stays):
            out.append(line)
            continue
        runs: list[list[int]] = []
        for k, (a, b) in enumerate(words):
            if stays[k]:
                if k and stays[k - 1]:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        if runs:
            out.append(b" ".join(line[a:b] for a, b in runs))
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the removed paragraphs and passages, with ``n_chars`` renewed; documents that lose their last word go.

    Columns other than text and n_chars stay as they are.
    """
    lines = written(gone_lines(clusters(docs, percent)))
    spans = passages(docs, lines).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    gone = written(lines.join(spans, "doc_id", "full").withColumnRenamed("doc_id", "gone_id"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.join(gone, F.col("row")["doc_id"] == F.col("gone_id"), "left")
    touched = F.col("gone_id").isNotNull() & F.col("row")["text"].isNotNull()
    cut = F.udf(lambda t, g, s: None if t is None else without(t, g, s), "string", useArrow=True)
    new = cut(F.when(touched, F.col("row")["text"]), "gone", "spans")
    rows = rows.withColumn("new", new).withColumn("new", F.when(touched, F.col("new")).otherwise(F.col("row")["text"]))
    rows = rows.filter(~touched | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("new"), "n_chars": F.when(touched, F.char_length("new").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return rows.select(*((changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns))
