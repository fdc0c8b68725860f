"""Removal of lines that several documents share.

Every line of ``least`` code points or more, stripped and in lower case, becomes a
row (fingerprint, doc_id, line number). The rows are dealt to ranges of (fingerprint,
doc_id) and sorted by fingerprint, then document from the largest down, then position.
A task streams its range: the first document of a fingerprint keeps its lines, those
of the third and later ones go, those of the second go once a third is seen. A
fingerprint that a third of all lines share is cut over many ranges; only the first
and the last fingerprint of a range depend on its neighbours, and there only the rows
of two documents. They are settled by one summary row each: two a range, whatever the
corpus. The result is a compressed bitmap of kept lines a document, never text.

Fingerprints have 128 bits in two independent halves; unlike lines of 10**13 rows meet
with a chance under 10**-12.

Null and empty texts are one empty line. Rows under one doc_id are one document; a row
without doc_id is none: it keeps all lines and counts for nothing. Repeated lines of a
document count once and go or stay together. A text is held whole by one task, with
some twenty bytes for each of its bytes. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, finished, shared_dir, stage, tasks, texts_of
from .hashing import LOWER, NOT_BLANK, ranges

#: Text bytes whose lines make one range.
RANGE_BYTES = 128 << 20
#: Rows of a second document that wait for a third in memory; more of them are settled with the ranges' edges.
HELD = 1 << 16
DROPPED, OPEN, SUMMARY = 0, 1, 2
FOUND = "kind int, h1 bigint, h2 bigint, doc_id bigint, row_no bigint, line bigint, part bigint, n_docs bigint, last_doc bigint"


def line_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of a run of texts: text number, line number, first byte and end."""
    breaks = np.flatnonzero(raw == 10)
    doc = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, np.arange(len(offsets) - 1)])
    end = np.concatenate([breaks, offsets[1:]])
    order = np.lexsort((end, doc))
    doc, end = doc[order], end[order]
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    start = np.where(first, offsets[doc], np.concatenate([[0], end[:-1] + 1])[: len(end)])
    at = np.arange(len(doc))
    return doc, at - np.maximum.accumulate(np.where(first, at, 0)), start, end


def line_keys(least: int):
    """Rows of all long enough lines: two fingerprints, doc_id, row number, line number."""

    def run(batches):
        for b in batches:
            raw, off = texts_of(b.column("text"))
            rows, docs = b.column("row_no").to_numpy(), b.column("doc_id").to_numpy()
            for lo, hi in chunks(off):
                data, bounds = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                doc, line, start, end = line_bounds(data, bounds)
                solid = np.flatnonzero(NOT_BLANK[data])
                a, z = np.searchsorted(solid, start), np.searchsorted(solid, end)
                own = np.flatnonzero(a < z)
                start, end = solid[a[own]], solid[z[own] - 1] + 1
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                long = points[end] - points[start] >= least
                own, start, end = own[long], start[long], end[long]
                low = LOWER[data]
                h1, h2 = (ranges(low, start, end, seed).view(np.int64) for seed in (0, 1))
                yield pa.record_batch([pa.array(h1), pa.array(h2), pa.array(docs[lo + doc[own]]), pa.array(rows[lo + doc[own]]), pa.array(line[own])], ["h1", "h2", "doc_id", "row_no", "line"])

    return run


def numbers_of(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of each sorted row: the number, from 1, of its document within its fingerprint."""
    fresh = new | np.concatenate([[True], rows[2, 1:] != rows[2, :-1]])
    seen = np.cumsum(fresh)
    return seen - (seen[np.flatnonzero(new)] - 1)[np.cumsum(new) - 1]


class Group:
    """The fingerprint that a task is reading: its rows may lie in many batches.

    lead: the first of its range, so a range before may hold larger documents of it.
    """

    def __init__(self, least_docs: int, held_most: int, lead: bool):
        self.least_docs, self.held_most, self.lead, self.forced = least_docs, held_most, lead, False
        self.key, self.top, self.last, self.count, self.held = None, 0, None, 0, []

    def feed(self, rows: np.ndarray):
        """Take rows in order; yields (kind, rows) that are decided, or too many to hold."""
        new = np.zeros(rows.shape[1], bool)
        new[0] = True
        number = numbers_of(rows, new) + self.count - int(rows[2, 0] == self.last)
        if self.key is None:
            self.key, self.top = (int(rows[0, 0]), int(rows[1, 0])), int(rows[2, 0])
        self.last, self.count = int(rows[2, -1]), int(number[-1])
        enough = self.count >= self.least_docs
        sure = number > 1 if enough else np.zeros(len(number), bool)
        later = ~sure & ((number > 1) | self.lead)
        if enough and self.held:
            held = np.concatenate(self.held, axis=1)
            first = (held[2] == self.top) & self.lead
            self.held = [held[:, first]] if first.any() else []
            yield DROPPED, held[:, ~first]
        if sure.any():
            yield DROPPED, rows[:, sure]
        if later.any():
            self.held.append(rows[:, later])
        if sum(h.shape[1] for h in self.held) > self.held_most:
            self.forced = True
            yield OPEN, np.concatenate(self.held, axis=1)
            self.held = []

    def close(self, edge: bool):
        """edge: the range ends here. What other ranges decide is left open, with a summary."""
        if edge or self.lead or self.forced:
            yield SUMMARY, np.array([[*self.key, self.top, self.count, self.last]]).T
            if self.held:
                yield OPEN, np.concatenate(self.held, axis=1)


def stream(least_docs: int, held_most: int = HELD):
    """Verdicts over one sorted range: dropped rows, rows that other ranges decide, summaries of its edges."""

    def run(batches):
        part = TaskContext.get().partitionId()

        def out(kind, rows):
            none = pa.nulls(rows.shape[1], pa.int64())
            h1, h2, doc, a, b = (pa.array(r) for r in rows)
            own = [none, none, a, b] if kind == SUMMARY else [a, b, none, none]
            return pa.record_batch([pa.array(np.full(rows.shape[1], kind, np.int32)), h1, h2, doc, *own[:2], pa.array(np.full(rows.shape[1], part)), *own[2:]], [c.split()[0] for c in FOUND.split(", ")])

        now = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(c).to_numpy() for c in ("h1", "h2", "doc_id", "row_no", "line")])
            new = np.concatenate([[now is None or now.key != (rows[0, 0], rows[1, 0])], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
            begins = [*np.flatnonzero(new).tolist(), len(new)]
            if begins[0]:
                yield from (out(*x) for x in now.feed(rows[:, : begins[0]]))
            if len(begins) == 1:
                continue
            if now is None:
                now = Group(least_docs, held_most, lead=True)
                yield from (out(*x) for x in now.feed(rows[:, : begins[1]]))
                begins = begins[1:]
                if len(begins) == 1:
                    continue
            yield from (out(*x) for x in now.close(edge=False))
            lo, hi = begins[0], begins[-2]  # whole groups, then the one that may go on
            if hi > lo:
                mid, own = rows[:, lo:hi], new[lo:hi]
                number = numbers_of(mid, own)
                total = number[np.array(begins[1:-1]) - lo - 1]
                gone = (number > 1) & (total >= least_docs)[np.cumsum(own) - 1]
                if gone.any():
                    yield out(DROPPED, mid[:, gone])
            now = Group(least_docs, held_most, lead=False)
            yield from (out(*x) for x in now.feed(rows[:, hi:]))
        if now is not None:
            yield from (out(*x) for x in now.close(edge=True))

    return run


def shared_lines(rows: DataFrame, least: int, least_docs: int, parts: int) -> DataFrame:
    """(row_no, line) of all lines to drop."""
    keys = rows.filter("doc_id IS NOT NULL").select("row_no", "doc_id", "text").mapInArrow(line_keys(least), "h1 bigint, h2 bigint, doc_id bigint, row_no bigint, line bigint")
    order = ["h1", "h2", F.col("doc_id").desc(), "row_no", "line"]
    found = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(stream(least_docs), FOUND)
    found = stage(found, f"{shared_dir(rows.sparkSession)}/shared_lines")
    # Two rows a range: ranges of one fingerprint follow each other, so a document cut by an edge is counted twice.
    ranges_ = Window.partitionBy("h1", "h2").orderBy("part")
    edges = found.filter(F.col("kind") == SUMMARY).withColumn("again", F.coalesce(F.lag("last_doc").over(ranges_) == F.col("doc_id"), F.lit(False)).cast("int"))
    settled = edges.groupBy("h1", "h2").agg(F.sum(F.col("n_docs") - F.col("again")).alias("n"), F.max("doc_id").alias("owner"))
    late = found.filter(F.col("kind") == OPEN).join(F.broadcast(settled), ["h1", "h2"]).filter((F.col("n") >= least_docs) & (F.col("doc_id") != F.col("owner")))
    return found.filter(F.col("kind") == DROPPED).select("row_no", "line").unionByName(late.select("row_no", "line"))


def keep_bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def line_bitmaps(rows: DataFrame, least: int = 20, least_docs: int = 3) -> DataFrame:
    """row_no, doc_id, n_lines, n_dropped and the compressed bitmap ``keep`` of every numbered row.

    rows: row_no (distinct), doc_id, text; a written table, since it is read twice.
    """

    def bitmaps(batches):
        for b in batches:
            n, lists = b.column("n_lines").to_pylist(), b.column("dropped")
            maps = [keep_bitmap(k, np.array(d.as_py() or [], np.int64)) for k, d in zip(n, lists)]
            gone = [len(d.as_py() or ()) for d in lists]
            yield pa.record_batch([b.column("row_no"), b.column("doc_id"), b.column("n_lines"), pa.array(gone, pa.int64()), pa.array(maps, pa.binary())], ["row_no", "doc_id", "n_lines", "n_dropped", "keep"])

    text = F.coalesce("text", F.lit(""))
    sized = rows.select("row_no", "doc_id", (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1).cast("bigint").alias("n_lines"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dropped = shared_lines(rows, least, least_docs, max(tasks(rows), total // RANGE_BYTES))
    marks = dropped.groupBy("row_no").agg(F.collect_list("line").alias("dropped"))
    return sized.join(marks, "row_no", "left").mapInArrow(bitmaps, "row_no bigint, doc_id bigint, n_lines bigint, n_dropped bigint, keep binary")


def kept_texts(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The bitmaps' rows with ``text``: the kept lines of each text, joined by line breaks."""

    def cut(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, (n, gone, keep) in enumerate(zip(b.column("n_lines").to_pylist(), b.column("n_dropped").to_pylist(), b.column("keep"))):
                texts[i] = texts[i] or ""
                if gone:
                    texts[i] = "\n".join([x for x, k in zip(texts[i].split("\n"), kept_lines(keep.as_py(), n)) if k])
            yield pa.record_batch([*(b.column(c) for c in ("row_no", "doc_id", "n_lines", "n_dropped")), pa.array(texts, pa.string())], ["row_no", "doc_id", "n_lines", "n_dropped", "text"])

    both = rows.select("row_no", "text").join(bitmaps, "row_no")
    return both.mapInArrow(cut, "row_no bigint, doc_id bigint, n_lines bigint, n_dropped bigint, text string")


def dedup_lines(docs: DataFrame, least: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document, read from the bitmaps."""
    folder = shared_dir(docs.sparkSession)
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"), f"{folder}/rows")
    out = kept_texts(rows, line_bitmaps(rows, least, least_docs))
    return finished(out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")), folder)
