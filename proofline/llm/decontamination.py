"""Benchmark decontamination by winnowing.

Of every run of w consecutive k-word fingerprints the smallest is kept, in
benchmark items and documents alike; equal content keeps equal fingerprints, so a
shared span of w + k - 1 words always shares one. Shared fingerprints are seeds:
each is compared word by word with its item and extended both ways along its
diagonal. A span counts when it holds a whole window: ``span`` consecutive item
words, or all words of an item that has fewer.

The items' fingerprints go to every task while the items' texts are under
``bound`` bytes (measured first); beyond it, document fingerprints are joined with
item fingerprints and only documents with seeds are read again.

Null texts have no words: nothing is hit. Items without words are ignored;
repeated items count as one id; an item with a null id marks words but is not
listed. Repeated documents get a row each; an empty documents table gives no
rows, an empty benchmark no hits. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, shared_dir, stage, texts_of
from .hashing import ALNUM, LOWER, Words, windows

SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words bigint, items array<bigint>, spans array<struct<start:bigint,end:bigint>>"


def scheme(n_words: int, span: int, k: int) -> tuple[int, int]:
    """(k, w) whose guarantee is the window of an item with so many words."""
    size = min(n_words, span)
    k = min(k, size)
    return k, size - k + 1


def winnow(words: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and fingerprints kept: minima, ties included, of runs in one text."""
    h = windows(words.hash, k)
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = h[:n].copy()
    for s in range(1, w):
        np.minimum(least, h[s : s + n], out=least)
    whole = words.doc[:n] == words.doc[w + k - 2 : w + k - 2 + n]
    keep = np.zeros(len(h), bool)
    for s in range(w):
        keep[s : s + n] |= whole & (h[s : s + n] == least)
    at = np.flatnonzero(keep)
    return at, h[at]


class Index:
    """Items' words and fingerprints, for seeds and their extension."""

    def __init__(self, items: list[tuple[int | None, str | None]], span: int, k: int):
        self.names, self.words, self.need = [], [], []
        by_scheme = defaultdict(list)
        raw, off = texts_of(pa.array([t for _, t in items], pa.string()))
        all_words = Words(raw, off, ALNUM, lower=True)
        low = LOWER[raw].tobytes()
        for i, (name, _) in enumerate(items):
            a, b = all_words.first[i], all_words.first[i + 1]
            if a == b:
                continue
            self.names.append(name)
            self.words.append([low[s:e] for s, e in zip(all_words.start[a:b].tolist(), all_words.end[a:b].tolist())])
            self.need.append(min(span, int(b - a)))
            by_scheme[scheme(int(b - a), span, k)].append((len(self.names) - 1, int(a), int(b)))
        self.schemes = []
        for (kk, w), own in by_scheme.items():
            at, h = winnow(all_words, kk, w)
            lo = np.array([a for _, a, _ in own])
            no = np.searchsorted(lo, at, "right") - 1
            good = (no >= 0) & (at < np.array([b for *_, b in own])[no])
            at, h, no = at[good], h[good], no[good]
            order = np.argsort(h, kind="stable")
            self.schemes.append((kk, w, h[order], np.array([i for i, *_ in own])[no[order]], (at - lo[no])[order]))

    def find(self, words: Words, low: bytes):
        """Of each text with hits: its number, hit words as ranges, item names."""
        seeds = defaultdict(list)
        for kk, w, fps, item, pos in self.schemes:
            at, h = winnow(words, kk, w)
            left = np.searchsorted(fps, h, "left")
            hit = np.flatnonzero(fps[np.minimum(left, len(fps) - 1)] == h) if len(fps) else []
            right = np.searchsorted(fps, h[hit], "right") if len(fps) else []
            for p, a, b in zip(at[hit].tolist() if len(fps) else [], left[hit].tolist() if len(fps) else [], right.tolist() if len(fps) else []):
                seeds[int(words.doc[p])].append((p, item[a:b], pos[a:b]))
        for doc, found in seeds.items():
            base, top = int(words.first[doc]), int(words.first[doc + 1])
            mine = [low[s:e] for s, e in zip(words.start[base:top].tolist(), words.end[base:top].tolist())]
            done: dict[tuple[int, int], int] = {}
            ranges, names = [], set()
            for p, items, places in sorted(found, key=lambda x: x[0]):
                p -= base
                for i, q in zip(items.tolist(), places.tolist()):
                    if done.get((i, p - q), -1) > p:
                        continue  # a seed within the last extension on this diagonal
                    theirs, a, b = self.words[i], p, p
                    while b < len(mine) and b - p + q < len(theirs) and mine[b] == theirs[b - p + q]:
                        b += 1
                    while a > 0 and a - p + q > 0 and mine[a - 1] == theirs[a - 1 - p + q]:
                        a -= 1
                    done[i, p - q] = max(b, p + 1)
                    if b - a >= self.need[i]:
                        ranges.append((a, b))
                        if self.names[i] is not None:
                            names.add(self.names[i])
            if ranges:
                yield doc, union(ranges), sorted(names)


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged ranges; those that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _batch(head: list[pa.Array], names: list[str], n_words: np.ndarray, found: dict) -> pa.RecordBatch:
    n = len(n_words)
    items = pa.array([found[i][1] if i in found else [] for i in range(n)], pa.list_(pa.int64()))
    spans = pa.array([[{"start": a, "end": b} for a, b in found[i][0]] if i in found else [] for i in range(n)], SPAN_TYPE)
    return pa.record_batch([*head, pa.array(n_words, pa.int64()), items, spans], [*names, "n_words", "items", "spans"])


def find_contamination(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 6, bound: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, items (sorted ids), spans (merged hit word ranges) of every document."""
    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null")
    size = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size <= bound:
        index_of = [(r["item_id"], r["text"]) for r in texts.collect()]

        def search(batches):
            index = Index(index_of, span, k)
            for b in batches:
                raw, off = texts_of(b.column(1))
                for lo, hi in chunks(off):
                    part = raw[off[lo] : off[hi]]
                    words = Words(part, off[lo : hi + 1] - off[lo], ALNUM, lower=True)
                    found = {d: (r, n) for d, r, n in index.find(words, LOWER[part].tobytes())}
                    yield _batch([b.column(0).slice(lo, hi - lo).cast(pa.int64())], ["doc_id"], np.diff(words.first), found)

        return docs.select("doc_id", "text").mapInArrow(search, f"doc_id bigint, {FOUND}")
    return _joined(docs, texts, span, k)


def _joined(docs: DataFrame, texts: DataFrame, span: int, k: int) -> DataFrame:
    """The same for a benchmark of any size: fingerprints meet in a join."""
    folder = shared_dir(docs.sparkSession)

    def numbered(batches):
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            yield pa.record_batch([pa.array(np.arange(at, at + b.num_rows)), *b.columns], ["row", *b.schema.names])
            at += b.num_rows

    def fingerprints(lengths):
        def run(batches):
            for b in batches:
                raw, off = texts_of(b.column(1))
                for lo, hi in chunks(off):
                    words = Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ALNUM, lower=True)
                    row = b.column(0).to_numpy()[lo:hi]
                    n = np.diff(words.first)
                    for size in lengths:
                        kk, w = scheme(size, span, k)
                        at, h = winnow(words, kk, w)
                        keep = words.doc[at]
                        if b.schema.names[2] == "item_id":  # an item has one scheme
                            own = np.minimum(n[keep], span) == size
                            keep, h = keep[own], h[own]
                        pairs = np.unique(np.stack([row[keep], h.view(np.int64)]), axis=1)
                        yield pa.record_batch([pa.array(pairs[0]), pa.array(np.full(pairs.shape[1], size, np.int32)), pa.array(pairs[1])], ["row", "size", "h"])

        return run

    def extend(batches):
        for b in batches:
            rows, out = b.to_pydict(), []
            for row, text, item, item_text in zip(rows["row"], rows["text"], rows["item_id"], rows["item_text"]):
                raw = np.frombuffer(text.encode(), np.uint8)
                words = Words(raw, np.array([0, len(raw)]), ALNUM, lower=True)
                for _, ranges, _ in Index([(0, item_text)], span, k).find(words, LOWER[raw].tobytes()):
                    out.append((row, item, [{"start": x, "end": y} for x, y in ranges]))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], SPAN_TYPE)], ["row", "item_id", "spans"])

    def lengths_of(batches):
        for b in batches:
            raw, off = texts_of(b.column(0))
            yield pa.record_batch([pa.array(np.minimum(np.diff(Words(raw, off, ALNUM, lower=True).first), span), pa.int32())], ["size"])

    row_type = "row bigint, size int, h bigint"
    d = stage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(numbered, "row bigint, doc_id bigint, text string"), f"{folder}/docs")
    t = stage(texts.mapInArrow(numbered, "row bigint, item_id bigint, text string"), f"{folder}/items")
    sizes = sorted(r["size"] for r in t.select("text").mapInArrow(lengths_of, "size int").distinct().collect() if r["size"])  # at most ``span`` values
    seeds = d.select("row", "text").withColumn("doc_id", F.lit(0)).mapInArrow(fingerprints(sizes), row_type)
    keys = t.select("row", "text", "item_id").mapInArrow(fingerprints(sizes), row_type).withColumnRenamed("row", "item")
    pairs = seeds.join(keys, ["size", "h"]).select("row", "item").distinct()
    both = pairs.join(t.select(F.col("row").alias("item"), "item_id", F.col("text").alias("item_text")), "item").join(d.select("row", "text"), "row")
    found = both.select("row", "text", "item_id", "item_text").mapInArrow(extend, "row bigint, item_id bigint, spans array<struct<start:bigint,end:bigint>>")
    per_doc = found.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def finish(batches):
        for b in batches:
            raw, off = texts_of(b.column("text"))
            n = np.diff(Words(raw, off, ALNUM, lower=True).first)
            got = {i: (union([(x["start"], x["end"]) for x in s]), m or []) for i, (s, m) in enumerate(zip(b.column("spans").to_pylist(), b.column("items").to_pylist())) if s}
            yield _batch([b.column("doc_id")], ["doc_id"], n, got)

    return d.join(per_doc, "row", "left").select("doc_id", "text", "items", "spans").mapInArrow(finish, f"doc_id bigint, {FOUND}")


def report(found: DataFrame) -> DataFrame:
    """Counts and the digest of the item list for each document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
