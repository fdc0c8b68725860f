"""Packing documents into training windows by non-negative least squares.

Remainders (document length modulo the window) are counted in length classes of
``grain`` tokens. Shallow combinations of up to three classes that fill a window
are enumerated; non-negative least squares finds how often to repeat each against
the histogram; the repeats are rounded down to what the histogram can serve, and
what is left is packed greedily, long classes first, cut at window ends. Only the
histogram, whose size is fixed by the window, reaches the driver; documents find
their place from their rank in their class, which comes from prefix sums over
partitions, so a class that holds most rows is no hot key.

A null text is empty (its end id alone); repeated rows are packed each; an empty
table gives no rows; a null doc_id stays null. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, finished, shared_dir, stage, texts_of
from .tokens import encoder

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint"


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 of least |a x - b|: active sets, one column enters at a time."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tol:
            break
        active[j] = True
        while True:
            k = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, k], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[k] = s
                break
            low = s <= 0
            step = (x[k][low] / np.maximum(x[k][low] - s[low], 1e-300)).min()
            x[k] += step * (s - x[k])
            active[k[x[k] <= 1e-12]] = False
            x[~active] = 0
    return x


def combinations(classes: int) -> list[tuple[int, ...]]:
    """Up to three classes that add up to the window, long ones first."""
    out = [(classes,)] + [(classes - a, a) for a in range(1, classes // 2 + 1)]
    return out + [(classes - a - b, b, a) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]


def solve(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that the histogram of classes 1..n can serve."""
    n = len(histogram)
    combos = combinations(n)
    a = np.zeros((n, len(combos)))
    for j, c in enumerate(combos):
        for k in c:
            a[k - 1, j] += 1
    x = np.floor(nnls(a, histogram.astype(float)) + 1e-6).astype(np.int64)
    left, plan = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable").tolist():
        if x[j] <= 0:
            break
        uses = a[:, j].astype(np.int64)
        times = int(min(x[j], (left[uses > 0] // uses[uses > 0]).min()))
        if times > 0:
            left -= times * uses
            plan.append((combos[j], times))
    return plan


def encoded(docs: DataFrame, path: str, end_id: int, window: int, grain: int) -> DataFrame:
    """Ids of each document with its rank among its task's documents of one class."""

    def encode(batches):
        part, enc = TaskContext.get().partitionId(), encoder(path)
        dtype = "<u2" if enc.vocab <= 1 << 16 and end_id < 1 << 16 else "<u4"
        seen, full = np.zeros(window // grain + 2, np.int64), 0
        for b in batches:
            raw, off = texts_of(b.column(1))
            for lo, hi in chunks(off, 1 << 21):
                ids, at = enc.ids([raw[off[i] : off[i + 1]].tobytes().decode() for i in range(lo, hi)])
                flat = np.insert(ids, at[1:], end_id).astype(dtype)
                size = np.diff(at) + 1
                wins, kind = size // window, -(-(size % window) // grain)
                rank = np.empty(len(size), np.int64)
                for k in np.unique(kind):
                    own = np.flatnonzero(kind == k)
                    rank[own] = seen[k] + np.arange(len(own))
                    seen[k] += len(own)
                before = full + np.cumsum(wins) - wins
                full += int(wins.sum())
                cut = np.concatenate([[0], np.cumsum(size)]).tolist()
                blobs = pa.array([flat[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())
                yield pa.record_batch([pa.array(np.full(len(size), part, np.int32)), b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(size), pa.array(kind.astype(np.int32)), pa.array(rank), pa.array(before), blobs], ["part", "doc_id", "n_tokens", "kind", "rank", "full", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "part int, doc_id bigint, n_tokens bigint, kind int, rank bigint, full bigint, ids binary")


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = 2048, grain: int = 16) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, classes = docs.sparkSession, window // grain
    folder = shared_dir(spark)
    table = stage(encoded(docs, path, end_id, window, grain), f"{folder}/ids")
    counts = table.groupBy("part", "kind").agg(F.count("*").alias("n"), F.sum(F.expr(f"n_tokens div {window}")).alias("wins"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    maps = stage(ranks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("kind", "before"))).alias("before")), f"{folder}/ranks")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # two numbers a partition
    full = counts.groupBy("part").agg(F.sum("wins").alias("wins")).select("part", F.coalesce(F.sum("wins").over(upto), F.lit(0)).alias("first_full"))
    starts = stage(maps.join(full, "part").select("part", "before", "first_full"), f"{folder}/starts")

    histogram, n_full = np.zeros(classes, np.int64), 0  # a row a class: bounded by the window
    for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("wins").alias("wins")).collect():
        n_full += r["wins"]
        if r["kind"]:
            histogram[r["kind"] - 1] = r["n"]
    plan = solve(histogram)
    serve: dict[int, list] = {k: [] for k in range(1, classes + 1)}  # class: (first rank, a sequence's share, first sequence, slot)
    used, seq = np.zeros(classes + 1, np.int64), n_full
    for combo, times in plan:
        for k in dict.fromkeys(combo):
            share = combo.count(k)
            serve[k].append((int(used[k]), share, seq, combo.index(k)))
            used[k] += share * times
        seq += times
    rest, at = {}, 0  # class: where its left-over documents begin
    for k in range(classes, 0, -1):
        rest[k] = at
        at += int(histogram[k - 1] - used[k]) * k * grain
    ranks_of = {k: np.array([s[0] for s in v]) for k, v in serve.items()}

    def place(batches):
        for b in batches:
            out: list[tuple] = []
            width = None
            for part_first, before, doc, n, kind, rank, full, blob in zip(*(b.column(c).to_pylist() for c in ("first_full", "before", "doc_id", "n_tokens", "kind", "rank", "full", "ids"))):
                width = len(blob) // n
                ids = np.frombuffer(blob, f"<u{width}").astype("<u4")
                pieces = [(w * window, window, part_first + full + w, 0) for w in range(n // window)]
                start, length = n - n % window, n % window
                if length:
                    r = before + rank
                    if r < used[kind]:
                        first, share, seq0, slot = serve[kind][int(np.searchsorted(ranks_of[kind], r, "right")) - 1]
                        pieces.append((start, length, seq0 + (r - first) // share, slot + (r - first) % share))
                    else:
                        v = rest[kind] + int(r - used[kind]) * kind * grain
                        while length:
                            take = min(length, window - v % window)
                            pieces.append((start, take, seq + v // window, v % window))
                            start, v, length = start + take, v + take, length - take
                out += [(doc, s, m, zlib.crc32(ids[s : s + m]), n, q, slot) for s, m, q, slot in pieces]
            cols = list(zip(*out)) or [()] * 7
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    # A row a partition: Spark broadcasts it while its files are under the session's bound, and else shuffles.
    joined = table.join(starts, "part").select("first_full", F.coalesce(F.element_at("before", F.col("kind")), F.lit(0)).alias("before"), "doc_id", "n_tokens", "kind", "rank", "full", "ids")
    pieces = joined.mapInArrow(place, PIECE)
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return finished(pieces.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("slot"), folder)
