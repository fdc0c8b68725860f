"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A text's set is its distinct shingles. Equal sets are one class. A class's signature
has ``chunks * width`` symbols, each 16 bits of a minimum. Two signatures that differ
in fewer than ``2 * chunks`` symbols have, by the pigeonhole principle, a chunk with
one wrong symbol at most; the allowed errors are enumerated by leaving out each
symbol of each chunk in turn, so such a pair always shares a key. Width and number of
chunks follow the similarity asked for: a pair at it shares no key with a chance of
at most ``MISS``.

Classes that share a key are compared without making all pairs of a group: first
each with the least class of the key, then, for keys whose classes are still in several
components, each with another member, drawn by hash, and at last, for keys
that still hold several components, all pairs across components that can be linked
at all: the shingles that a class shares with any other class of such keys bound its
similarity to each, and an odd sketch of each set bounds how many shingles a pair
does not share; both rule out pairs of heavily edited copies in the join itself.
Every link is confirmed on full sets. Links within one component cannot change the
result, so nothing is lost.

A null text, or one without words, has an empty set and no links. Rows with one
doc_id are linked only through their texts. A null doc_id is never the smallest
unless all in its component are null. An empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks as runs_of
from .common import FEW, HOT, by_key, finished, hot_keys, remove, shared_dir, stage, tasks, texts_of
from .hashing import NOT_BLANK, Words, mix, random_table

#: Candidates' ids are broadcast up to so many rows (16 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: 64-bit words of an odd sketch.
SKETCH = 16
#: Chance that a pair just at the similarity asked for shares no key.
MISS = 2e-8


def miss_chance(similarity: float, chunks: int, width: int) -> float:
    """Chance that every chunk has two wrong symbols or more."""
    one = similarity**width + width * similarity ** (width - 1) * (1 - similarity)
    return (1 - one) ** chunks


def scheme(percent: int) -> tuple[int, int]:
    """(chunks, width): a key's symbols are all right with about even chance, and ``MISS`` holds."""
    s = min(max(percent, 1), 99) / 100
    width = min(max(1 + round(math.log(0.52) / math.log(s)), 3), 8)
    return math.ceil(math.log(MISS) / math.log(miss_chance(s, 1, width))), width


def shingles(raw: np.ndarray, off: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and fingerprints of the distinct shingles, by text."""
    words = Words(raw, off, NOT_BLANK, lower=True, seed=seed)
    at, h = words.windows(size)
    doc = words.doc[at]
    n = np.diff(words.first)
    for few in range(1, size):  # a text of fewer words is one shingle
        short = np.flatnonzero(n == few)
        if len(short):
            first, whole = words.windows(few)
            keep = np.searchsorted(first, words.first[:-1][short])
            doc, h = np.concatenate([doc, short]), np.concatenate([h, whole[keep]])
    new = ~pd.Series(mix(h ^ mix(doc.astype(np.uint64)))).duplicated().to_numpy()
    doc, h = doc[new], h[new]
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def signatures(docs: DataFrame, size: int, symbols: int) -> DataFrame:
    """doc_id, text_hash, n (set size), digest of the set, sig (16-bit symbols) of every document."""

    def run(batches):
        by, plus = random_table(21, symbols) | np.uint64(1), random_table(22, symbols)
        for b in batches:
            raw, off = texts_of(b.column(1))
            for lo, hi in runs_of(off):
                doc, h = shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size)
                n = np.bincount(doc, minlength=hi - lo)
                own = np.flatnonzero(n)
                at = (np.cumsum(n) - n)[own]
                sig = np.zeros((hi - lo, symbols), "<u2")
                digest = np.zeros((hi - lo, 2), np.uint64)
                if len(own):
                    for k in range(symbols):
                        sig[own, k] = (mix(np.minimum.reduceat(h * by[k] + plus[k], at)) & np.uint64(0xFFFF)).astype("<u2")
                    digest[own, 0] = np.add.reduceat(mix(h ^ plus[0]), at)
                    digest[own, 1] = np.add.reduceat(mix(h ^ plus[1]), at)
                own = [b.column(c).slice(lo, hi - lo) for c in (0, 2)]
                yield pa.record_batch([*own, pa.array(n), pa.array([d.tobytes() for d in digest], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], ["doc_id", "text_hash", "n", "digest", "sig"])

    return identified(docs).mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, digest binary, sig binary")


def keyed(classes: DataFrame, chunks: int, width: int) -> DataFrame:
    """key, cid, n_cid (size of the class's set): each chunk of a signature with one of its symbols left out."""

    def run(batches):
        code = random_table(23, chunks * width)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, chunks * width)
            part = mix((sig.astype(np.uint64) + np.uint64(1)) * code[None, :] ^ (code[None, :] >> np.uint64(7)))
            total = part.reshape(-1, chunks, width).sum(axis=2, dtype=np.uint64)
            keys = mix((np.repeat(total, width, axis=1) - part) ^ code[None, :])
            yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), *(pa.array(np.repeat(b.column(c).to_numpy(), chunks * width)) for c in (0, 2))], ["key", "cid", "n_cid"])

    return classes.select("cid", "sig", "n").mapInArrow(run, "key bigint, cid bigint, n_cid bigint")


def shared_keys(keys: DataFrame) -> DataFrame:
    """Rows of keys that two classes or more have: key, cid, hub (the key's least cid), and n_cid, n_hub if the keys have n_cid.

    One shuffle; sorted rows stream by and nothing but the row before is held.
    """

    def run(batches):
        key = hub = held = None  # held: the first row of a key, until a second one comes
        n_hub = [0] if sized else []
        for b in batches:
            k, c, *n = (x.to_numpy() for x in b.columns)
            if not len(k):
                continue
            if held is not None:
                k, c, n = np.concatenate([[key], k]), np.concatenate([[hub], c]), [np.concatenate([[m], x]) for m, x in zip(n_hub, n)]
            first = np.concatenate([[True], k[1:] != k[:-1]])
            if held is None and key is not None:
                first[0] = k[0] != key
            start = np.maximum.accumulate(np.where(first, np.arange(len(k)), -1))
            head = np.where(start >= 0, c[np.maximum(start, 0)], hub if hub is not None else 0)
            n_head = [np.where(start >= 0, x[np.maximum(start, 0)], m) for m, x in zip(n_hub, n)]
            alone = first.copy()
            alone[:-1] &= first[1:]
            held = True if alone[-1] else None  # may still get company
            keep = ~alone
            key, hub, n_hub = int(k[-1]), int(head[-1]), [int(x[-1]) for x in n_head]
            yield pa.record_batch([pa.array(x[keep]) for x in (k, c, head, *n, *n_head)], names)

    names = ["key", "cid", "hub", *(("n_cid", "n_hub") if (sized := "n_cid" in keys.columns) else ())]
    dealt = keys.select("key", "cid", *(["n_cid"] if sized else [])).repartition(tasks(keys), "key").sortWithinPartitions("key", "cid")
    return dealt.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def able_to_link(active: DataFrame, texts: DataFrame, sizes: DataFrame, size: int, percent: int) -> DataFrame:
    """cid, n, held of the active classes that can have a link to another one.

    held: how many of a class's shingles another active class has too. Shingles of
    its own lower the similarity to any partner, so a class with many cannot link.
    """

    def run(batches):
        for b in batches:
            raw, off = texts_of(b.column(1))
            for lo, hi in runs_of(off):
                doc, h = shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(b.column(0).to_numpy()[lo:hi][doc])], ["key", "cid"])

    rows = texts.join(active.select("cid").distinct(), "cid").select("cid", "text").mapInArrow(run, "key bigint, cid bigint")
    held = shared_keys(rows).groupBy("cid").agg(F.count("*").alias("held"))
    return held.join(sizes, "cid").filter(F.col("held") * 100 >= F.col("n") * percent).select("cid", "n", "held")


def sketched(able: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``able`` with an odd sketch: bit i is the parity of the shingles dealt to it.

    The bits in which two sketches differ are never more than the shingles that only
    one of the sets has: a bound that no link breaks.
    """

    def run(batches):
        for b in batches:
            raw, off = texts_of(b.column("text"))
            for lo, hi in runs_of(off):
                doc, h = shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size)
                bit = doc * (64 * SKETCH) + (h >> np.uint64(32)).astype(np.int64) % (64 * SKETCH)
                odd = (np.bincount(bit, minlength=(hi - lo) * 64 * SKETCH) & 1).astype(np.uint8)
                longs = np.packbits(odd).view(np.int64)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, len(longs) + 1, SKETCH, dtype=np.int32)), pa.array(longs))
                yield pa.record_batch([*(b.column(c).slice(lo, hi - lo) for c in ("cid", "n", "held")), sketch], ["cid", "n", "held", "sketch"])

    return able.join(texts, "cid").mapInArrow(run, "cid bigint, n bigint, held bigint, sketch array<bigint>")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, by fingerprints that nothing before used."""

    def run(batches):
        for b in batches:
            sides = [texts_of(b.column(c)) for c in ("text_a", "text_b")]
            total = sides[0][1] + sides[1][1]
            for lo, hi in runs_of(total):
                (da, ha), (db, hb) = (shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size, seed=1) for raw, off in sides)
                ka, kb = (mix(h ^ mix(d.astype(np.uint64))) for d, h in ((da, ha), (db, hb)))
                both = da[np.isin(ka, kb, assume_unique=True)]
                n, na, nb = (np.bincount(d, minlength=hi - lo) for d in (both, da, db))
                good = np.flatnonzero((n > 0) & (100 * n >= percent * (na + nb - n))) + lo
                yield pa.record_batch([b.column("a").take(pa.array(good)), b.column("b").take(pa.array(good))], ["a", "b"])

    one = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, folder: str) -> DataFrame:
    """node, comp (the component's least node) of all nodes of the links (a, b).

    Least labels go along the links, then labels follow labels, until none changes.
    """
    spark = links.sparkSession
    edges = stage(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(F.col("e.a").alias("node"), F.col("e.b").alias("other")), f"{folder}/edges")
    labels = stage(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")), f"{folder}/labels0")
    step, hubs = 0, hot_keys(edges, "other")
    while True:
        step += 1
        of = labels.select(F.col("node").alias("other"), "comp")
        near = by_key(edges, of, "other", hot=hubs).groupBy("node").agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("comp").alias("top"))
        new = stage(low.join(up, "mid", "left").select("node", "was", F.least("mid", "top").alias("comp")), f"{folder}/labels{step}")
        if not new.filter("was != comp").head(1):
            remove(spark, f"{folder}/edges")
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def link(docs: DataFrame, size: int = 3, percent: int = 85, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    chunks, width = scheme(percent)
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    signed = stage(signatures(docs, size, chunks * width), f"{folder}/signed")
    grouped = signed.filter("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("least"))
    classes = stage(grouped.withColumn("cid", F.monotonically_increasing_id()), f"{folder}/classes")
    shared = stage(shared_keys(keyed(classes, chunks, width)), f"{folder}/shared")

    # The texts of classes that share a key: one document each, found again by its set's digest.
    wanted = stage(shared.select("cid").distinct().join(classes.select("cid", "digest"), "cid"), f"{folder}/wanted")
    texts = stage(_texts_of_classes(docs, signed, wanted, folder), f"{folder}/texts")
    sizes = classes.select("cid", "n")

    tested = links = None
    active = shared.select("key", "cid", "n_cid", F.col("cid").alias("comp"), "hub", "n_hub")
    for turn in range(rounds + 1):
        if turn == rounds:  # all that is left
            able = stage(able_to_link(active, texts, sizes, size, percent), f"{folder}/able")
            able = stage(sketched(able, texts, size), f"{folder}/sketched")
            x, y = (active.join(able, "cid").select("key", F.col("cid").alias(c), F.col("comp").alias(f"comp_{c}"), F.col("n").alias(f"n_{c}"), F.col("held").alias(f"held_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
            most = F.least("held_a", "held_b", "n_a", "n_b")  # more than that the two sets cannot share
            apart = sum((F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(1, SKETCH)), F.bit_count(F.col("sketch_a")[0].bitwiseXOR(F.col("sketch_b")[0])))
            near = (most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent) & (apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))
            pairs = x.join(y, "key").filter((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & near).select("a", "b").distinct()
        else:
            alike = (F.col("n_cid") * 100 >= F.col("n_hub") * percent) & (F.col("n_hub") * 100 >= F.col("n_cid") * percent)  # sizes come with the rows: no pair is made that they rule out
            pairs = active.filter("cid != hub").filter(alike).select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, f"{folder}/pairs{turn}")
        found = stage(confirm(pairs, texts, size, percent), f"{folder}/links{turn}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        comps = components(links, f"{folder}/components{turn}")
        if turn == rounds:
            break
        # Keys whose classes are in several components go on, with another hub.
        now = active.select("key", "cid", "n_cid").join(comps.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", "n_cid", F.coalesce("comp", "cid").alias("comp"))
        now = stage(now, f"{folder}/now{turn}")
        draw = F.struct(F.xxhash64(F.lit(turn), "key", "cid").alias("h"), F.col("cid"), F.col("comp"), F.col("n_cid"))
        split = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(draw).alias("draw"), F.count("*").alias("n")).filter("lo != hi")
        split = stage(split.select("key", F.col("draw.cid").alias("hub"), F.col("draw.comp").alias("hub_comp"), F.col("draw.n_cid").alias("hub_size"), "n"), f"{folder}/split{turn}")
        large = [r["key"] for r in split.filter((F.col("n") > FEW) & (F.col("n") * HOT > now.count())).collect()]  # HOT at most
        active = stage(by_key(now, split.drop("n"), "key", hot=large).select("key", "cid", "n_cid", "comp", *(F.when(F.col("comp") != F.col("hub_comp"), F.col(there)).otherwise(F.col(own)).alias(c) for c, there, own in (("hub", "hub", "cid"), ("n_hub", "hub_size", "n_cid")))), f"{folder}/active{turn}")
        if not active.head(1):
            break
    of_class = classes.join(comps.withColumnRenamed("node", "cid"), "cid", "left").select("digest", "least", F.coalesce("comp", "cid").alias("comp"))
    names = of_class.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = stage(of_class.join(names, "comp").select("digest", "component_id"), f"{folder}/named")
    linked = by_key(signed.filter("n > 0").select("doc_id", "n", "digest"), named, "digest").select("doc_id", "n", "component_id")
    alone = signed.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return finished(out, folder)


def _texts_of_classes(docs: DataFrame, signed: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """cid, text: of each wanted class the text of one of its rows."""
    one = signed.join(wanted, "digest").groupBy("cid").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    one = stage(one.select("cid", F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("h")), f"{folder}/chosen")
    if one.count() <= BROADCAST_ROWS:
        one = F.broadcast(one)
    rows = identified(docs)
    return rows.join(one, rows["doc_id"].eqNullSafe(one["id"]) & (rows["text_hash"] == one["h"])).select("cid", "text").dropDuplicates(["cid"])
