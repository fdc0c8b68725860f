"""Corpus-wide matching of fingerprints without moving positions.

Documents lie in blocks of a few megabytes, written once below the shared folder,
near copies side by side. A block finds its own sorted distinct keys, deals them to
buckets by their high bits, and each bucket, sorted by itself, answers with one bit
a key in the same order. The answers lie in one file a part (the blocks of one
writing task); the next pass over a block finds the same keys again and lays the bits
beside them. A key that a block holds many times is dealt once, so copies within a
block do not swell a bucket; a key that every block holds gives its bucket one entry
a block.

Blocks, buckets and parts grow with the square root of a corpus beyond ``EVEN`` bytes,
up to a bound, and the number of tasks follows the measured size, so the rows that are
dealt, one a block and bucket, grow as the corpus does. What decides a result is compared by
96 bits of two independent families: of 5e12 distinct fingerprints (some 100 TB) two unlike
ones meet with a chance of 2e-4. A task holds a block, its keys (at most twelve bytes a
position) and one bucket. A text over the block size is a block
by itself: its task needs about ten times the text's bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stage, tasks, texts_of
from .hashing import byte_windows, grouped, mix, numbers

#: Bytes of a block, of a bucket's share of the texts, and of a part, while the corpus has under EVEN bytes.
BLOCK, BUCKET, PART, EVEN = 3 << 20, 8 << 20, 8 << 20, 64 << 30
LARGEST, LARGEST_PART = 64 << 20, 512 << 20
TYPE = "block bigint, docs binary, bounds binary, data binary"
#: Stands for a null doc_id inside blocks.
NULL_ID = -(2**63)


@dataclass
class Block:
    """Some documents: ids, byte bounds and bytes."""

    block: int
    docs: np.ndarray
    bounds: np.ndarray
    data: np.ndarray

    def runs(self):
        """(first document, byte bounds from 0, bytes) of runs of about a megabyte."""
        for lo, hi in chunks(self.bounds):
            yield lo, self.bounds[lo : hi + 1] - self.bounds[lo], self.data[self.bounds[lo] : self.bounds[hi]]


def blocks_of(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        block, docs, bounds, data = (batch.column(c)[i] for c in ("block", "docs", "bounds", "data"))
        yield Block(block.as_py(), *(np.frombuffer(x.as_buffer(), t) for x, t in ((docs, np.int64), (bounds, np.int64), (data, np.uint8))))


def _nearness(batches):
    """Adds a number that near copies often share: the least fingerprint of a text's 24-byte strings.

    It is spread anew, since the least of many is small: long texts would all lie in the first ranges.
    """
    for b in batches:
        raw, off = texts_of(b.column(1))
        out = np.zeros(b.num_rows, np.uint64)
        for lo, hi in chunks(off):
            bounds = off[lo : hi + 1] - off[lo]
            h = byte_windows(raw[off[lo] : off[hi]], 24)
            full = np.flatnonzero(np.diff(bounds) >= 24)
            if len(full):
                # Strings that cross into the next text are masked out.
                last = np.repeat(bounds[1:], np.diff(bounds))[: len(h)]
                h = np.where(np.arange(len(h)) + 24 <= last, h, np.uint64(2**64 - 1))
                out[lo + full] = np.minimum.reduceat(h, bounds[:-1][full])
        yield pa.record_batch([b.column(0), b.column(1), pa.array(mix(out).view(np.int64))], ["doc_id", "text", "near"])


@dataclass
class Sizes:
    """How a corpus is cut: bytes of a block, bits of the bucket number, number of parts."""

    block: int
    bits: int
    parts: int


def sizes_of(docs: DataFrame) -> Sizes:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grown = max(total / EVEN, 1.0) ** 0.5
    block, bucket, part = (min(int(b * grown), most) for b, most in ((BLOCK, LARGEST), (BUCKET, LARGEST), (PART, LARGEST_PART)))
    return Sizes(block, max(total // bucket, tasks(docs) - 1, 1).bit_length(), max(tasks(docs), total // part))


def make_blocks(docs: DataFrame, where: str, sizes: Sizes) -> DataFrame:
    """Write the documents' blocks; a text over the block size is a block of its own.

    Ranges, not hashes, of the nearness decide the partition, with doc_id behind it:
    a group of copies that holds a third of all rows is split over many.
    """
    most = sizes.block

    def pack(batches):
        n = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def one():
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            return pa.record_batch([pa.array([n]), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([bounds.tobytes()]), pa.array([b"".join(texts)], pa.binary())], ["block", "docs", "bounds", "data"])

        for b in batches:
            raw, off = texts_of(b.column(1))
            data = raw.tobytes()
            for i, d in enumerate(b.column(0).to_pylist()):
                t = data[off[i] : off[i + 1]]
                if texts and size + len(t) > most:
                    yield one()
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(NULL_ID if d is None else d)
                texts.append(t)
                size += len(t)
        if texts:
            yield one()

    near = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_nearness, "doc_id bigint, text string, near bigint")
    placed = near.repartitionByRange(sizes.parts, "near", "doc_id").sortWithinPartitions("near", "doc_id").select("doc_id", "text")
    return stage(placed.mapInArrow(pack, TYPE), where)


_part: list = [None, {}]  # the part whose answers a worker read last, and they


def answers(where: str, block: int, keys: int) -> np.ndarray:
    """A block's answers of one exchange: bits in the order of its keys."""
    if not keys:
        return np.zeros(0, bool)
    name = f"{where}/{block >> 32}.parquet"
    if _part[0] != name:
        fs, path = pafs.FileSystem.from_uri(name)
        with fs.open_input_file(path) as src:
            t = pq.ParquetFile(src).read()
        _part[:] = name, {k: (n, bits) for k, n, bits in zip(*(t.column(c).to_pylist() for c in ("block", "n", "bits")))}
    n, bits = _part[1][block]
    assert n == keys, "a block's keys changed between passes"
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def keep_answers(where: str):
    """Writes rows sorted by (part, block, bucket): a file a part, moved into place when whole."""

    def run(batches):
        part, of = None, {}

        def flush():
            fs, root = pafs.FileSystem.from_uri(where)
            fs.create_dir(root, recursive=True)
            joined = [np.concatenate(bits) for bits in of.values()]
            t = pa.table([pa.array(list(of)), pa.array([len(j) for j in joined]), pa.array([np.packbits(j).tobytes() for j in joined], pa.binary())], ["block", "n", "bits"])
            mine = f"{root}/.{uuid.uuid4().hex}"
            pq.write_table(t, mine, filesystem=fs, compression="zstd")
            fs.move(mine, f"{root}/{part}.parquet")
            return pa.record_batch([pa.array([part]), pa.array([len(of)])], ["part", "blocks"])

        for b in batches:
            for now, block, n, bits in zip(*(b.column(c).to_pylist() for c in ("part", "block", "n", "bits"))):
                if part is not None and now != part:
                    yield flush()
                    of = {}
                part = now
                of.setdefault(block, []).append(np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool))
        if of:
            yield flush()

    return run


def exchange(blocks: DataFrame, where: str, keys_of: Callable, sizes: Sizes, narrow: bool = False) -> None:
    """Write, by part and block, whether each of its keys meets its like in another block.

    keys_of(Block): distinct fingerprints in the order of ``grouped``, as 64-bit keys, 32-bit
    checks of a second family, and owners. Owners are 64-bit numbers or None; with them the
    bit says whether any block has the fingerprint with a smaller owner.
    narrow: keys alone, of which only the 32 bits after the bucket's are compared; unlike
    keys may then be taken for like ones, which is enough to choose candidates.
    """
    bits = sizes.bits

    def deal(batches):
        for b in batches:
            for block in blocks_of(b):
                keys, checks, owners = (keys_of(block), None, None) if narrow else keys_of(block)
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
                at = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                body = ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4") if narrow else keys
                full = np.flatnonzero(np.diff(at))
                columns = (pa.array([None if x is None else x[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()) for x in (body, checks, owners))
                yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), block.block)), *columns], ["bucket", "block", "keys", "checks", "owners"])

    def settle(rows):
        """One bucket: sort its keys, find equal neighbours."""
        joined = lambda c, t: None if rows[0][c] is None else np.concatenate([np.frombuffer(r[c], t) for r in rows])
        keys, checks, owner = joined(1, "<u4" if narrow else "<u8"), joined(2, "<u4"), joined(3, "<i8")
        order, new = grouped(keys, checks)
        group, first = numbers(order, new), np.flatnonzero(new)
        if owner is None:
            hit = (np.diff(np.append(first, len(keys))) > 1)[group]
        else:
            hit = owner > np.minimum.reduceat(owner[order], first)[group]
        size = [len(r[1]) // keys.itemsize for r in rows]
        cut = np.concatenate([[0], np.cumsum(size)])
        return [(r[0], int(n), np.packbits(hit[a : a + n]).tobytes()) for r, n, a in zip(rows, size, cut)]

    def sort_buckets(batches):
        now, rows = None, []

        def out():
            got = settle(rows)
            return pa.record_batch([pa.array([g[0] for g in got]), pa.array(np.full(len(got), now, np.int32)), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.binary())], ["block", "bucket", "n", "bits"])

        for b in batches:
            for bucket, *row in zip(*(b.column(c).to_pylist() for c in range(5))):
                if rows and bucket != now:
                    yield out()
                    rows = []
                now = bucket
                rows.append(row)
        if rows:
            yield out()

    n = max(tasks(blocks), (1 << bits) // 4)
    dealt = blocks.mapInArrow(deal, "bucket int, block bigint, keys binary, checks binary, owners binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(sort_buckets, "block bigint, bucket int, n int, bits binary").withColumn("part", F.shiftright("block", 32))
    by_part = found.repartition(max(tasks(blocks), sizes.parts // 8), "part").sortWithinPartitions("part", "block", "bucket")
    by_part.mapInArrow(keep_answers(where), "part bigint, blocks bigint").agg(F.sum("blocks")).collect()
