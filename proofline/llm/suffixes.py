"""Removal of repeated byte strings by blockwise suffix sorting.

A string of ``size`` bytes that starts in two places is a pair of neighbours in the
suffix array at depth ``size``. The array is built blockwise: suffixes are dealt to
buckets, one bucket is sorted at a time, and only suffixes that can have a like are
dealt at all. That is told by a difference cover: of any two positions some common
shift below ``modulus`` brings both onto the cover, so a repeated string of ``size``
bytes holds a cover sample whose ``size - modulus + 1`` bytes are repeated too. The
samples (a tenth of all positions) are sorted first; a suffix none of whose samples
has a twin is never sorted. Suffixes are compared by 96-bit fingerprints of their
first ``size`` bytes, not letter by letter: a bucket's order differs from the
alphabet's, its groups of equals are the same, and a tie of any length costs one
comparison and twelve bytes.

Null and empty texts have no suffixes; repeated rows remove each other; a null
doc_id stays null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import NULL_ID, Block, answers, blocks_of, exchange, make_blocks, sizes_of
from .common import finished, shared_dir
from .hashing import byte_windows, check_bits, covered, grouped, numbers

# Perfect difference sets, each difference of the modulus once.
COVERS = {
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
}


def places(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte of a run: its place in its text, and the bytes left from it on."""
    n = np.diff(bounds)
    at = np.arange(bounds[-1])
    return at - np.repeat(bounds[:-1], n), np.repeat(bounds[1:], n) - at


def samples(block: Block, modulus: int, depth: int, bits: int):
    """Of each run: sample positions and their keys of 32 + ``bits`` bits."""
    on = np.zeros(modulus, bool)
    on[list(COVERS[modulus])] = True
    for first, bounds, data in block.runs():
        place, left = places(bounds)
        at = np.flatnonzero(on[place % modulus] & (left >= depth))
        yield first, bounds, data, at, byte_windows(data, depth)[at] >> np.uint64(32 - bits)


def sample_keys(block: Block, modulus: int, depth: int, bits: int) -> np.ndarray:
    keys = np.unique(np.concatenate([k for *_, k in samples(block, modulus, depth, bits)] or [np.zeros(0, np.uint64)]))
    return keys << np.uint64(32 - bits)


def candidates(block: Block, where: str, size: int, modulus: int, bits: int):
    """Of each run: positions of suffixes with a sample that has a twin, their keys and checks."""
    depth = size - modulus + 1
    runs = list(samples(block, modulus, depth, bits))
    keys, count = np.unique(np.concatenate([k for *_, k in runs] or [np.zeros(0, np.uint64)]), return_counts=True)
    twin = (count > 1) | answers(where, block.block, len(keys))
    for first, bounds, data, at, k in runs:
        hit = at[twin[np.searchsorted(keys, k)]] if len(at) else at
        place, left = places(bounds)
        near = covered(len(data), np.maximum(hit - modulus + 1, hit - place[hit]), hit + 1)
        own = np.flatnonzero(near & (left >= size))
        if not len(own):
            yield first, bounds, data, own, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            continue
        yield first, bounds, data, own, byte_windows(data, size)[own], check_bits(byte_windows(data, size, seed=1)[own])


def distinct(runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys and checks of a block's suffixes, how many have each, and the number of each suffix's."""
    keys = np.concatenate([r[4] for r in runs] or [np.zeros(0, np.uint64)])
    checks = np.concatenate([r[5] for r in runs] or [np.zeros(0, np.uint32)])
    order, new = grouped(keys, checks)
    first = np.flatnonzero(new)
    return keys[order][first], checks[order][first], np.diff(np.append(first, len(keys))), numbers(order, new)


def removed_spans(bounds: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of a run's removed spans, cut where one text ends and the next begins."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    # Empty texts repeat a bound, and the last ones of a run lie at its very end.
    cuts = np.unique(bounds[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(gone))]
    cuts = cuts[gone[cuts] & gone[cuts - 1]]
    return np.sort(np.concatenate([edge[::2], cuts])), np.sort(np.concatenate([edge[1::2], cuts]))


def dedup_substrings(docs: DataFrame, size: int = 200, modulus: int = 91) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed ranges of every document."""
    folder = shared_dir(docs.sparkSession)
    sizes = sizes_of(docs)
    bits, blocks = sizes.bits, make_blocks(docs, f"{folder}/blocks", sizes)
    one, two = f"{folder}/samples", f"{folder}/suffixes"
    exchange(blocks, one, lambda b: sample_keys(b, modulus, size - modulus + 1, bits), sizes, narrow=True)

    def suffix_keys(block):
        keys, checks, *_ = distinct(list(candidates(block, one, size, modulus, bits)))
        return keys, checks, None

    exchange(blocks, two, suffix_keys, sizes)

    def remove(batches):
        for b in batches:
            for block in blocks_of(b):
                runs = list(candidates(block, one, size, modulus, bits))
                keys, _, count, number = distinct(runs)
                twin = ((count > 1) | answers(two, block.block, len(keys)))[number]
                rows, done = [], 0
                for first, bounds, data, own, *_ in runs:
                    start, done = own[twin[done : done + len(own)]], done + len(own)
                    gone = covered(len(data), start, start + size)
                    begin, end = removed_spans(bounds, gone)
                    keep = data[~gone].tobytes()
                    kept = np.concatenate([[0], np.cumsum(~gone)])[bounds]
                    lo = np.searchsorted(begin, bounds)
                    for i in range(len(bounds) - 1):
                        doc = int(block.docs[first + i])
                        ranges = [{"start": int(x - bounds[i]), "end": int(y - bounds[i])} for x, y in zip(begin[lo[i] : lo[i + 1]], end[lo[i] : lo[i + 1]])]
                        n = int(bounds[i + 1] - bounds[i])
                        rows.append((None if doc == NULL_ID else doc, n, n - int(kept[i + 1] - kept[i]), len(ranges), hashlib.sha256(keep[kept[i] : kept[i + 1]]).hexdigest(), ranges))
                cols = list(zip(*rows)) or [()] * 6
                types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "ranges"])

    return finished(blocks.mapInArrow(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, ranges array<struct<start:bigint,end:bigint>>"), folder)
