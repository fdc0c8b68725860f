"""Removal of passages that an earlier document has, by seed and extend.

Winnowing keeps, of every run of consecutive k-word fingerprints in a window of
``size`` words, the smallest: two equal windows keep an equal anchor. Documents meet
on anchors (the seeds). From each anchor that another document may share, the match
is extended both ways within the document over all windows that hold the anchor;
each such window is confirmed by its own fingerprint of 96 bits against the smallest
doc_id that has it. Runs of confirmed windows are the maximal repeats, and their words go.
Confirming windows against one owner, not documents against each other, keeps a
passage that a third of all documents share from making pairs.

Null and empty texts have no words; equal doc_ids are no smaller than each other, so
rows repeated under one id stay; a null doc_id neither loses words nor takes them
from others. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import NULL_ID, Block, answers, blocks_of, exchange, make_blocks, sizes_of
from .common import finished, shared_dir
from .decontamination import winnow
from .hashing import NOT_BLANK, Words, check_bits, covered, grouped, numbers

OWNER = np.int64(2**63 - 1)  # of windows in documents without an id


def anchors(block: Block, size: int):
    k = (size + 1) // 2
    for first, bounds, data in block.runs():
        words = Words(data, bounds, NOT_BLANK, lower=False)
        at, h = winnow(words, k, size - k + 1)
        yield first, bounds, data, words, at, h


def anchor_keys(block: Block, size: int, bits: int) -> np.ndarray:
    keys = np.unique(np.concatenate([h >> np.uint64(32 - bits) for *_, h in anchors(block, size)] or [np.zeros(0, np.uint64)]))
    return keys << np.uint64(32 - bits)


def extended(block: Block, where: str, size: int, bits: int):
    """Of each run: first words of windows around shared anchors, fingerprints, owners."""
    k, runs = (size + 1) // 2, list(anchors(block, size))
    keys, count = np.unique(np.concatenate([h >> np.uint64(32 - bits) for *_, h in runs] or [np.zeros(0, np.uint64)]), return_counts=True)
    twin = (count > 1) | answers(where, block.block, len(keys))
    for first, bounds, data, words, at, h in runs:
        seed = at[twin[np.searchsorted(keys, h >> np.uint64(32 - bits))]] if len(at) else at
        near = covered(len(words), np.maximum(seed + k - size, 0), seed + 1)
        start, print_ = words.windows(size)
        good = near[start] if len(start) else np.zeros(0, bool)
        start, print_, check = start[good], print_[good], np.zeros(0, np.uint32)
        if len(start):
            check = check_bits(Words(data, bounds, NOT_BLANK, lower=False, seed=1).windows(size)[1][good])
        doc = block.docs[first + words.doc[start]] if len(start) else np.zeros(0, np.int64)
        yield first, bounds, data, words, start, print_, check, np.where(doc == NULL_ID, OWNER, doc)


def least(runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys and checks of a block's windows, the smallest doc_id of each, and the number of each window's."""
    keys, checks, owner = (np.concatenate([r[c] for r in runs] or [np.zeros(0, t)]) for c, t in ((5, np.uint64), (6, np.uint32), (7, np.int64)))
    order, new = grouped(keys, checks)
    first = np.flatnonzero(new)
    lowest = np.minimum.reduceat(owner[order], first) if len(first) else owner
    return keys[order][first], checks[order][first], lowest, numbers(order, new)


def dedup_passages(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed word ranges of every document."""
    folder = shared_dir(docs.sparkSession)
    sizes = sizes_of(docs)
    bits, blocks = sizes.bits, make_blocks(docs, f"{folder}/blocks", sizes)
    one, two = f"{folder}/anchors", f"{folder}/windows"
    exchange(blocks, one, lambda b: anchor_keys(b, size, bits), sizes, narrow=True)
    exchange(blocks, two, lambda b: least(list(extended(b, one, size, bits)))[:3], sizes)

    def remove(batches):
        for b in batches:
            for block in blocks_of(b):
                runs = list(extended(block, one, size, bits))
                keys, _, owner, number = least(runs)
                smaller = answers(two, block.block, len(keys))
                rows, done = [], 0
                for first, bounds, data, words, start, *_, mine in runs:
                    at, done = number[done : done + len(start)], done + len(start)
                    start = start[(smaller[at] | (mine > owner[at])) & (mine != OWNER)]
                    gone = covered(len(words), start, start + size)
                    stay = np.flatnonzero(~gone)
                    doc = words.doc[stay]
                    last = np.ones(len(stay), bool)  # the last kept word of its text has no blank after it
                    last[:-1] = doc[1:] != doc[:-1]
                    keep = covered(len(data), words.start[stay], words.end[stay])
                    text, blank = data.copy(), words.end[stay[~last]]
                    text[blank] = 32
                    keep[blank] = True
                    joined = text[keep].tobytes()
                    cut = np.concatenate([[0], np.cumsum(keep)])[bounds]
                    n = np.diff(words.first)
                    removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
                    for i in range(len(bounds) - 1):
                        d, a, z = int(block.docs[first + i]), int(words.first[i]), int(words.first[i + 1])
                        ranges = []
                        if removed[i + 1] > removed[i]:
                            own = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:z], [False]])))
                            ranges = [{"start": int(x), "end": int(y)} for x, y in zip(own[::2], own[1::2])]
                        rows.append((None if d == NULL_ID else d, int(n[i]), int(removed[i + 1] - removed[i]), hashlib.sha256(joined[cut[i] : cut[i + 1]]).hexdigest(), ranges))
                cols = list(zip(*rows)) or [()] * 5
                types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_words", "n_removed", "kept_sha256", "ranges"])

    return finished(blocks.mapInArrow(remove, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, ranges array<struct<start:bigint,end:bigint>>"), folder)
