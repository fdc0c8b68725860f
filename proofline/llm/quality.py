"""Quality rules: counts, and repetition from a suffix array.

For each text the words' suffixes are sorted by prefix doubling; the longest
common prefix of neighbours in that order gives the LCP intervals, whose strings
are the repeated substrings. A suffix's longest repeat is the larger LCP of its
two neighbours, so the union of the spans of all maximal repeats of at least
``min_repeat`` words is the union of these ranges. A text fails when they cover
more than ``max_covered`` of its words, or when one repeat is longer than
``max_longest`` of them.

A null or empty text has no words and fails the base rule. Ties and repeated rows
are judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, texts_of
from .hashing import NOT_BLANK, Words, covered, mix, ranges

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean"


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeats(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Suffix numbers and the longest repeat that starts at each (0: left out).

    The suffix array orders all texts of the run at once, each text apart.
    """
    n = len(words)
    names, _ = pd.factorize(mix(words.hash ^ mix(words.doc.astype(np.uint64))))
    levels, order = [], np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)  # the place in the order where a suffix's group begins
    bounds = np.concatenate([[True], names[order][1:] != names[order][:-1]]) if n else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(bounds, np.arange(n), 0))
    end, depth = words.first[words.doc + 1] if n else np.zeros(0, np.int64), 1
    pairs = np.zeros(0, np.int64)
    while n:
        levels.append(rank)
        size = np.bincount(rank, minlength=n)
        places = np.flatnonzero(size[rank[order]] > 1)  # in groups of several, which lie together
        if not len(places):
            break
        ids = order[places]
        after = ids + depth
        second = np.where(after < end[ids], rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.lexsort((second, rank[ids]))
        ids, second = ids[again], second[again]
        order[places] = ids
        group = rank[ids]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        rank = rank.copy()
        rank[ids] = places[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
        depth *= 2
    lcp = np.zeros(n + 1, np.int64)  # of the suffixes at places i - 1 and i
    if n:
        pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
        a, b = order[pairs - 1].copy(), order[pairs].copy()
        for k in range(len(levels) - 1, -1, -1):
            x, y = np.minimum(a, n - 1), np.minimum(b, n - 1)
            same = (levels[k][x] == levels[k][y]) & (a < n) & (b < n)
            step = np.where(same, 1 << k, 0)
            lcp[pairs] += step
            a, b = a + step, b + step
    return order, np.maximum(lcp[:-1], lcp[1:])


def measure(raw: np.ndarray, off: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    """Counts of a run of texts."""
    words = Words(raw, off, NOT_BLANK, lower=False)
    n, docs = len(words), len(off) - 1
    out = {"n_words": np.diff(words.first)}
    whole = (raw & 0xC0) != 0x80  # first bytes of characters
    out["word_chars"] = per_text(whole & NOT_BLANK[raw], off)
    out["n_symbols"] = per_text(SYMBOLS[raw], off)
    breaks = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([off[:-1], breaks + 1]))
    start = start[start < len(raw)]
    end = np.minimum(np.append(start[1:], len(raw)), len(raw))
    end = np.where(raw[np.maximum(end - 1, 0)] == 10, end - 1, end) if len(start) else end
    used = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    start, end = start[used], end[used]
    doc = np.searchsorted(off, start, "right") - 1
    line = mix(ranges(raw, start, end) ^ mix(doc.astype(np.uint64)))
    out["n_dup_lines"] = np.bincount(doc[pd.Series(line).duplicated().to_numpy()], minlength=docs)
    at, h = words.windows(3)
    code, kinds = pd.factorize(mix(h ^ mix(words.doc[at].astype(np.uint64))))
    twice = at[np.bincount(code, minlength=len(kinds))[code] >= 2] if len(at) else at
    out["n_repeat_words"] = per_text(covered(n, twice, twice + 3), words.first)
    order, longest = repeats(words)
    good = longest >= min_repeat
    at, size = order[good], longest[good]
    out["n_covered"] = per_text(covered(n, at, at + size), words.first)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, words.doc[order], longest)
    out["longest_repeat"] = most
    return out


def verdicts(m: dict[str, np.ndarray], min_words: int, min_repeat: int, max_covered: int, max_longest: int) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept from the counts."""
    n = m["n_words"]
    failed = (n < min_words) | (100 * m["n_repeat_words"] > 50 * n)
    long = (m["longest_repeat"] >= min_repeat) & (100 * m["longest_repeat"] > max_longest * n)
    return failed, ~failed & ~(100 * m["n_covered"] > max_covered * n) & ~long


def quality(docs: DataFrame, min_words: int = 50, min_repeat: int = 8, max_covered: int = 40, max_longest: int = 30) -> DataFrame:
    """Counts, base_failed and kept of every document; limits are percents of its words."""

    def run(batches):
        for b in batches:
            raw, off = texts_of(b.column(1))
            for lo, hi in chunks(off):
                m = measure(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], min_repeat)
                failed, kept = verdicts(m, min_words, min_repeat, max_covered, max_longest)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo).cast(pa.int64()), *(pa.array(m[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, min_words: int = 50, min_repeat: int = 8, max_covered: int = 40, max_longest: int = 30) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; null and empty texts go, repeated rows are judged each."""
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            raw, off = texts_of(b.column(place))
            kept = [np.zeros(0, bool)]
            for lo, hi in chunks(off):
                m = measure(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], min_repeat)
                kept.append(verdicts(m, min_words, min_repeat, max_covered, max_longest)[1])
            yield b.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
