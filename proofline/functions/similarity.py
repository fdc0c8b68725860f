"""String similarity and statement differences, scored in Arrow batches.

A score is 100 * 2 * LCS / (m + n). Rows that need no score come in as null and
cost nothing; a pair is scored once for all batches of a worker, while it is among the
last ``REMEMBERED`` ones of its kind.
"""

from __future__ import annotations

import difflib
import re
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .text import STATEMENT


# Fixed value: how many pairs of a kind a worker keeps the scores of.
REMEMBERED = 1 << 16


def found_by_prefix(a: str, b: str):
    """The common length of ``a`` with each prefix of ``b``, one step a letter: bits of one number at a time."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    rest = full = (1 << len(a)) - 1
    for ch in b:
        hit = rest & where.get(ch, 0)
        rest = ((rest + hit) | (rest - hit)) & full
        yield len(a) - rest.bit_count()


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    found = 0
    for found in found_by_prefix(a, b):
        pass
    return found


@lru_cache(maxsize=REMEMBERED)
def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * common(a, b) / total if total else 100.0


@lru_cache(maxsize=REMEMBERED)
def window_ratio(a: str, b: str) -> float:
    """The shorter text against every window of the longer, shorter ones at its ends.

    One pass each scores all windows at an end; of the windows inside, none is scored
    once one equals the text.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    m, n = len(a), len(b)
    best = max(ratio.__wrapped__(a, b[i : i + m]) for i in range(n - m + 1))
    ends = [(a, b), (a[::-1], b[::-1])]
    if m == n:
        ends += [(b, a), (b[::-1], a[::-1])]
    return max([best, *(100.0 * 2 * found / (m + k) for x, y in ends for k, found in enumerate(found_by_prefix(x, y[: m - 1]), 1))])


@lru_cache(maxsize=REMEMBERED)
def sorted_ratio(a: str, b: str) -> float:
    return ratio.__wrapped__(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@lru_cache(maxsize=REMEMBERED)
def set_ratio(a: str, b: str) -> float:
    """Shared words count once; what is left of each side is compared behind them."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    head, left, right = " ".join(both), " ".join(only_x), " ".join(only_y)
    gap = len(head) + 1 if both else 0
    apart = len(left) + len(right) - 2 * common(left, right)
    lengths = 2 * gap + len(left) + len(right)
    best = 100.0 * (1 - apart / lengths)
    if both:
        for side in (left, right):
            whole = len(head) + 1 + len(side)
            best = max(best, 100.0 * 2 * len(head) / (len(head) + whole))
    return best


KINDS = {"ratio": ratio, "window": window_ratio, "sorted": sorted_ratio, "set": set_ratio}


def scores(**pairs: tuple[str, Column, Column]) -> Column:
    """A struct of scores: name=(kind, a, b). One pass through Python for all of them."""
    names, kinds = list(pairs), [p[0] for p in pairs.values()]

    def run(*cols: pd.Series) -> pd.DataFrame:
        out = {}
        for i, (name, kind) in enumerate(zip(names, kinds)):
            one = KINDS[kind]
            got = [None if a is None or b is None else one(a, b) for a, b in zip(cols[2 * i], cols[2 * i + 1])]
            out[name] = pd.Series(got, dtype="float64")
        return pd.DataFrame(out)

    return pandas_udf(run, ", ".join(f"{n} double" for n in names))(*(c for p in pairs.values() for c in p[1:]))


def score(kind: str, a: Column, b: Column) -> Column:
    return scores(s=(kind, a, b))["s"]


def ratio_to(text: Column, target: str) -> Column:
    """The score of a column against a fixed text of at most 62 letters, by built-in expressions: a bit for each of its letters."""
    where: dict[str, int] = {}
    for i, ch in enumerate(target):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(target)) - 1
    masks = F.create_map(*(F.lit(x).cast("bigint" if k % 2 else "string") for pair in where.items() for k, x in enumerate(pair)))

    def step(rest: Column, ch: Column) -> Column:
        hit = rest.bitwiseAND(F.coalesce(F.try_element_at(masks, ch), F.lit(0).cast("bigint")))
        return (rest + hit).bitwiseOR(rest - hit).bitwiseAND(F.lit(full).cast("bigint"))

    shared = len(target) - F.bit_count(F.aggregate(F.split(text, ""), F.lit(full).cast("bigint"), step))
    return 200.0 * shared / (F.length(text) + len(target))


def edits(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def plain_words(text: str) -> list[str]:
    # What clause numbers are misread as.
    text = re.sub(r"\(\s*[lI|!i]\s*\)", " 1 ", text)
    text = re.sub(r"\(\s*[zZ]\s*\)", " 2 ", text)
    return re.sub(r"[^a-z0-9]+", " ", text.casefold()).split()


# The word whose loss turns the meaning, how many lost words a misread explains,
# the longest speck, the least parts and likeness of words, and the most letters a misread gets wrong.
MEANING, MOST_LOST = "not", 4
LONGEST_SPECK, LEAST_PART, LEAST_LIKE, LIKENESS, LEAST_WORD, MOST_WRONG = 2, 2, 3, 66, 4, 2
_STATEMENT_WORDS = frozenset(plain_words(STATEMENT))


class Gap(NamedTuple):
    """Where two word sequences part: words of the first alone, of the second alone."""

    lost: list[str]
    found: list[str]
    at_end: bool

    def text(self) -> str:
        if self.at_end and not self.lost:
            return f"after:|{' '.join(self.found)}"
        kind = {(True, True): "substituted", (True, False): "missing", (False, True): "unexpected"}[bool(self.lost), bool(self.found)]
        return f"{kind}:{' '.join(self.lost)}|{' '.join(self.found)}"


def gaps(want: list[str], got: list[str]) -> list[Gap]:
    """What lies between the blocks that both sequences share."""
    out, i, k = [], 0, 0
    for block in difflib.SequenceMatcher(None, want, got, autojunk=False).get_matching_blocks():
        if block.a > i or block.b > k:
            out.append(Gap(want[i : block.a], got[k : block.b], i == len(want)))
        i, k = block.a + block.size, block.b + block.size
    return out


#: How a reading can have come by a word that is not printed: reason, and the test (word, words lost there, words of doubt).
REASONS = {
    "doubt": lambda w, lost, doubt: w in doubt,
    "speck": lambda w, lost, doubt: len(w) <= LONGEST_SPECK and (w.isdigit() or w not in _STATEMENT_WORDS),
    "part": lambda w, lost, doubt: len(w) >= LEAST_PART and w in "".join(lost),
    "like": lambda w, lost, doubt: len(w) >= LEAST_LIKE and window_ratio(w, "".join(lost)) >= LIKENESS,
    "near": lambda w, lost, doubt: any(len(x) >= LEAST_WORD and edits(x, w) <= MOST_WRONG for x in lost),
}
#: Reasons that say nothing of the printed words: what stood there is lost.
MARKS = {"doubt", "speck"}


@lru_cache(maxsize=4096)
def differences(expected: str, observed: str, unsure: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(alterations, misreads) between two statements, each as kind:expected|found.

    A word with no reason, or the loss of the meaning word, is an alteration; text
    behind the statement is none. Words lost beyond a bound are alterations too,
    all of them, unless a part of the statement is in doubt.
    """
    doubt = {w for u in unsure for w in plain_words(u)}
    rows = []
    for gap in gaps(plain_words(expected), plain_words(observed)):
        reasons = {next((name for name, test in REASONS.items() if test(w, gap.lost, doubt)), None) for w in gap.found}
        turned = not unsure and MEANING in gap.lost and not any(MEANING in w for w in gap.found)
        rows.append((turned or (None in reasons and not (gap.at_end and not gap.lost)), len(gap.lost) if reasons <= MARKS else 0, gap.text()))
    too_many = not unsure and sum(lost for altered, lost, _ in rows if not altered) > MOST_LOST
    sides = [tuple(text for altered, _, text in rows if altered is side) for side in (True, False)]
    return (sides[0] + sides[1], ()) if too_many else (sides[0], sides[1])


def statement_differences(expected: pd.Series, observed: pd.Series, unsure: pd.Series) -> pd.DataFrame:
    out = []
    for e, o, u in zip(expected, observed, unsure):
        pair = (None, None) if e is None or o is None else differences(e, o, tuple(u) if u is not None else ())
        out.append([None if p is None else list(p) for p in pair])
    return pd.DataFrame(out, columns=["altered", "misread"])


def deviations(expected: Column, observed: Column, unsure: Column) -> Column:
    """struct(altered, misread) of rows with an observed text; null rows are not compared."""
    return pandas_udf(statement_differences, "altered array<string>, misread array<string>")(expected, observed, F.coalesce(unsure, F.array().cast("array<string>")))


def word_listing(expected: str, observed: str) -> list[str]:
    """Missing, unexpected and substituted words between two texts."""
    return [Gap(g.lost, g.found, False).text() for g in gaps(expected.split(), observed.split())]


def word_difference(expected: Column, observed: Column) -> Column:
    """``word_listing`` as a column."""

    def run(expected: pd.Series, observed: pd.Series) -> pd.Series:
        return pd.Series([None if e is None or o is None else word_listing(e, o) for e, o in zip(expected, observed)])

    return pandas_udf(run, "array<string>")(expected, observed)
