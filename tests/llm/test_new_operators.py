"""Whitening, spelling variants and line removal against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import lines, spelling, whitening
from tests.llm.conftest import table

LOWER = {i: i + 32 for i in range(65, 91)}


def lines_brute(rows, least=20, least_docs=3):
    holders = defaultdict(set)
    keyed = [(i, [(x, x.strip(" \t\n\v\f\r").translate(LOWER)) for x in (t or "").split("\n")]) for i, t in rows]
    for i, own in keyed:
        for _, k in own:
            if len(k) >= least and i is not None:
                holders[k].add(i)
    out = []
    for i, own in keyed:
        keep = [x for x, k in own if not (i is not None and len(holders.get(k, ())) >= least_docs and i != max(holders[k]))]
        out.append((i, len(own), len(own) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


def line_rows():
    r = random.Random(3)
    pool = [" ".join(r.choice(("alpha", "Beta", "gámma", "delta")) for _ in range(r.randrange(2, 9))) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (None, pool[0]), (None, "Terms apply to all of this text"), (3, " Terms APPLY to all of this text\t"), (7, "x" * 400_000 + "\nTerms apply to all of this text")]
    rows += [(10 + i, "\n".join(["Terms apply to all of this text", *r.choices(pool, k=r.randrange(12)), "  ÀÉ " * r.randrange(3)])) for i in range(120)]
    return [*rows, *rows[20:30], (20, pool[1] + "\n" + pool[1])]  # rows repeated under their ids


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_shared_lines_over_any_ranges(spark, parts):
    rows = line_rows()
    numbered = common_rows(spark, rows)
    dropped = lines.shared_lines(numbered, 20, 3, parts).groupBy("row_no").agg(F.collect_list("line").alias("l"))
    got = {r.row_no: sorted(r.l) for r in dropped.collect()}
    want = lines_brute(rows)
    assert {i: len(got.get(i, ())) for i in range(len(rows))} == {i: w[2] for i, w in enumerate(want)}
    assert max(w[2] for w in want) > 3


def common_rows(spark, rows):
    t = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "row_no bigint, doc_id bigint, text string")
    return t.repartition(4).cache()


def test_rows_that_wait_are_bounded():
    """Undecided rows beyond the bound are let go, and settled by the summaries, with the same verdicts."""
    rows = np.array([[1, 1, 9, 0, 0], *([1, 1, 8, 1, k] for k in range(50)), [1, 1, 7, 2, 0], [2, 2, 9, 0, 1], *([2, 2, 8, 1, k] for k in range(60)), [3, 3, 5, 3, 0]], np.int64).T
    import pyarrow as pa

    batch = lambda a: pa.record_batch([pa.array(x) for x in a], ["h1", "h2", "doc_id", "row_no", "line"])
    lines.TaskContext, old = type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}), lines.TaskContext
    try:
        kinds = [Counter(), Counter()]
        for k, most in enumerate((10, 1 << 16)):
            for b in lines.stream(3, most)([batch(rows[:, i : i + 13]) for i in range(0, rows.shape[1], 13)]):
                for kind, h in zip(b.column("kind").to_pylist(), b.column("h1").to_pylist()):
                    kinds[k][kind, h] += 1
    finally:
        lines.TaskContext = old
    assert kinds[1][lines.DROPPED, 1] == 51 and kinds[1][lines.DROPPED, 2] == 0
    assert kinds[0][lines.DROPPED, 1] + kinds[0][lines.OPEN, 1] - 1 == 51  # the first document's row is open: the range's first
    assert kinds[0][lines.OPEN, 2] > 10 and kinds[0][lines.SUMMARY, 2] == 1


def test_line_dedup(spark, docs, nothing, rows):
    got = Counter(map(tuple, lines.dedup_lines(docs).collect()))
    assert got == Counter(lines_brute(rows))
    own = line_rows()
    assert Counter(map(tuple, lines.dedup_lines(table(spark, own)).collect())) == Counter(lines_brute(own))
    assert lines.dedup_lines(nothing).count() == 0


def test_bitmaps_are_small_and_exact():
    gone = np.array([0, 5, 99_999])
    packed = lines.keep_bitmap(100_000, gone)
    assert len(packed) < 200 and np.flatnonzero(~lines.kept_lines(packed, 100_000)).tolist() == gone.tolist()


def words_brute(rows, letters=6, least=5):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            n[word] += len(word) >= letters
    return {w: k for w, k in n.items() if k >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spellings_brute(rows):
    n = words_brute(rows)
    out, form = {}, {}
    for w in n:
        close = sorted((-n[o], o) for o in n if near(w, o))
        form[w] = close[0][1] if close and -close[0][0] >= 5 * n[w] else None
        out[w] = [form[w], None, n[w], len(close), n[form[w]] if form[w] else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


def spelling_rows():
    r = random.Random(11)
    stems = ["walking", "wolking", "walkings", "colours", "colors", "naïveté", "naïvete", "aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaa", "aaaaab", "signal", "signals", "sìgnals", "xsignal"]
    stems += ["".join(r.choice("abé") for _ in range(r.randrange(6, 9))) for _ in range(60)]
    stems.append("long" * 4000)
    rows = []
    for i in range(90):
        own = [s for k, s in enumerate(stems) for _ in range(r.choice((0, 0, 1, 1 + 7 * (k % 5 == 0), 40 * (k % 11 == 0))))]
        rows.append((i, " ".join(s.title() if r.random() < 0.2 else s for s in own)))
    rows.append((94, "kettlen " * 6 + "kettles " * 32 + "kettless " * 170))
    return [*rows, (None, "walking " * 9), (None, None), (95, ""), rows[3], rows[3]]


@pytest.mark.parametrize("few, long_list", [(8, 64), (1, 3), (40, 1)])
def test_spellings(spark, few, long_list):
    rows = spelling_rows()
    want = spellings_brute(rows)
    got = spelling.group_spellings(table(spark, rows), few=few, long_list=long_list).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert any(w[2] not in (w[0], w[1]) for w in want)  # a chain of two steps


def test_spellings_of_little(spark, docs, nothing, rows):
    assert set(map(tuple, spelling.group_spellings(docs).collect())) == spellings_brute(rows)
    assert spelling.group_spellings(nothing).count() == 0
    with pytest.raises(ValueError):
        spelling.group_spellings(docs, letters=5)


def test_an_edit_spoils_no_more_than_the_bound():
    r = random.Random(1)
    words = {"".join(r.choice("abc") for _ in range(r.randrange(6, 10))) for _ in range(400)}
    held = Counter(g for w in words for m in [f"^{w}$"] for p in range(len(m) - 1) for g in {m[p : p + q] for q in range(2, 6) if p + q <= len(m)})
    frequent = {g for g, n in held.items() if n > 5}
    for w in words:
        own = spelling.grams_of(w, frequent)
        bound = spelling.spoiled_at_most(own)
        assert bound < len(own)
        for other in {w[:i] + c + w[i + d :] for i in range(len(w) + 1) for c in ("", "a", "b") for d in (0, 1)} - {w}:
            if near(w, other) and len(other) >= 6:
                move = len(other) - len(w)
                theirs = spelling.grams_of(other, frequent)
                shared = sum(g in (theirs[p] if p < len(theirs) else None, theirs[p + move] if 0 <= p + move < len(theirs) else None) for p, g in enumerate(own))
                assert shared >= len(own) - bound


def whitening_brute(vectors, most=16):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    own = e > 1e-9 * max(e[0], 1e-9)
    e, v = e[own], v[:, own]
    return n, ((n * x - s) ** 2).sum(1), (n * x - s) / n @ v / np.sqrt(e), e / np.sum(c * c) * n


def vectors_table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, x string, n double").repartition(3)


def check_whitening(spark, vectors):
    n, deviation, white, explained = whitening_brute(vectors)
    got = whitening.whiten(vectors_table(spark, vectors)).collect()
    k = white.shape[1]
    assert len(got) == len(vectors) * k
    mine = np.zeros_like(white)
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-7
    return got


def test_whitening(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((150, 20)) @ np.diag(np.linspace(0.5, 2.0, 20)) * 0.2
    check_whitening(spark, [*base.astype(np.float32).tolist(), *[base[0].astype(np.float32).tolist()] * 200])
    flat = base.copy()
    flat[:, 5:] = flat[:, :1]  # dependent and constant dimensions
    flat[:, 7] = 0.25
    check_whitening(spark, flat.astype(np.float32).tolist())


def test_whitening_of_equal_eigenvalues(spark):
    """No gap tells the components apart: they are some orthonormal ones, and none is missing."""
    vectors = [[0.5 * s if j == i else 0.0 for j in range(6)] for i in range(6) for s in (1, -1)]
    got = whitening.whiten(vectors_table(spark, vectors)).collect()
    assert len(got) == 12 * 6 and {r.component for r in got} == set(range(1, 7))
    white = np.zeros((12, 6))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
        assert r.identity_error < 1e-9 and abs(r.explained - 1 / 6) < 1e-9
    assert np.allclose(white.T @ white / 12, np.eye(6))


def test_whitening_drops_what_is_no_vector(spark):
    good = [[0.1 * i, 0.3, -0.2 * i * i] for i in range(6)]
    odd = [None, [], [None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 2.0], [1.0, 2.0], [1e30, 0.0, 0.0]]
    got = whitening.whiten(vectors_table(spark, [*good, *odd])).collect()
    assert {r.vec_id for r in got} == set(range(6)) and {r.component for r in got} == {1, 2} and {r.n for r in got} == {6}
    none = vectors_table(spark, good)
    assert whitening.whiten(none.limit(0)).count() == 0 and whitening.whiten(none.limit(1)).count() == 0
    assert whitening.whiten(vectors_table(spark, odd[:2])).count() == 0


def test_offsets_beyond_a_long():
    x = np.array([[2**51, 5], [-(2**51), 7]])
    n = 10**9
    want = [[n * int(v) - s for v, s in zip(r, (3, 12))] for r in x]
    assert whitening.scaled_offsets(x, n, [3, 12]).tolist() == want
