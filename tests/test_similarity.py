"""Windows swept in one pass against windows scored one by one."""

import random

from proofline.functions import similarity


def every_window(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    m, n = len(a), len(b)
    once = lambda a, b: max(similarity.ratio(a, b[max(0, i) : min(n, i + m)]) for i in range(1 - m, n))
    return max(once(a, b), once(b, a)) if m == n else once(a, b)


def by_table(a, b):
    """The common subsequence from the whole table of prefixes."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_swept_windows_equal_all_windows():
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcé 😀") for _ in range(n))
    pairs = [(text(r.choice([0, 1, 2, 5, 20])), text(r.choice([0, 1, 2, 5, 20, 70]))) for _ in range(500)] + [(text(90), text(130)) for _ in range(5)]
    for a, b in [*pairs, ("ab", "ba"), ("", ""), ("x" * 70, "x" * 70), ("abc", "xxabcx")]:
        assert similarity.window_ratio(a, b) == every_window(a, b) == similarity.window_ratio(b, a)
        assert similarity.common(a, b) == by_table(a, b)
        assert list(similarity.found_by_prefix(a, b)) == [by_table(a, b[:k]) for k in range(1, len(b) + 1)]
