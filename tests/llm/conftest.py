import random

import pytest

CLASH = ("text_hash", "digest", "ids", "key", "cid", "spans", "block", "near", "n_tokens", "part", "rank", "n", "kept", "gone", "row", "sig", "comp")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, *("x" for _ in CLASH)) for i, t in rows], SCHEMA)


def sample_rows():
    """Nulls, empty and blank texts, one very long text, copies, near copies, repeats."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghé") for _ in range(r.randrange(2, 8))) for _ in range(900)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, base = words(70), words(160)
    rows = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "two words"), (5, "One")]
    rows += [(10 + i, " ".join(words(60) + passage + words(40))) for i in range(5)]
    rows += [(20, " ".join(base)), (21, " ".join(base)), (22, "  ".join(base).upper())]
    for i in range(12):
        w = list(base)
        for _ in range(i + 1):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((30 + i, " ".join(w)))
    rows.append((50, " ".join(words(30_000))))
    rows.append((51, "x" * 60_000))
    rows.append((52, ("the same line again and again here\n" * 40)))
    rows.append((53, "Mail a.b@c.example.com, 10.0.0.1, 4111 1111 1111 1111, +44 20 7946 0958; token = \"ab12cd34ef56\" " + " ".join(words(60))))
    rows.append((54, "<|endoftext|> it's 'set 12's  <|im_end|> " + " ".join(words(80))))
    rows += [(60 + i, " ".join(words(r.randrange(3, 400)))) for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])
