"""Each operator against a brute-force version on one small table of hard cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofline.llm import blocks, chat, common, decontamination, hashing, near_dups, packing, passages, pii, quality, suffixes, token_counts, token_files, tokens
from tests.llm.conftest import table

BPE = public_tokenizers.path("byte_bpe_50k.json")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return {i: e.ids for (i, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False))}


def test_encoder_equals_library():
    enc = tokens.Encoder(BPE)
    odd = ["", "it's they're we'll I'd 's 'set ''s \"'s\n's  's x  \n y   ", "a  b\t\tc \n\n  ", "日本語 テスト１２ x²³ ½ é́   x", "'", "'l", "'ll", "a'", "x's't 12's　'm", "\x00\x01 \x85\x1c ", "<|endoftext|>a"]
    ids, off = enc.ids(odd)
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(odd))] == [e.ids for e in enc.tok.encode_batch(odd, add_special_tokens=False)]


def test_token_counts(docs, nothing, rows, encoded, tmp_path):
    want = sorted((i, len((t or "").encode()), len(encoded[i]), len(encoded[i]) > 1024) for i, t in rows)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second run finds every content in the cache
        assert sorted(map(tuple, token_counts.count_tokens(docs, BPE, cache=cache).collect())) == want
    assert docs.sparkSession.read.parquet(cache).count() == len({t or "" for _, t in rows})
    assert token_counts.count_tokens(nothing, BPE).count() == 0
    model = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    few = docs.filter("doc_id BETWEEN 3 AND 30")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(few, model).collect()} == {i: len(p.encode(t)) for i, t in rows if 3 <= i <= 30}


def test_token_files(spark, docs, nothing, rows, encoded):
    got = token_files.read_token_files(spark, token_files.write_token_files(docs, BPE, 0)).collect()
    at, want = 0, []
    for i, _ in sorted(rows):
        ids = encoded[i] + [0]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got)) == want
    assert token_files.read_token_files(spark, token_files.write_token_files(nothing, BPE, 0)).count() == 0
    twice = table(spark, [(1, "a b"), (1, "a b"), (None, "c")])
    assert sorted((r.doc_id or -1, r.start) for r in token_files.read_token_files(spark, token_files.write_token_files(twice, BPE, 0)).collect()) == [(-1, 0), (1, 2), (1, 5)]


def test_token_files_by_measured_bytes(spark, tmp_path, monkeypatch):
    """Many files, rows of one id over several of them, and the same numbers by ranged reads."""
    assert token_files.n_parts(0, 8) == 8 and token_files.n_parts(30 << 30, 8) == 480
    assert token_files.n_parts(100 << 40, 8) == 102_400 and token_files.n_parts(1 << 40, 8) == 4096
    monkeypatch.setattr(token_files, "PART", 400)
    rows = [(7, f"text {i:02d} " * (i % 5)) for i in range(60)] + [(None, "no id"), (3, None), (9, "\u00e9 last")]
    folder = token_files.write_token_files(table(spark, rows), BPE, 0)
    parts = token_files.bases(spark, folder).collect()
    assert len(parts) > 3 and sum(p.n_docs for p in parts) == len(rows)
    enc, ids = tokens.Encoder(BPE), []
    for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids.append([*enc.ids([t or ""])[0].tolist(), 0])
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == [(int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for s, x in zip(starts, ids)]
    (tmp_path / "n").write_bytes(np.arange(100, dtype="<u2").tobytes())
    for read in (token_files._mapped(str(tmp_path / "n"), "<u2"), token_files._ranged(pa.OSFile(str(tmp_path / "n")), "<u2")):
        assert read(3, 9).tolist() == [3, 4, 5, 6, 7, 8] and read(97, 100).tolist() == [97, 98, 99] and read(5, 5).tolist() == []


@pytest.mark.parametrize("window", [2048, 256])
def test_packing(docs, nothing, encoded, window):
    got = packing.pack(docs, BPE, end_id=1, window=window).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(encoded)
    for i, ids in encoded.items():
        ids, at = ids + [1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert packing.pack(nothing, BPE).count() == 0


def test_nnls_fills_windows():
    h = np.zeros(128, np.int64)
    h[[31, 95, 63, 127]] = 100, 90, 40, 7
    plan = packing.solve(h)
    used = Counter()
    for combo, n in plan:
        assert sum(combo) == 128
        for k in combo:
            used[k] += n
    assert all(used[k] <= h[k - 1] for k in used) and used[96] == 90 and used[128] == 7


def windows_brute(rows, items, span=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = []
    grams = defaultdict(set)
    for name, t in items:
        w = pattern.findall(lower(t))
        k = min(span, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[i : i + k])].add(name)
    for i, t in rows:
        w, hit, names = pattern.findall(lower(t)), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(w) - k + 1):
                found = grams.get(tuple(w[p : p + k]))
                if found:
                    hit.update(range(p, p + k))
                    names |= {n for n in found if n is not None}
        out.append((i, len(w), len(hit), len(names), sha(",".join(sorted(map(str, names)))), bool(hit)))
    return sorted(out)


def test_decontamination(spark, docs, nothing, rows):
    text = dict(rows)
    item = lambda i, a, b: " ".join(text[i].split()[a:b])
    items = [(7, item(10, 5, 30).upper()), (8, item(20, 100, 112).replace(" ", " - ")), (8, item(20, 100, 112)), (9, item(60, 0, 2)), (10, "one"), (11, None), (12, ""), (13, "-- !"), (None, item(50, 900, 915)), (14, "again and " * 30), (15, item(61, 0, 1) + " nowhere else at all in any text of this table here")]
    b = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, n_words string")
    want = windows_brute(rows, items)
    for bound in (32 << 20, 0):  # in memory, and by a join of fingerprints
        assert sorted(map(tuple, decontamination.report(decontamination.find_contamination(docs, b, bound=bound)).collect())) == want
        assert decontamination.find_contamination(nothing, b, bound=bound).count() == 0
    assert decontamination.find_contamination(docs, b.limit(0)).filter(F.size("spans") > 0).count() == 0


def near_brute(rows, size=3, percent=85):
    sets = {}
    for i, t in rows:
        w = BLANK.findall(lower(t))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    names = sorted(sets)
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                comp[rb] = ra
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_dups(docs, nothing, rows, rounds):
    assert sorted(map(tuple, near_dups.link(docs, rounds=rounds).collect())) == near_brute(rows)
    assert near_dups.link(nothing).count() == 0


def test_chunks_follow_the_similarity():
    assert near_dups.scheme(85) == (10, 5)
    for percent in range(20, 101):
        assert near_dups.miss_chance(min(percent, 99) / 100, *near_dups.scheme(percent)) <= near_dups.MISS


def test_near_dups_at_half_similarity(spark):
    """Eighty pairs of similarity just over 0.5; ten chunks of five lose one in eight."""
    rows = []
    for i in range(80):
        w = [f"w{i}x{k}" for k in range(120)]
        rows += [(2 * i, " ".join(w[:91])), (2 * i + 1, " ".join(w[29:]))]
    got = near_dups.link(table(spark, rows), percent=50).collect()
    assert sorted(map(tuple, got)) == near_brute(rows, percent=50) and sum(r.kept for r in got) == 80


def test_near_dups_family_without_a_centre(spark):
    """A chain: each text near the next only; one hot group of far copies besides."""
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(14):
        rows.append((i, " ".join(base)))
        base[(7 * i) % 118] = f"new{i}"
    for i in range(120):
        w = [f"v{k}" for k in range(120)]
        for k in r.integers(0, 120, 6):
            w[k] = f"u{i}x{k}"
        rows.append((100 + i, " ".join(w)))
    assert sorted(map(tuple, near_dups.link(table(spark, rows)).collect())) == near_brute(rows)


def test_repeated_and_null_ids_in_near_dups(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = near_dups.link(table(spark, [(5, text), (5, text), (None, text), (None, None), (3, text + " x")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, 3, False), (3, 3, True), (5, 3, False), (5, 3, False)]


def test_difference_covers():
    for v, d in suffixes.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def bytes_brute(rows, size):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[p : p + size] for _, b in raw for p in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if count[b[p : p + size]] > 1:
                gone[p : p + size] = True
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    return sorted(out, key=lambda r: (r[0] is None, r))


def test_keys_that_clash(spark, tmp_path):
    """Unlike content under one 64-bit key: checks tell it apart, within a block and between blocks."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        keys, checks = rng.integers(0, 4, 12).astype(np.uint64), rng.integers(0, 4, 12).astype(np.uint32)
        order, new = hashing.grouped(keys, checks)
        pairs = list(zip(keys.tolist(), checks.tolist()))
        assert [pairs[i] for i in order] == sorted(pairs) and new.sum() == len(set(pairs))
        assert hashing.numbers(order, new).tolist() == [sorted(set(pairs)).index(p) for p in pairs]
    high = 2**63 + 5
    held = {0: ([3, 3, high], [1, 2, 9], [10, 11, 12]), 1: ([3, high, high], [2, 8, 9], [4, 5, 6]), 2: ([7], [1], [1])}
    empty = np.zeros(0, np.int64).tobytes()
    table = spark.createDataFrame([(b << 32, empty, empty, b"") for b in held], blocks.TYPE)

    def keys_of(owned):
        def of(block):
            k, c, o = held[block.block >> 32]
            return np.array(k, np.uint64), np.array(c, np.uint32), np.array(o, np.int64) if owned else None

        return of

    sizes = blocks.Sizes(1 << 20, 3, 4)
    for owned, want in ((False, [[0, 1, 1], [1, 0, 1], [0]]), (True, [[0, 1, 1], [0, 0, 0], [0]])):
        where = f"file://{tmp_path}/{owned}"
        blocks.exchange(table, where, keys_of(owned), sizes)
        assert [blocks.answers(where, b << 32, len(held[b][0])).astype(int).tolist() for b in held] == want
    text = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 9, np.uint8)
    one, two = (hashing.byte_windows(text, 30, seed=s) for s in (0, 1))
    assert len(set(one)) == len(set(two)) == 26 and not set(one) & set(two)


def test_suffix_dedup(spark, docs, nothing, rows):
    assert sorted(map(tuple, suffixes.dedup_substrings(docs).drop("ranges").collect())) == bytes_brute(rows, 200)
    assert suffixes.dedup_substrings(nothing).count() == 0
    line = "a line that two texts share, of more than two hundred bytes in all; " * 4
    more = [(1, line), (1, line), (None, "x" + line), (4, line[1:] + "é"), (5, line[:199])]
    got = sorted(map(tuple, suffixes.dedup_substrings(table(spark, more)).drop("ranges").collect()), key=lambda r: (r[0] is None, r))
    assert got == bytes_brute(more, 200)


@pytest.mark.parametrize("order", ["A0", "A0A", "0A00A0", "00", "B0A0A", "A00"])
def test_suffix_dedup_of_a_block_with_empty_texts(spark, monkeypatch, order):
    """Empty texts at the end of a block, and between two texts removed up to their bound."""
    line = "a line that two texts share, of more than two hundred bytes in all; " * 4
    texts = [{"A": line, "B": "short", "0": ""}[c] for c in order]
    bounds = np.cumsum([0, *map(len, texts)]).astype(np.int64)
    block = (0, np.arange(len(texts)).tobytes(), bounds.tobytes(), "".join(texts).encode())
    monkeypatch.setattr(suffixes, "make_blocks", lambda docs, where, sizes: spark.createDataFrame([block], "block bigint, docs binary, bounds binary, data binary"))
    got = suffixes.dedup_substrings(table(spark, [])).drop("ranges").collect()
    assert sorted(map(tuple, got)) == bytes_brute(list(enumerate(texts)), 200)


def passages_brute(rows, size):
    docs = [(i, BLANK.findall(t or "")) for i, t in rows]
    owner = {}
    for i, w in docs:
        for p in range(len(w) - size + 1):
            g = tuple(w[p : p + size])
            owner[g] = min(i, owner.get(g, i))
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - size + 1):
            if owner[tuple(w[p : p + size])] < i:
                gone.update(range(p, p + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return sorted(out)


@pytest.mark.parametrize("size", [50, 7])
def test_passages(docs, nothing, rows, size):
    assert sorted(map(tuple, passages.dedup_passages(docs, size).drop("ranges").collect())) == passages_brute(rows, size)
    assert passages.dedup_passages(nothing, size).count() == 0


def quality_brute(t):
    w = BLANK.findall(t or "")
    lines = [x for x in (t or "").split("\n") if BLANK.search(x)]
    def cover(k):
        c = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return {p for i in range(len(w) - k + 1) if c[tuple(w[i : i + k])] > 1 for p in range(i, i + k)}
    longest = 0
    while longest < len(w) and cover(longest + 1):
        longest += 1
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover(3)), len(cover(8)), longest


def test_quality(docs, nothing, rows):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, t in rows:
        if i == 50:
            continue  # too long for the brute force of the longest repeat
        n, chars, symbols, dup, three, eight, longest = quality_brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered, r.longest_repeat) == (n, chars, symbols, dup, three, eight, longest), i
        assert r.base_failed == (n < 50 or 100 * three > 50 * n)
        assert r.kept == (not r.base_failed and 100 * eight <= 40 * n and not (longest >= 8 and 100 * longest > 30 * n))
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {i for i, r in got.items() if r.kept} and 52 not in kept and 60 + 24 in got
    assert quality.quality(nothing).count() == 0 and quality.keep_good(nothing).columns == nothing.columns


def pii_brute(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, p in patterns.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii(spark, docs, nothing, rows):
    import random

    r = random.Random(1)
    more = [(1000 + i, "".join(r.choice("a1.@+- (9b5%é\n0") for _ in range(50))) for i in range(400)] + [(2000 + i, "".join(r.choice("0123456789 -.+") for _ in range(60))) for i in range(400)]
    both = docs.unionByName(table(spark, more))
    got = {x.doc_id: x for x in pii.find_pii(both).collect()}
    for i, t in rows + more:
        base = pii_brute(t)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.BASE)
        assert got[i].base_sha256 == sha(pii.joined(base)) and set(pii.joined(base).split(",")) <= {*got[i].spans.split(","), ""}
    assert "account:" in got[53].spans
    clean = {x.doc_id: x.text for x in pii.redact(docs).collect()}
    assert "a.b@c" not in clean[53] and "[EMAIL]" in clean[53] and "4111" not in clean[53] and clean[0] is None and clean[60] == dict(rows)[60]
    assert pii.find_pii(nothing).count() == 0 and pii.redact(nothing).columns == nothing.columns


def test_pii_reads_identifiers_and_urls_to_their_end():
    import time

    anchors = pii.automaton()
    spans = lambda t, k: [t[a:b] for kind, a, b in pii.find(t, anchors) if kind == k]
    jwt = ".".join(["eyJhbGciOiJIUzI1NiJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIn0" * 9, "dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"])
    for n in (64, 65, 100, 300, 5000):
        assert spans(f"token: {'a1b2' * n}"[: 7 + n] + " end", "account") == [("a1b2" * n)[:n]]
    assert spans(f'access_token = "{jwt}", x', "account") == [jwt] and spans("client_secret: ab12cd34ef.", "account") == ["ab12cd34ef"]
    assert spans("secret: abcd12/cd34+ef56gh==\n", "account") == ["abcd12/cd34+ef56gh=="]
    assert spans("token secret_key: 12345678", "account") == ["12345678"]
    for iban in ("DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32"):
        assert spans(f"IBAN: {iban} then on", "account") == [iban]
    assert spans("IBAN: DE89 3704 0044 0532 0130 01 x", "account") == []
    assert spans("PassWord=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY now", "account") == ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]
    assert spans("secret: hunter2!x, then", "account") == ["hunter2!x"] and spans("password: please keep it", "account") == []
    assert spans("ACCOUNT" + " " * 100 + "id 1234567890123456789012345", "account") == ["1234567890123456789012345"]
    assert spans(f"password: {'k3' * 40} on", "account") == ["k3" * 40]
    names = "Al" + "o" * 300
    assert spans(f"at 12 {names} Van Street, or Rue {names} 7 b", "address") == [f"12 {names} Van Street", f"Rue {names} 7"]
    assert spans("HTTPS://user:pw@host.example/x", "url") == ["HTTPS://user:pw@host.example/x"]
    long = "https://bob@example.org/" + "a/b?c=" * 170_000
    assert pii.redacted(f"x {long} y", pii.find(f"x {long} y", anchors)) == "x [URL] y"
    url = "https://example.org/users/" + "long" * 2000 + "/end"
    assert spans(f"see {url}, or", "url") == [url]
    for hard in ("Street " * 40_000, "Street" * 40_000, "9 " + "Aa" * 100_000 + " Street" * 9, "7" * 300_000, "1." * 100_000, "token_" * 40_000 + "12345", "token:" + "token_" * 40_000, "token " + " " * 200_000, "token1a.tokenab" * 20_000, "http://" * 30_000):
        t = time.process_time()
        pii.find(hard, anchors)
        assert time.process_time() - t < 5


def thue_morse(n, zero, one):
    """The word of n letters and its complement: sums of powers of any base, modulo a power of two, are one and the same."""
    a, b = [zero], [one]
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_fingerprints_of_structured_texts(spark):
    """Complementary words of letters as words, lines and texts: nothing is shared, nothing is found."""
    a, b = ("".join(x) for x in thue_morse(2048, "a", "b"))
    wa, wb = (" ".join(x) for x in thue_morse(1024, "ab", "ba"))
    fill = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a), (2, b), (3, wa), (4, wb), (5, f"{fill}\n{a}\n{b}"), (6, f"{a} {fill}"), (7, f"{b} {fill} x"), (8, f"{a} {b} " * 3)]
    docs = table(spark, rows)
    assert sorted(map(tuple, near_dups.link(docs).collect())) == near_brute(rows)
    assert sorted(map(tuple, suffixes.dedup_substrings(docs).drop("ranges").collect())) == bytes_brute(rows, 200)
    assert sorted(map(tuple, passages.dedup_passages(docs, 50).drop("ranges").collect())) == passages_brute(rows, 50)
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert got[5].n_dup_lines == 0 and all((got[i].n_repeat_words, got[i].n_covered) == quality_brute(t)[4:6] for i, t in rows)
    enc = tokens.Encoder(BPE)
    ids, off = enc.ids([t for _, t in rows])
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(rows))] == [e.ids for e in enc.tok.encode_batch([t for _, t in rows], add_special_tokens=False)]


def test_hot_keys_are_joined_apart(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    named = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(map(tuple, rows.join(named, "k").collect()))
    assert sorted(map(tuple, common.by_key(rows, named, "k").collect())) == want and common.hot_keys(rows, "k") == [7]
    assert common.by_key(rows.limit(0), named, "k").count() == 0


def test_pii_cues_with_words_between_and_bare_ibans():
    anchors = pii.automaton()
    spans = lambda t: [t[a:b] for kind, a, b in pii.find(t, anchors) if kind == "account"]
    for t, want in (
        ("my ssn is 123-45-6789", "123-45-6789"), ("api-key: 9f8e7d6c5b4a", "9f8e7d6c5b4a"), ("pwd=Hunter22", "Hunter22"), ("password is Hunter2!x", "Hunter2!x"),
        ("Authorization: Bearer abcDEF123456789xyz", "abcDEF123456789xyz"), ("pay DE89370400440532013000 now", "DE89370400440532013000"), ("iban DE89370400440532013000", "DE89370400440532013000"),
    ):
        assert spans(t) == [want], t
    for t in ("the password is required", "his account was closed in spring", "pay DE89370400440532013001 now", "XDE89370400440532013000", "the bearer of this letter", "the secret is out, said they", "a token island 12"):
        assert spans(t) == [], t


def test_chat_parts_are_read_back(spark):
    part = lambda kind, text=None, ref=None, units=None: {"type": kind, "text": text, "ref": ref, "units": units}
    cases = {
        1: [part("text", "~3image:0~4 and <|im_end|>~"), part("image", ref="a.png", units=2), part("text", "b~4"), part("audio", ref="c.wav"), part("document")],
        2: [part("image", ref="only.png")],
        3: [],
    }
    rows = [(i, 1, "user", ps) for i, ps in cases.items()] + [(1, 2, "user", [part("text", "x"), part("image", ref="second.png")])]
    made = chat.format_chats(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>"))
    got = {r.conv_id: [[(p.type, p.text, p.ref) for p in turn] for turn in r.parts] for r in chat.read_chats(made).collect()}
    want = lambda ps: [(p["type"], p["text"] or "", p["ref"]) for p in ps]
    assert got == {1: [want(cases[1]), [("text", "x", None), ("image", "", "second.png")]], 2: [want(cases[2])], 3: [[]]}


def test_chat(spark):
    own = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", own), (1, 1, "assistant", own), (2, 1, "assistant", "~1 é ~~"), (2, 0, "us\ner<|", None), (2, 2, "assistant", "a\nb<"), (3, 0, None, "only"), (None, 0, "user", "q"), (4, 0, "user", "x"), (4, 0, "user", "x")]
    df = spark.createDataFrame([(*t, "s") for t in turns], "conv_id bigint, turn bigint, role string, text string, segment string")
    made = chat.format_chats(df)
    read = {r.conv_id: r for r in chat.read_chats(made).collect()}
    assert [(t.role, t.text) for t in read[2].turns] == [("us\ner<|", ""), ("assistant", "~1 é ~~"), ("assistant", "a\nb<")]
    assert read[2].loss_texts == ["~1 é ~~", "a\nb<"] and read[1].loss_texts == [own] and len(read[4].turns) == 2 and len(read[None].turns) == 1
    rep = {r.conv_id: r for r in chat.report(made).collect()}
    assert rep[1].turns_sha256 == sha(f"user\n{own}\nassistant\n{own}\n") and rep[1].loss_chars == len(own) and rep[3].loss_sha256 == sha("")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_parts(spark):
    part = chat.PART
    rows = [(1, 0, "user", [("text", "look ~3image:1~4 ", None, None), ("image", None, "s3://i.png", 3), ("audio", None, "a.wav", 10), ("scan", "t", "d.pdf", None)]), (1, 1, "assistant", [("text", "ok", None, None)]), (2, 0, "user", None)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{part}>")).collect()}
    assert "~3image:1~4~3audio:2~4~3document:3~4" in got[1].formatted and "look ~03image:1~04 " in got[1].formatted
    assert [(a.kind, a.ref, a.tokens) for a in got[1].attachments] == [("image", "s3://i.png", 768), ("audio", "a.wav", 250), ("document", "d.pdf", 512)]
    assert got[1].attachment_tokens == 768 + 250 + 512 and got[2].attachments == []


def test_shared_keys_bring_the_sizes(spark):
    """Each row has its class's size and the hub's, over batches of two rows; so no pair is joined with sizes. Keys without sizes go as before."""
    rows = [(k, c, 100 * c + k) for k in range(12) for c in range(k, k + k % 5 + 1)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        keys = spark.createDataFrame(rows, "key bigint, cid bigint, n_cid bigint")
        got = sorted(map(tuple, near_dups.shared_keys(keys).collect()))
        bare = sorted(map(tuple, near_dups.shared_keys(keys.drop("n_cid")).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = [(k, c, k, n, 101 * k) for k, c, n in rows if k % 5]
    assert got == want and bare == [w[:3] for w in want]
