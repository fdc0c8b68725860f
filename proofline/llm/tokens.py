"""Exact token ids of whole texts, with a bounded memory of pre-tokens.

A byte-level BPE file of the tokenizers library cuts a text into pre-tokens and
encodes each by itself, so the ids of a pre-token can be kept. The cuts are found
for a whole batch with numpy, the library encodes only pre-tokens that the worker
has not met. Texts that hold an added token's string, and files of another
pre-tokenizer, go through the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pandas as pd

from .hashing import ranges

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255


def file_digest(path: str) -> str:
    """SHA-256 of a tokenizer file: its version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Encoder:
    """``ids(texts)``: flat int32 ids of a list of texts, and n+1 offsets."""

    #: Pre-tokens kept by a worker; at the bound the memory starts anew.
    KEEP = 1_500_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.split = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None and spec["model"]["type"] == "BPE"
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.vocab = self.tok.get_vocab_size()
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0  # sorted fingerprints, their entries
        self.pool, self.at, self.len = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0

    def _probe(self, points: np.ndarray) -> None:
        """Ask the library's own pre-tokenizer what kind each new character is."""
        one = lambda s: len(self.tok.pre_tokenizer.pre_tokenize_str(s)) == 1
        for p in points.tolist():
            c = chr(p)
            if one("a" + c):
                self.kind[p] = LETTER
            elif one("1" + c):
                self.kind[p] = NUMBER
            elif one("!" + c):
                self.kind[p] = OTHER
            else:
                self.kind[p] = SPACE

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, t in enumerate(texts) if not self.split or any(a in t for a in self.added)]
        if not whole:
            return self._split(texts)
        rest = set(whole)
        mine, off = self._split([t for i, t in enumerate(texts) if i not in rest])
        byhand = iter([np.asarray(e.ids, np.int32) for e in self.tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)])
        parts, k = [], 0
        for i in range(len(texts)):
            if i in rest:
                parts.append(next(byhand))
            else:
                parts.append(mine[off[k] : off[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _starts(self, cps: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the library's pattern begins a pre-token; ``first``: text starts."""
        prev = np.concatenate([[OTHER], kind[:-1]])
        nxt = np.concatenate([kind[1:], [SPACE]])
        last = np.concatenate([first[1:], [True]])  # last character of a text
        space = kind == SPACE
        after_blank = np.concatenate([[False], cps[:-1] == 32]) & ~first
        start = np.where(space, (prev != SPACE) | ((nxt != SPACE) & ~last), ~after_blank & (prev != kind)) | first
        quote = np.flatnonzero((cps == 39) & start & ~(after_blank))
        if len(quote):
            pad = np.concatenate([cps, np.zeros(3, cps.dtype)])
            begin = np.concatenate([first, np.ones(3, bool)])
            a, b = pad[quote + 1], pad[quote + 2]
            inside1, inside2 = ~begin[quote + 1], ~begin[quote + 1] & ~begin[quote + 2]
            one = inside1 & np.isin(a, [ord(c) for c in "stmd"])
            two = inside2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            start = np.concatenate([start, np.ones(3, bool)])
            start[quote[one | two] + 1] = False
            start[quote[two] + 2] = False
            start[quote[one] + 2] = True
            start[quote[two] + 3] = True
            start = start[: len(cps)]
        return start

    def _split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n_chars = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(n_chars)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        joined = "".join(texts)
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind[cps]
        if (kind == UNKNOWN).any():
            self._probe(np.unique(cps[kind == UNKNOWN]))
            kind = self.kind[cps]
        first = np.zeros(len(cps), bool)
        first[(ends - n_chars)[n_chars > 0]] = True
        s = np.flatnonzero(self._starts(cps, kind, first))
        e = np.append(s[1:], len(cps))
        h = ranges(cps.view(np.uint8), 4 * s, 4 * e)
        inverse, keys = pd.factorize(h)  # a hash table: no sort
        where = np.empty(len(keys), np.int64)
        where[inverse[::-1]] = np.arange(len(h) - 1, -1, -1)
        if self.n + len(where) > self.KEEP and self.n:
            self._forget()
        order = np.argsort(keys)
        keys, where, back = keys[order], where[order], np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        near = np.searchsorted(self.keys, keys)
        idx = np.full(len(keys), -1, np.int64)
        if self.n:
            hit = self.keys[np.minimum(near, self.n - 1)] == keys
            idx[hit] = self.place[near[hit]]
        new = np.flatnonzero(idx < 0)
        if len(new):
            words = [joined[a:b] for a, b in zip(s[where[new]].tolist(), e[where[new]].tolist())]
            plain = (cps[s[where[new]]] == 32) & (kind[e[where[new]] - 1] == LETTER)
            n = self.n
            for lo in range(0, len(words), 4096):
                flat, size = self._encode(words[lo : lo + 4096], plain[lo : lo + 4096])
                self._grow(n + len(size), self.used + len(flat))
                self.at[n : n + len(size)] = self.used + np.cumsum(size) - size
                self.len[n : n + len(size)] = size
                self.pool[self.used : self.used + len(flat)] = flat
                self.used += len(flat)
                idx[new[lo : lo + 4096]] = np.arange(n, n + len(size))
                n += len(size)
            self.keys, self.place, self.n = np.insert(self.keys, near[new], keys[new]), np.insert(self.place, near[new], idx[new]), n
        of = idx[back[inverse]]
        size = self.len[of].astype(np.int64)
        done = np.cumsum(size)
        ids = self.pool[np.arange(done[-1]) + np.repeat(self.at[of] - (done - size), size)]
        before = np.concatenate([[0], done])
        return ids, before[np.searchsorted(s, np.concatenate([[0], ends]))]

    def _encode(self, words: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of pre-tokens. Those of one blank and letters (``plain``)
        stay apart when they stand side by side, so they go to the library as one text."""
        got: list = [None] * len(words)
        joint = np.flatnonzero(plain).tolist()
        if joint:
            e = self.tok.encode("".join(words[i] for i in joint), add_special_tokens=False)
            ids, word = np.asarray(e.ids, np.int32), np.asarray(e.word_ids, np.int64)
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1, [len(ids)]])
            if len(bounds) == len(joint) + 1:
                for i, a, b in zip(joint, bounds[:-1].tolist(), bounds[1:].tolist()):
                    got[i] = ids[a:b]
        rest = [i for i, g in enumerate(got) if g is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            got[i] = np.asarray(e.ids, np.int32)
        return np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))

    def _grow(self, entries: int, ids: int) -> None:
        if entries > len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros(max(len(x), entries), x.dtype)]) for x in (self.at, self.len))
        if ids > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), ids), np.int32)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Pieces:
    """Counts by sentencepiece, for .model files."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> np.ndarray:
        return np.fromiter((len(x) for x in self.model.encode(texts, num_threads=1)), np.int64, len(texts))


def counter(path: str):
    """``counts(texts)`` of either library, chosen by the file's ending."""
    if path.endswith(".model"):
        if path not in _encoders:
            _encoders[path] = Pieces(path)
        return _encoders[path].counts
    enc = encoder(path)
    return lambda texts: np.diff(enc.ids(texts)[1])
