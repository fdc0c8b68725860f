"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes, street words
and identifier cues in one pass over a text, ASCII case aside. A deterministic local
parser expands each anchor to the bounds of an email, phone, address, number or
account and validates it. Spans end where the grammar ends, at no fixed length; every
parser reads each character a bounded number of times, so a very long word costs no
more than other text.

Base kinds follow fixed patterns (leftmost, not overlapping within a kind; a match
that fails its check is dropped and not tried again):

email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
card   [0-9]([ -]?[0-9])+, 12 to 19 digits that pass Luhn
phone  \\+[0-9][ ().0-9-]+[0-9], 9 to 15 digits

Added kinds: ``url`` (an address that names a user), ``address`` (house number,
capitalised names and a street word), ``account`` (an identifier with digits after
a cue such as an account, passport or token, with "is" or "was" between them or not; an
IBAN may be in printed groups behind a cue, and needs none where it is one word; after a
secret's cue and a colon, equals sign, "is" or "was" all up to the next blank or quote,
if it has a digit or capitals inside). Spans are in code points, end exclusive. A null or empty
text, in any row, has none, whatever its doc_id; repeated rows get a row each; an empty
table gives no rows; other columns are not read. A text is held whole by one task, in
about twenty bytes a character.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, texts_of

KINDS = ("email", "ip", "card", "phone", "url", "address", "account")
BASE = KINDS[:4]
# Cue words that the parsers expand from.
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "sip:")
STREETS = ("Street", "Avenue", "Road", "Lane", "Boulevard", "Drive", "Straße", "Calle", "Rue")
CUES = ("account", "acct", "iban", "ssn", "passport", "license", "tax id")
SECRETS = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "api key", "apikey", "bearer")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
URL_END = re.compile(r"[^\s<>\"'`]*+")
USER_IN_URL = re.compile(r"//[^/@]+@|/~[\w.-]+|/(?:users?|profiles?|u)/[\w.-]+", re.I)
AFTER_CUE = tuple(re.compile(p + r"(?:[ \t]++(?:is|was)(?=[ \t:=]))?+[ \t]*+[:=#]?+[ \t]*+[\"']?+", re.I) for p in (r"[ \t_-]*+(?:number|no\.?|nr\.?|id|key)", ""))
STATED = re.compile(r"(?:[:=#]|\b(?:is|was))\Z", re.I)
# An identifier of six characters or more, with the parts that dots, slashes and the like join to it (JWT, base64).
ACCOUNT = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{5,}+(?:[.+/~][A-Za-z0-9_-]++)*+={0,2}+")
SECRET = re.compile(r"[^\s\"'`<>]{6,}+")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ \u00a0\u202f][A-Za-z0-9]{4}(?![A-Za-z0-9])){2,7}+(?:[ \u00a0\u202f][A-Za-z0-9]{1,3}(?![A-Za-z0-9]))?+")
PLAIN_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])")
HOUSE_NUMBER = re.compile(r"[0-9]{1,5}[A-Za-z]?,?\Z")
NAME = re.compile(r"[A-Z][\w.'-]*+")
NAME_AND_NUMBER = re.compile(r" (?:[A-Z][\w.'-]*+ ){0,3}[A-Z][\w.'-]*+,? [0-9]{1,5}\b")


def automaton():
    """Of texts in lower case: anchors by kind and length."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("digit", "0123456789"), ("scheme", SCHEMES), ("street", STREETS), ("cue", CUES), ("secret", SECRETS)):
        for w in words:
            a.add_word(w.lower(), (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(twice[x] for x in d[1::2])) % 10 == 0


def digit_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """ip and card spans, from the runs of digits."""
    out, i, n = [], 0, len(runs)
    dot = [j + 1 < n and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] == "." for j in range(n)]
    while i < n:
        if dot[i] and i + 3 < n and dot[i + 1] and dot[i + 2]:
            parts = [text[a:b].lstrip("0") or "0" for a, b in runs[i : i + 4]]
            if all(len(p) < 4 and int(p) < 256 for p in parts):
                out.append(("ip", runs[i][0], runs[i + 3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < n:
        j = i
        while j + 1 < n and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
        count = sum(b - a for a, b in runs[i : j + 1])
        if 12 <= count <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            out.append(("card", runs[i][0], runs[j][1]))
        i = j + 1
    return out


def is_iban(body: str) -> bool:
    """The mod-97 check."""
    return 15 <= len(body) <= 34 and int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def iban_end(text: str, at: int) -> int | None:
    """The end of the longest IBAN in printed groups that passes the mod-97 check."""
    m = IBAN.match(text, at)
    end = m.end() if m else at
    while end > at:
        if is_iban(re.sub(r"\s", "", text[at:end])):
            return end
        end = max(text.rfind(c, at, end) for c in " \u00a0\u202f")
    return None


def street_start(text: str, at: int) -> int | None:
    """Where a house number and up to four names before a street word begin."""
    end, names = at - 1, 0
    while end > 0 and text[end] == " ":
        start = text.rfind(" ", 0, end) + 1
        tail = max(start, end - 7)
        if names and (m := HOUSE_NUMBER.search(text[tail:end])):
            return tail + m.start()
        if names == 4 or not NAME.fullmatch(text, start, end):
            return None
        end, names = start - 1, names + 1
    return None


def is_secret(value: str) -> bool:
    """A digit, or capitals inside: no plain word."""
    return any(c.isdigit() for c in value) or (any(c.islower() for c in value) and any(c.isupper() for c in value[1:]))


def account_span(text: str, after: re.Match, secret: bool) -> tuple[int, int, bool] | None:
    """(start, end, good) of the identifier behind a cue, if there is any."""
    start = after.end()
    if end := iban_end(text, start):
        return start, end, True
    if secret and STATED.search(after[0].strip(" \t\"'")) and (m := SECRET.match(text, start)):
        body = m[0].rstrip(".,;:!?)]}")
        return start, start + len(body), len(body) > 5 and is_secret(body)
    if m := ACCOUNT.match(text, start):
        return start, m.end(), sum(c.isdigit() for c in m[0]) >= 4
    return None


def find(text: str, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then by kind as listed."""
    out, runs = [], []
    email_end = phone_end = url_end = account_end = digits_end = iban_done = 0
    for last, (kind, size) in anchors.iter(text.encode().lower().decode()):  # of bytes: lower case of ASCII alone
        at = last - size + 1
        if kind == "digit":
            if at >= digits_end:
                digits_end = DIGITS.match(text, at).end()
                runs.append((at, digits_end))
                if at > 1 and digits_end - at > 1 and at - 2 >= iban_done and not (at > 2 and text[at - 3].isalnum()) and (m := PLAIN_IBAN.match(text, at - 2)) and is_iban(m[0]):
                    iban_done = m.end()
                    out.append(("account", *m.span()))
        elif kind == "@":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out.append(("email", start, m.end()))
                email_end = m.end()
        elif kind == "+":
            if at >= phone_end and (m := PHONE.match(text, at)):
                body = m[0].rstrip(" ().-")
                if len(body) > 2:  # a plus, a digit, one of the class at least, and a digit
                    phone_end = at + len(body)
                    if 9 <= sum(c.isdigit() for c in body) <= 15:
                        out.append(("phone", at, phone_end))
        elif at and text[at - 1].isalnum():
            continue
        elif kind == "scheme":
            if at >= url_end:
                end = URL_END.match(text, at).end()
                body = text[at:end].rstrip(".,;:!?)]}")
                url_end = at + len(body)
                if len(body) > size and (body[:7].lower().startswith(("mailto:", "sip:")) and "@" in body or USER_IN_URL.search(body, size - 2)):
                    out.append(("url", at, url_end))
        elif kind == "street":
            if text[at] == text[at].lower():
                continue
            if (start := street_start(text, at)) is not None:
                out.append(("address", start, at + size))
            elif m := NAME_AND_NUMBER.match(text, at + size):
                out.append(("address", at, m.end()))
        else:
            for pattern in AFTER_CUE:
                after = pattern.match(text, last + 1)
                if not after:
                    continue
                if after.end() < account_end:
                    break  # the tail of an identifier that an earlier cue was followed by, and judged whole
                if found := account_span(text, after, kind == "secret"):
                    start, account_end, good = found
                    if good:
                        out.append(("account", start, account_end))
                    break
    return sorted({*out, *digit_spans(text, runs)}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or group of overlapping spans, replaced by [KIND] of its first."""
    parts, at = [], 0
    for k, a, b in spans:
        if a >= at:
            parts += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts by base kind, digest of the base spans and all spans of every document."""

    def run(batches):
        anchors = automaton()
        for b in batches:
            raw, off = texts_of(b.column(1))
            for lo, hi in chunks(off):
                found = [find(raw[off[i] : off[i + 1]].tobytes().decode(), anchors) for i in range(lo, hi)]
                counts = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in BASE]
                base = [hashlib.sha256(joined([s for s in f if s[0] in BASE]).encode()).hexdigest() for f in found]
                yield pa.record_batch([b.column(0).slice(lo, hi - lo).cast(pa.int64()), *counts, pa.array(base, pa.string()), pa.array(map(joined, found), pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; a null text stays null, all rows and other columns stay."""
    place = docs.columns.index("text")

    def run(batches):
        anchors = automaton()
        for b in batches:
            texts = pa.array([None if t is None else redacted(t, find(t, anchors)) for t in b.column(place).to_pylist()], pa.string())
            yield b.set_column(place, "text", texts)

    return docs.mapInArrow(run, docs.schema)
