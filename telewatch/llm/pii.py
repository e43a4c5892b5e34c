"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust a score.

Positions are code points, ends exclusive. Kinds in order: `email`, `ip`, `card`, `phone` (the base kinds, decided by their pattern
and check alone), then `iban` (mod 97), `ssn` and `secret`, which are kept from a score of `THRESHOLD` on. A score starts at the kind's
prior, rises when a checksum confirms the match, and rises or falls with words within `NEAR` code points of the match, on both sides: a
hint counts wherever it stands, a doubt after the match only if no hint stands before it.

An `iban` ends where the length of its country says, so words or numbers that follow are not taken in. Of a country that `IBAN_LENGTH`
does not list, every end of a word from 15 to 34 characters is tried, the longest first; where the listed length is not confirmed, the longest
end is tried too.

Each pattern is searched in time linear in the text: a run of digits is tried once, at its first digit, as a match from a later digit
would meet the same end; e-mail addresses are sought from their `@`; an `iban` is sought from its first four characters and reads 34 at most.

Defined cases: a null text is empty and has no spans; rows are independent; further columns are kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telewatch.llm import common as C

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "secret")
THRESHOLD, NEAR = 0.5, 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_TAIL = re.compile(r"(?: ?[A-Z0-9]){11,30}")
_INSIDE = re.compile(r"[A-Za-z0-9]")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[A-Za-z]{2,4}[_-][A-Za-z0-9_-]{20,64}|AKIA[A-Z0-9]{16})(?![A-Za-z0-9])")

PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.6, "iban": 0.3, "ssn": 0.3, "secret": 0.3}
CONFIRMED = {"card": 0.4, "iban": 0.5}  # what a right checksum adds
HINTS = {
    "email": "mail contact write address", "ip": "ip host server address login", "card": "card visa mastercard credit payment pay",
    "phone": "phone call tel mobile fax", "iban": "iban account bank transfer", "ssn": "ssn social security",
    "secret": "token key secret password passwd api bearer credential",
}
DOUBTS = {
    "ip": "version release section", "card": "isbn order serial id", "phone": "isbn", "iban": "serial part", "ssn": "order part serial",
    "secret": "sha sha1 sha256 md5 hash checksum commit digest",
}
# Characters of an account number by country (ISO 13616 registry).
IBAN_LENGTH = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in countries.split()}
_WORDS = re.compile(r"[a-z0-9]+")
_HINTS = {k: frozenset(v.split()) for k, v in HINTS.items()}
_DOUBTS = {k: frozenset(v.split()) for k, v in DOUBTS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The rest of the account number moved before its country and check digits, letters as two digits, is 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1  # what stands before this sign can't reach a later one
        at = text.find("@", free)
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    for head in _IBAN_HEAD.finditer(text):
        start = head.start()
        tail = _IBAN_TAIL.match(text, head.end()) if start >= free else None
        if not tail:
            continue
        ends = {n: i + 1 for n, i in enumerate((i for i in range(*tail.span()) if text[i] != " "), 5)}  # by characters so far
        whole = [n for n in reversed(ends) if n >= 15 and not _INSIDE.match(text, ends[n])]
        length = IBAN_LENGTH.get(text[start:start + 2])
        tried = whole if length is None else [n for n in whole if n == length] + whole[:1]
        free = next((ends[n] for n in tried if mod97(text[start:ends[n]].replace(" ", ""))), free)
        if free > start:
            out.append((start, free))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _spans(pattern: re.Pattern, text: str, right) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if right(m.group())]


FINDERS = {
    "email": emails,
    "ip": lambda t: _spans(_IP, t, lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))),
    "card": lambda t: _spans(_CARD, t, lambda s: 16 <= len(d := _digits(s)) <= 19 and luhn(d)),
    "phone": lambda t: _spans(_PHONE, t, lambda s: 8 <= len(_digits(s)) <= 15),
    "iban": ibans,
    "ssn": lambda t: _spans(_SSN, t, lambda s: True),
    "secret": lambda t: _spans(_SECRET, t, lambda s: any(c.isdigit() for c in s)),
}


def score(text: str, kind: str, start: int, end: int) -> float:
    before, after = (set(_WORDS.findall(t.lower())) for t in (text[max(0, start - NEAR):start], text[end:end + NEAR]))
    hints, doubts = _HINTS[kind], _DOUBTS.get(kind, frozenset())
    value = PRIOR[kind] + CONFIRMED.get(kind, 0.0)
    value += 0.3 * bool((before | after) & hints) - 0.3 * bool(before & doubts or (after & doubts and not before & hints))
    return round(min(max(value, 0.0), 1.0), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans as (kind, start, end, score), by kind and then start."""
    out = []
    for kind, finder in FINDERS.items():
        for a, b in finder(text):
            s = score(text, kind, a, b)
            if kind in BASE or s >= THRESHOLD:
                out.append((kind, a, b, s))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def mask(text: str, spans) -> str:
    """Every maximal run of touching spans becomes one label, that of its first span."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def report(docs: DataFrame) -> DataFrame:
    """Per document the counts of base spans, their checksum, all spans, and the score of each."""
    def run(batch: pa.RecordBatch):
        found = [find(t) for t in C.texts(batch.column(1))]
        base = [[s for s in f if s[0] in BASE] for f in found]
        counts = {f"n_{k}": pa.array([sum(s[0] == k for s in f) for f in base], pa.int64()) for k in BASE}
        return {"doc_id": batch.column(0), **counts, "base_sha256": [hashlib.sha256(_joined(f).encode()).hexdigest() for f in base],
                "spans": [_joined(f) for f in found], "scores": [",".join(f"{s[3]:.2f}" for s in f) for f in found]}

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, scores string"
    return C.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, with every span in `text` masked and `length` counted anew. Null texts stay null."""
    at, count = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None

    def run(batch: pa.RecordBatch):
        old = batch.column(at).to_pylist()
        new = [t if t is None else mask(t, find(t)) for t in old]
        columns = list(batch.columns)
        columns[at] = pa.array(new, pa.string())
        if count is not None:
            was = columns[count].to_pylist()
            columns[count] = pa.array([w if a == b or b is None else len(b) for w, a, b in zip(was, old, new)], columns[count].type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return C.map_batches(docs, run, docs.schema)
