"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.common import prepare

# The base patterns and the order of kinds.
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_/+.@-])[A-Za-z0-9_+-]{20,}+(?![/@])")
DIGIT = re.compile(r"[0-9]")

#: Words that make a kind likelier when they stand within NEAR characters of a span, and words that make it less so.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "account"),
    "phone": ("phone", "call", "tel", "mobile", "contact", "fax"),
    "iban": ("iban", "bank", "account", "transfer", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "tax", "taxpayer"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "authorization", "bearer", "credential", "credentials"),
}
AGAINST = ("version", "isbn", "order", "release", "build", "serial", "commit", "checksum", "digest", "example")
#: Of what the pattern alone finds; a check that holds (Luhn, mod-97, ranges, a random look) adds CHECKED.
PRIOR = {"email": 0.9, "ip": 0.4, "card": 0.3, "phone": 0.5, "iban": 0.2, "ssn": 0.3, "secret": 0.15}
CHECKED = {"ip": 0.2, "card": 0.5, "phone": 0.2, "iban": 0.4, "secret": 0.2}
NEAR = 40
UP, DOWN = 0.25, 0.2
LEAST = 0.5
#: Bits a character that a random string of letters and digits has at least.
RANDOM = 2.9
NEIGHBOUR = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Span:
    """end is exclusive; base: found by a base pattern."""

    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: moved country and check digits, letters as 10 to 35, remainder 1."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int:
    """Where the longest IBAN from start ends: at end, or before a space earlier on (capitals may follow); 0 if none does."""
    while end > start:
        if mod97(text[start:end]):
            return end
        end = text.rfind(" ", start, end)
    return 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans of the base pattern. All starts in front of one @ share its domain, so the earliest one decides."""
    past = 0
    for m in EMAIL_REST.finditer(text):
        at = m.start()
        low = max(past, at - 64)
        while True:  # widen until the local part's start is inside
            head = text[low:at]
            start = low + len(head.rstrip(EMAIL_LOCAL))
            if start > low or low == past:
                break
            low = max(past, at - 4 * (at - low))
        if start < at:
            yield start, m.end()
            past = m.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's rank, end) as sorted tuples: what the base patterns and their checks alone find."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def random_look(word: str) -> bool:
    """Letters and digits mixed as no word has them: the entropy of its characters is high."""
    n = len(word)
    counts = [word.count(c) for c in set(word)]
    return any(c.isdigit() for c in word) and any(c.isalpha() for c in word) and -sum(c / n * math.log2(c / n) for c in counts) >= RANDOM


def score(kind: str, text: str, start: int, end: int) -> float:
    """Prior of the kind, raised by the check that a span has passed and moved by context words within NEAR characters on
    either side."""
    near = {w.lower() for w in NEIGHBOUR.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
    p = PRIOR[kind] + CHECKED.get(kind, 0.0)
    if near & set(CONTEXT[kind]):
        p += UP
    if near & set(AGAINST):
        p -= DOWN
    return min(1.0, max(0.0, p))


def find_pii(text: str | None) -> list[Span]:
    """Every base span, and of the added kinds (IBAN, US social security number, secret) those whose check and score hold: an
    IBAN whose check digits fit goes where a word nearby speaks against it, the other two need a word for them. Base spans
    stay whatever their score."""
    if not text:
        return []
    base = base_spans(text)
    out = [Span(KINDS[k], a, b, score(KINDS[k], text, a, b), True) for a, k, b in base]
    if DIGIT.search(text):
        for m in IBAN.finditer(text):
            end = iban_end(text, *m.span())
            if end and (s := score("iban", text, m.start(), end)) >= LEAST:
                out.append(Span("iban", m.start(), end, s, False))
        for m in SECRET.finditer(text):
            if random_look(m.group()) and (s := score("secret", text, *m.span())) >= LEAST:
                out.append(Span("secret", *m.span(), s, False))
        if "-" in text:
            for m in SSN.finditer(text):
                if (s := score("ssn", text, *m.span())) >= LEAST:
                    out.append(Span("ssn", *m.span(), s, False))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans of every whole text; offsets are code points, ends exclusive.

    Null and empty texts have no spans; each row gives a row, repeated ones too; other columns are ignored; an empty
    table gives an empty result. A pass over the texts, without a shuffle.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [[(s.kind, s.start, s.end, s.score, s.base) for s in find_pii(t)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "spans": spans})

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(scan, SPANS)


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, n_added long, n_spans long"


def pii_digest(docs: DataFrame) -> DataFrame:
    """The counts, joined spans and their scores of pii_spans, made in the same pass. Repeated rows give equal rows."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"].astype("Int64"), b["text"]):
                found = find_pii(t)
                base = [s for s in found if s.base]
                joined = lambda spans: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)
                n = [sum(s.kind == k for s in base) for k in KINDS[:4]]
                rows.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), ",".join(f"{s.score:.2f}" for s in found), len(found) - len(base), len(found)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")]).astype({"doc_id": "Int64"})

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(scan, DIGEST)
