"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Each kind has a pattern, a prior score, a check (Luhn, mod 97, octet range, digit counts) and
words that raise the score when they stand just before or just after the span. The base kinds
(email, ip, card, phone) are kept whenever their check passes; the other kinds are kept at a score
of 0.5 or more.
Patterns never backtrack over long runs, so a text costs time in proportion to its length.

Kinds beyond the base: ``iban`` (mod 97 must hold), ``ssn`` (three, two and four digits; needs a
context word), ``secret`` (access keys, and what follows ``password=`` and the like; without a digit
it needs a context word).

Defined cases: null is the empty text and has no spans; positions count code points; spans of
different kinds may overlap; redaction replaces each run of overlapping spans by the marker of
its first kind; a very long text is scanned whole; repeated rows give repeated results; further
columns stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
THRESHOLD = 0.5
#: Context words are looked for in so many characters before and after a span.
CONTEXT, AFTER = 40, 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:password|passwd|secret|token|api[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{8,}+)")
_DIGIT = re.compile("[0-9]")
_WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "payment", "credit"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "secret": ("key", "credential", "secret", "login"),
}
_CONTEXT = {k: re.compile(r"\b(?:" + "|".join(v) + r")", re.I) for k, v in _WORDS.items()}
_PRIOR = {"email": 0.6, "ip": 0.5, "card": 0.3, "phone": 0.5, "iban": 0.2, "ssn": 0.3, "secret": 0.6, "phrase": 0.3}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from each @ so that long runs cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _iban_ends(found: str) -> int | None:
    """The longest prefix of a proposed span that is an IBAN (words may follow it)."""
    cuts = [len(found)] + [i for i in range(len(found) - 1, 14, -1) if found[i] == " "]
    return next((n for n in cuts if 15 <= len(x := found[:n].replace(" ", "")) <= 34 and mod97(x)), None)


def _proposed(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, checksum held): the spans whose check does not fail."""
    for start, end in _emails(text):
        yield "email", start, end, False
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                yield "ip", *m.span(), True
        for m in _CARD.finditer(text):
            if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                yield "card", *m.span(), True
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    yield "phone", *m.span(), False
        for m in _IBAN.finditer(text):
            if n := _iban_ends(m[0]):
                yield "iban", m.start(), m.start() + n, True
        for m in _SSN.finditer(text):
            yield "ssn", *m.span(), False
    for m in _SECRET.finditer(text):
        if m[1] is None:
            yield "secret", *m.span(), True
        else:
            yield "secret" if _DIGIT.search(m[1]) else "phrase", *m.span(1), False


def find(text: str) -> list[Span]:
    """All kept spans, by start and then by kind as listed in ``KINDS``."""
    out = []
    for proposed, start, end, confirmed in _proposed(text):
        kind = "secret" if proposed == "phrase" else proposed
        near = _CONTEXT[kind].search(text, max(0, start - CONTEXT), start) or _CONTEXT[kind].search(text, end, end + AFTER)
        score = min(1.0, _PRIOR[proposed] + 0.5 * confirmed + 0.3 * bool(near))
        if kind in BASE or score >= THRESHOLD:
            out.append(Span(kind, start, end, round(score, 2)))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans: an array of (kind, start, end, score)."""

    def run(batches):
        for b in batches:
            found = [[s._asdict() for s in find(t)] if t else [] for t in b.column("text").to_pylist()]
            yield batch(doc_id=b.column("doc_id"), spans=pa.array(found, _SPAN_TYPE))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, spans {_SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with each personal span in ``text`` replaced by its kind's marker."""

    def run(batches):
        for b in batches:
            texts = [redacted(t, find(t)) if t else t for t in b.column("text").to_pylist()]
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return map_arrow(docs, run, docs.schema)



def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(line(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
