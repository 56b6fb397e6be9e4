"""Personal data: spans proposed by patterns, confirmed by checksums, scored by their context.

Map-only: each text is searched whole, in one pass over its batch. A null or empty text has no
spans. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.llm.words import slices

# The base patterns, in leftmost non-overlapping order.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # takes whole digit runs: linear, same matches
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

#: Kinds in their order of report: the base kinds, then those the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

#: Score of a confirmed span without context.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.35}
#: Words that raise the score of a kind when near, and words that lower any score.
SUPPORT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social", "security"),
}
DOUBT = ("example", "version", "isbn", "order", "invoice", "test")
_WORDS = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of an IBAN: letters as numbers, first four signs moved to the end."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and dotted domain: looked for around each @ only.

    The local part is the whole run before the @, as the leftmost match takes it, cut where the
    last match ended.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(digits: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans in order of kind and start, without context."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_octet, m[0].split("."))):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield "iban", m.start(), m.end()
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end()


def spans_of(text: str | None, window: int = 40, least: float = 0.5) -> list[Span]:
    """All spans of a text. Base kinds always stay; added ones need a score of ``least``."""
    found = []
    for kind, start, end in proposed(text or ""):
        near = set(_WORDS.findall(f"{text[max(0, start - window) : start]} {text[end : end + window]}".lower()))
        score = PRIOR[kind] + 0.3 * any(w in near for w in SUPPORT[kind]) - 0.3 * any(w in near for w in DOUBT)
        score = round(min(1.0, max(0.05, score)), 2)
        if kind in BASE_KINDS or score >= least:
            found.append(Span(kind, start, end, score))
    return found


def find_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``spans``, an array of kind, start, end (code
    points, end exclusive) and score, in order of kind and start."""
    key = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in slices(batches, 1):
            found = [[vars(s) for s in spans_of(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {key}, spans array<struct<kind string, start bigint, end bigint, score double>>"
    ).withColumnRenamed("id", id_column)


def masked(text: str | None, least: float = 0.5) -> str | None:
    """The text with each span replaced by its kind in brackets: base kinds whatever their score,
    added ones from a score of ``least``, as in ``spans_of``.

    Overlapping spans count as one, named after the first.
    """
    if text is None:
        return None
    out, done = [], 0
    for s in sorted(spans_of(text, least=least), key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"[{s.kind.upper()}]"]
        done = max(done, s.end)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """``docs`` with spans masked in the text; ``length_column``, if given, is set to the new
    length. All other columns stay; null texts stay null."""

    def masked_batch(texts: pd.Series) -> pd.Series:
        return texts.map(masked, na_action="ignore")

    mask = F.pandas_udf(masked_batch, "string", F.PandasUDFType.SCALAR)
    out = docs.withColumn(text_column, mask(F.col(f"`{text_column}`")))
    return out.withColumn(length_column, F.length(text_column).cast("long")) if length_column else out
