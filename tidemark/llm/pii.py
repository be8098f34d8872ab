"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds, leftmost and non-overlapping per kind, with a fixed yes-or-no check:
email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits).

Scored kinds, added where their score reaches ``THRESHOLD``:

* iban: a country code, two check digits and 11 to 30 letters or digits, in one run or in groups of four, confirmed
  by mod 97; it has its country's length (``IBAN_LENGTH``), and for other codes the longest length that the
  check confirms and a border follows, so what stands behind it is never read as part of it;
* card: an unbroken run of 14 to 19 digits that passes Luhn within a longer failed match;
* phone: what stands before a card in a failed phone match, if it has a phone's digits (a number and a
  card written side by side);
* card: 13 digits that pass Luhn, and phone, national id: bare digit groups; these need a context
  word within ``NEAR`` characters.

Of proposals that overlap, the one with the higher score is added (then the earlier one, then by kind),
and none that overlaps a base span. Positions are code points, end exclusive.

Odd cases: a null text counts as empty; the empty text has no spans; repeated rows are searched
alike; an empty table gives no rows. All patterns take time in proportion to the text: runs are
matched possessively and e-mail addresses are found from their ``@``.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE = KINDS[:4]
THRESHOLD = 0.6
NEAR = 40
#: Context words by kind, and how much one of them adds to the score.
CONTEXT = {
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "national_id": ("ssn", "social security", "passport", "id number", "ausweis", "identité", "identidad"),
}
BONUS = 0.4
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[0-9]++")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: Characters of an account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_GROUPS = re.compile(r"(?<![A-Za-z0-9.+-])[0-9]{3}[-.\x20][0-9]{2,3}[-.\x20][0-9]{4}(?![A-Za-z0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The bank account check: country and check digits moved to the end, letters as 10 to 35."""
    plain = code.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def iban_end(text: str, start: int) -> int | None:
    """Where the account number that starts here ends, if there is one."""
    wanted, ends = IBAN_LENGTH.get(text[start : start + 2]), []
    at = start
    for count in range(1, 35):
        # One blank may stand after each four characters.
        if count > 1 and (count - 1) % 4 == 0 and text[at : at + 1] == " ":
            at += 1
        if text[at : at + 1] not in _IBAN_CHARS:
            break
        at += 1
        border = not (text[at : at + 1].isascii() and text[at : at + 1].isalnum())
        if count >= 15 and border and (wanted is None or count == wanted):
            ends.append(at)
    return next((e for e in reversed(ends) if mod97(text[start:e])), None)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The base spans by start and kind, and the phone matches that failed."""
    found: list[Span] = []
    failed: list[tuple[int, int]] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                end = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # Leading zeros go before a part is read as a number: a run of digits may be very long.
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _digits(m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    found.append(("phone", m.start(), m.end()))
                else:
                    failed.append((m.start(), m.end()))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found, failed


def _context(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - NEAR) : end + NEAR].lower()
    return BONUS if any(w in around for w in CONTEXT.get(kind, ())) else 0.0


def scored_spans(text: str, base: list[Span], failed: list[tuple[int, int]]) -> list[tuple[Span, float]]:
    """Proposals beyond the base, each with its score, before the threshold."""
    out: list[tuple[Span, float]] = []
    if not _DIGIT.search(text):
        return out
    starts = [s for k, s, _ in base if k == "card"]
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 19 and len(_digits(m.group())) > 19:
            for run in _RUN.finditer(m.group()):
                if 14 <= len(run.group()) <= 19 and luhn(run.group()):
                    at = m.start() + run.start()
                    out.append((("card", at, m.start() + run.end()), 0.8))
                    starts.append(at)
    starts.sort()
    for start, end in failed:
        # A phone number run into another span: what stands before that span is tried by itself.
        for at in starts[bisect.bisect_right(starts, start) : bisect.bisect_left(starts, end)]:
            head = text[start:at].rstrip(" ().-")
            if 10 <= len(_digits(head)) <= 15:
                out.append((("phone", start, start + len(head)), 0.7))
                break
    for m in _IBAN.finditer(text):
        end = iban_end(text, m.start())
        if end is not None:
            out.append((("iban", m.start(), end), 0.9))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if len(digits) == 13 and luhn(digits):
            out.append((("card", m.start(), m.end()), 0.3 + _context(text, "card", m.start(), m.end())))
    for m in _GROUPS.finditer(text):
        n = len(_digits(m.group()))
        kind = "national_id" if n == 9 else "phone"
        out.append(((kind, m.start(), m.end()), 0.3 + _context(text, kind, m.start(), m.end())))
    return out


class _Taken:
    """Stretches of a text that spans cover, apart from each other and in order."""

    def __init__(self, found: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in found:
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def add(self, span: Span) -> bool:
        """Takes the span if it is free."""
        _, start, end = span
        at = bisect.bisect_right(self.starts, start)
        if at and self.ends[at - 1] > start or at < len(self.starts) and self.starts[at] < end:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def spans(text: str | None, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and then kind."""
    base, failed = base_spans(text or "")
    held, taken = list(base), _Taken(base)
    # Best score first; the base stays whatever overlaps it.
    for span, score in sorted(scored_spans(text or "", base, failed), key=lambda x: (-x[1], x[0][1], KINDS.index(x[0][0]), x[0][2])):
        if score >= threshold and taken.add(span):
            held.append(span)
    held.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return base, held


def printed(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def redacted(text: str, found: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: counts of base spans, the digest of their list, and all spans."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for key, t in zip(batch.column(0), batch.column(1), strict=True):
                base, held = spans(t.as_py(), threshold)
                row = [key.as_py(), *(sum(k == b for b, _, _ in base) for k in BASE), hashlib.sha256(printed(base).encode()).hexdigest(), printed(held)]
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(search, FOUND)


def redact(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; null texts stay null."""

    @F.pandas_udf("string")
    def clean(column):
        return column.map(lambda t: redacted(t, spans(t, threshold)[1]) if isinstance(t, str) else None)

    return docs.withColumn(text, clean(F.col(text)))
