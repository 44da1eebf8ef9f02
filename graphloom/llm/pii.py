"""Personal data: expressions propose spans, checksums confirm them, words nearby move their scores.

The base kinds (email, ip, card, phone) are decided by their patterns and checks alone: their scores tell how sure they
are, and they stay whatever the score. The further kinds (iban by mod 97, national_id and key by their shape) begin
with a score of their own, words nearby that belong to the kind raise it, words that speak of something else (an order
or a part number, an example) lower it, and a span is kept from one half on.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])[0-9A-Za-z_-]{24,}(?![A-Za-z0-9])")
#: kind: (pattern, score by itself, words nearby that raise it, by what)
MORE = {
    "iban": (_IBAN, 0.6, re.compile(r"iban|account|konto|compte|cuenta|bank", re.I), 0.3),
    "national_id": (_NATIONAL, 0.3, re.compile(r"ssn|social|security|insurance|identity", re.I), 0.5),
    "key": (_KEY, 0.2, re.compile(r"token|secret|api[_-]?key|password|passwd", re.I), 0.5),
}
#: The same of the base kinds, without the patterns.
_BASE_SCORES = {
    "email": (0.9, re.compile(r"mail|contact|write to|@", re.I), 0.1),
    "ip": (0.6, re.compile(r"\bip\b|address|host|server|login", re.I), 0.3),
    "card": (0.7, re.compile(r"card|visa|master|credit|debit|karte", re.I), 0.3),
    "phone": (0.6, re.compile(r"phone|tel\b|mobile|call|fax", re.I), 0.3),
}
#: Words nearby that lower the score of any kind, and by what.
ELSE, LESS = re.compile(r"example|sample|dummy|version|order (no|number)|part (no|number)|serial|isbn|checksum", re.I), 0.3
#: Characters before and after a span in which words count.
NEARBY = 40


def luhn(digits: str) -> bool:
    doubled = (int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    turned = compact[4:] + compact[:4]
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches, found from each @ leftwards: characters before it that fit all belong to the match."""
    found, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, past := m.end()))
            at = text.find("@", past)
        else:
            at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed in BASE, then by start."""
    found = _emails(text) if "@" in text else []
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def _score(text: str, start: int, end: int, alone: float, words: re.Pattern, more: float) -> float:
    """The score of a span, between 0 and 1, with the words around it; the span's own characters are no context."""
    before, after = text[max(0, start - NEARBY) : start], text[end : end + NEARBY]
    score = alone + (more if words.search(before) or words.search(after) else 0.0)
    return round(min(1.0, max(0.0, score - (LESS if ELSE.search(before) or ELSE.search(after) else 0.0))), 6)


def all_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score): the base spans, then the further kinds in the order of MORE, by start. A further span that overlaps a base span goes."""
    base = base_spans(text)
    found = [(*s, _score(text, s[1], s[2], *_BASE_SCORES[s[0]])) for s in base]
    for kind, (pattern, alone, words, more) in MORE.items():
        for m in pattern.finditer(text):
            s, e = m.span()
            if any(s < b[2] and b[1] < e for b in base) or kind == "iban" and not mod97(m[0]):
                continue
            if kind == "key" and not any(c.isdigit() for c in m[0]):
                continue
            if (score := _score(text, s, e, alone, words, more)) >= 0.5:
                found.append((kind, s, e, score))
    return found


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores array<double>"


def _find(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        spans = all_spans(text or "")
        base = [s for s in spans if s[0] in BASE]
        kinds = [s[0] for s in base]
        rows.append({f"n_{k}": kinds.count(k) for k in BASE} | {"base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(spans), "scores": [s[3] for s in spans]})
    return pa.array(rows, pa.struct([*((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("scores", pa.list_(pa.float64()))]))


def _redact(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        if text is None:
            out.append(None)
            continue
        parts, at = [], 0
        for kind, start, end, _ in sorted(all_spans(text), key=lambda s: (s[1], -s[2])):
            if end <= at:
                continue
            parts += [text[at : max(start, at)], f"[{kind}]"]
            at = end
        out.append("".join(parts) + text[at:])
    return pa.array(out, pa.string())


def find_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a struct column `out`: counts by base kind, the digest of the base spans, all spans and their scores.

    A null text is empty and has none. Rows are judged one by one, whole; repeated rows get the same result.
    """
    return docs.withColumn(out, F.arrow_udf(_find, FOUND)(F.col(text)))


def redact(text: Column) -> Column:
    """The text with each span replaced by its kind in brackets; null stays null."""
    return F.arrow_udf(_redact, "string")(text)
