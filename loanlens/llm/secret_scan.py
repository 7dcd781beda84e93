"""Secret scan: keyword automaton, anchored expressions, checksum validation.

One Aho-Corasick pass over a text (ASCII letters lower-cased, so positions
stay) finds every keyword; an expression is tried only at the places a
keyword marks, never searched for over the whole text. Runs of hex digits
have no keyword; they are found by their own character class.

Spans. The base kinds `assign`, `access` and `hex` are leftmost,
non-overlapping matches per kind, dropped if too short. Further kinds carry a
check value of their own and are kept only if it holds:
  `card`  13 to 19 digits after "card"/"visa"/"pan", Luhn check digit
  `iban`  "iban" followed by an account number, ISO 7064 mod 97-10
  `ghp`   "ghp_"/"gho_"/"ghs_" token of 36 characters, whose last six are
          the base-62 CRC-32 of the first thirty
They add spans and never remove a base span.

No shuffle: each input partition is scanned in Arrow batches, one text at a
time. Defined results: a null or empty text has no spans; repeated rows give
repeated results; an empty table gives an empty result. Positions are code
points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of kinds among spans with one start.
KINDS = ("assign", "access", "hex", "card", "iban", "ghp")

# The anchored expressions and the keywords that lead to them.
_ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CARD = re.compile(r"[^0-9\n]{0,24}((?:[0-9][ -]?){12,18}[0-9])(?![0-9])")
_IBAN = re.compile(r"[^A-Z0-9\n]{0,12}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_GHP = re.compile(r"gh[pos]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign",
    "apikey": "assign", "api_key": "assign", "akia": "access",
    "card": "card", "visa": "card", "pan ": "card", "iban": "iban",
    "ghp_": "ghp", "gho_": "ghp", "ghs_": "ghp",
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def token_crc(body: str) -> str:
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _BASE62[digit] + out
    return out


def _checked(kind: str, text: str, at: int) -> tuple[int, int] | None:
    """The span that a keyword of a checked kind leads to, if its check holds."""
    if kind == "ghp":
        m = _GHP.match(text, at)
        return m.span() if m and token_crc(m[1]) == m[2] else None
    if kind == "card":
        m = _CARD.match(text, at)
        return m.span(1) if m and luhn(re.sub("[^0-9]", "", m[1])) else None
    m = _IBAN.match(text, at)
    if not m:
        return None
    for end in range(m.end(1), m.start(1) + 14, -1):  # the longest account whose check holds
        account = text[m.start(1) : end].replace(" ", "")
        if text[end - 1] != " " and 15 <= len(account) <= 34 and mod97(account):
            return m.start(1), end
    return None


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start, then kind."""
    spans = {(m.start(), m.end(), "hex") for m in _HEX.finditer(text)}
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = [(end - size + 1, size, kind) for end, (size, kind) in _automaton().iter(low)]
    until = {"assign": 0, "access": 0}
    for at, size, kind in sorted(hits):
        if kind in until:
            if at < until[kind]:
                continue  # inside an earlier match of the kind
            m = (_ASSIGN if kind == "assign" else _ACCESS).match(text, at)
            if m:
                until[kind] = m.end()
                if len(m[1]) >= 12 if kind == "assign" else m.end() - at >= 18:
                    spans.add((at, m.end(), kind))
        else:
            span = _checked(kind, text, at if kind == "ghp" else at + size)
            if span:
                spans.add((*span, kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"doc_id": batch.column(0), "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for value in batch.column(1):
            spans = find_spans(value.as_py() or "")
            base = [s for s in spans if s[2] in KINDS[:3]]
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(spans))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
            ("base_sha256", pa.string()), ("spans", pa.string()),
        ]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scan, SCHEMA
    )
