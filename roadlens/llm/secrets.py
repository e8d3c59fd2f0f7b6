"""Secret scans: pattern matches, and high-entropy windows over candidate strings.

Base kinds (code points, end exclusive, leftmost non-overlapping per kind): `assign` is a keyword,
a separator and a value of 8 or more characters (the span is the whole match); `access` an access
key id of 16 or more; `hex` a lower-case hexadecimal run of 32 or more.

Added kind `entropy`: a candidate is a run of 20 or more token characters. The candidate's class
(hexadecimal, alphanumeric, base64) sets the threshold; a window of WINDOW characters slides over
it with its character counts kept incrementally, so that a step costs two count changes whatever
the window's size; windows at or over the threshold merge into spans. An allow-list suppresses
candidates that are ordinary as a whole: anything without a digit (words, paths, identifiers), numbers
and rules, joined words with up to four digits at their end, UUIDs, filler that repeats its first
character eight times, and anything matching `allow`.

Defined results: null text is empty (no spans); repeated rows are reported each; an empty table
gives no rows; extra columns are not read by scan() and kept by redact()."""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the result's definition.
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
# Bits per character that a window must reach, by character class.
THRESHOLD = {"hex": 2.9, "alnum": 3.6, "base64": 3.8}
ALLOW = (
    r"[^0-9]+",  # words, paths, identifiers
    r"[0-9_=-]+",  # numbers, rules
    r"(?:[A-Za-z]+[_/=+-])+[A-Za-z]+[0-9]{0,4}",  # joined words
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r"(.)\1{7,}.*",  # filler
)
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def _class(s: str) -> str:
    if re.fullmatch(r"[0-9a-fA-F]+", s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def entropy_spans(s: str, allow: re.Pattern) -> list[tuple[int, int]]:
    """Spans of a candidate whose windows reach its class's threshold."""
    if allow.fullmatch(s):
        return []
    limit = THRESHOLD[_class(s)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []  # total: the sum of c*log2(c) over the window's counts
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        if i < WINDOW - 1:
            continue
        if math.log2(WINDOW) - total / WINDOW >= limit:
            a = i - WINDOW + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((a, i + 1))
        old = s[i - WINDOW + 1]
        n = counts[old]
        counts[old] = n - 1
        total += _TERM[n - 1] - _TERM[n]
    return spans


def find(text: str, allow: re.Pattern) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every span, sorted."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    for m in CANDIDATE.finditer(text):
        a, s = m.start(), m[0]
        if len(s) >= 32:
            found += [(a + h.start(), 2, a + h.end()) for h in HEX.finditer(s)]
        found += [(a + x, 3, a + y) for x, y in entropy_spans(s, allow)]
    return sorted(found)


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _allowed(allow: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in ALLOW) + "".join(f"|(?:{p})" for p in allow))


def scan(docs: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans of every row."""

    def run(batches):
        ok = _allowed(allow)
        for batch in batches:
            rows = [find(t or "", ok) for t in batch.column(1).to_pylist()]
            count = lambda k: pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64())
            base = [hashlib.sha256(_said([x for x in r if x[1] < 3]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(count(k) for k in range(4)), pa.array(base), pa.array([_said(r) for r in rows], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def _redacted(text: str | None, allow: re.Pattern, mask: str) -> str | None:
    if not text:
        return text
    spans = find(text, allow)
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(text: Column, allow: tuple[str, ...] = (), mask: str = "<SECRET>") -> Column:
    """The text with every span replaced by mask, overlapping spans by one; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        ok = _allowed(allow)
        return texts.map(lambda t: _redacted(t, ok, mask))

    return run(text)
