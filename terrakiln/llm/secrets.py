"""Secret scans (op4): pattern kinds, plus runs of high entropy found by sliding windows.

Base kinds are assign, access and hex (leftmost, non-overlapping, too short ones dropped after matching). The entropy
kind looks at every run of 20 or more of `[A-Za-z0-9+/_=-]`. A window of WINDOW characters moves over the run; the counts of
its characters change by one in and one out, and with them, per class (hex digits, letters and digits, base 64), the
window's Shannon entropy. Windows over a class's threshold are joined to a span, but for
windows of words: those with few digits and with less than MIXED of their letters and digits outside word-shaped pieces (4
letters or more of one case, or capitalised, with a vowel and without 4 consonants in a row). Spans that touch a base
span, and spans whose path segments (between / and =) are all on the allow-list (numbers, UUIDs, identifiers made of
words, hashes named as checksums), are dropped; a placeholder clears its own segment only. A key of letters of one case only is taken for words where it happens to be word-shaped.

Every text is scanned whole, in its own partition: no shuffle. Defined cases: a null or empty text has no span; repeated
rows give repeated rows; an empty table an empty result; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: By class: its characters, least entropy (bits a character) of a window, and the share of digits from which it is not
#: asked for words. The entropy of 20 different characters is 4.32.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 2.9, 0.25),
    ("alnum", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 3.6, 0.15),
    ("base64", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"), 3.7, 0.15),
)
#: Least share of letters and digits outside word-shaped pieces, in a window of few digits.
MIXED = 0.4
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", re.A)
WORDLIKE = re.compile(r"(?=.{4})(?=.*[aeiouy])(?!.*[^aeiouy]{4})", re.I | re.A)
PLACEHOLDER = re.compile(r"[^/=]*(?:example|sample|placeholder|changeme|dummy|xxxx|0123456789|abcdefgh|lorem)[^/=]*", re.A)
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # a UUID names, it doesn't open
    r"|[0-9+_-]*"  # numbers, dates, rules of dashes
    r"|.{1,3}",
    re.A,
)
JOINED = re.compile(r"(?:[A-Za-z]+[_+-]+)*[A-Za-z]*", re.A)  # joined by signs
NAMED_HASH = re.compile(r"(?:sha-?(?:1|224|256|384|512)|md5|integrity|checksum|digest)[\"'\x20:=(-]{1,4}$", re.I | re.A)
_TERM = [0.0] + [n / WINDOW * math.log2(n / WINDOW) for n in range(1, WINDOW + 2)]
_RUN_MAP = bytes(1 if (chr(b).isalnum() and b < 128) or chr(b) in "+/_=-" else 0 for b in range(256))
_HEX_MAP = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_RUN_MARK, _HEX_MARK = b"\1" * WINDOW, b"\1" * 24
_HINTS = (b"passw", b"secret", b"token", b"key")


def unlike_words(run: str) -> list[int]:
    """For each character 1 if it is a letter or digit outside word-shaped pieces, else 0."""
    out = [int(c.isalnum()) for c in run]
    for m in PIECE.finditer(run):
        if WORDLIKE.match(m[0]):
            out[m.start() : m.end()] = [0] * len(m[0])
    return out


def entropy_windows(run: str) -> list[tuple[int, int]]:
    """Joined windows of run, as offsets, that are over the threshold of the narrowest class which holds the window and are
    not words."""
    odd, signs = [0, *accumulate(unlike_words(run))], [0, *accumulate(c in "+/_=-" for c in run)]
    spans: list[list[int]] = []
    counts: dict[str, int] = {}
    total, digits, outside = 0.0, 0, [0] * len(CLASSES)
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        digits += "0" <= c <= "9"
        for k, (_, members, _, _) in enumerate(CLASSES):
            outside[k] += c not in members
        if i >= WINDOW:
            c = run[i - WINDOW]
            n = counts[c]
            total += _TERM[n - 1] - _TERM[n]
            counts[c] = n - 1
            digits -= "0" <= c <= "9"
            for k, (_, members, _, _) in enumerate(CLASSES):
                outside[k] -= c not in members
        if i >= WINDOW - 1:
            k = next((k for k in range(len(CLASSES)) if not outside[k]), None)
            a = i - WINDOW + 1
            mixed = odd[i + 1] - odd[a] >= MIXED * (WINDOW - signs[i + 1] + signs[a])
            if k is not None and -total >= CLASSES[k][2] and (mixed or digits >= CLASSES[k][3] * WINDOW):
                if spans and i - WINDOW + 1 <= spans[-1][1]:
                    spans[-1][1] = i + 1
                else:
                    spans.append([i - WINDOW + 1, i + 1])
    return [(a, b) for a, b in spans]


def allowed(text: str, start: int, end: int) -> bool:
    run = text[start:end]
    named, equals, value = run.rpartition("=")
    if equals and value and NAMED_HASH.search(named[-16:] + "="):  # the name of the hash lies inside the run
        return True
    if ALLOWED.fullmatch(run) or NAMED_HASH.fullmatch(run + "=") or NAMED_HASH.search(text[max(0, start - 16) : start]):
        return True
    run = re.sub("[0-9]{1,4}$", "", run)  # a number at most
    return bool(JOINED.fullmatch(run)) and sum(unlike_words(run)) < MIXED * sum(map(str.isalnum, run))


def segments(text: str, start: int, end: int, low: int, high: int) -> list[tuple[int, int]]:
    """The path segments of text[low:high] that text[start:end] touches."""
    found = [(m.start(), m.end()) for m in re.compile("[^/=]+").finditer(text, low, high)]
    return [(a, b) for a, b in found if a < end and start < b]


def scan(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans of text, in order."""
    raw = text.encode() if raw is None else raw
    found: list[tuple[int, int, int]] = []
    low = raw.lower()
    if any(x in low for x in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_MARK in raw.translate(_HEX_MAP):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if _RUN_MARK in raw.translate(_RUN_MAP):
        base = sorted((a, b) for a, _, b in found)
        for m in RUN.finditer(text):
            # a placeholder's segment is no part of a key, what lies around it can be
            gone = [x.span() for x in PLACEHOLDER.finditer(text, *m.span())]
            for low, high in zip([m.start(), *(b for _, b in gone)], [*(a for a, _ in gone), m.end()], strict=True):
                for a, b in entropy_windows(text[low:high]) if high - low >= WINDOW else ():
                    a, b = a + low, b + low
                    if any(x < b and a < y for x, y in base) or allowed(text, a, b):
                        continue
                    if not all(allowed(text, *x) for x in segments(text, a, b, low, high)):
                        found.append((a, 3, b))
    return sorted(found)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: list[list[int]] = [[], [], [], []]
        base, spans = [], []
        for raw in batch.column(1).cast(pa.binary()).to_pylist():
            found = scan(raw.decode(errors="replace"), raw) if raw else []
            for k in range(4):
                n[k].append(sum(x[1] == k for x in found))
            said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found if k < 3]
            base.append(hashlib.sha256(",".join(said).encode()).hexdigest())
            spans.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found))
        arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(base, pa.string()), pa.array(spans, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])


def scan_documents(docs: DataFrame) -> DataFrame:
    """A row for each of docs (doc_id, text, ...): counts by kind and all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(lean(_scan_batches), schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
