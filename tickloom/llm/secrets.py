"""Secret scans with dictionary-primed zstandard novelty (operator 6).

Base rules find assignments, access ids and long hexadecimal runs. Beside them, strings
of key-like characters in the line of a sensitive word, or soon after it, are candidates:
each is compressed together with the text around it, under a dictionary of code and of the
corpus's own identifiers, and the bytes it adds are counted. A candidate that adds nearly
as many bytes as random characters would is reported as ``novel``. One pass finds the
sensitive words and one the candidates, so the time is linear in the text.

Cases: null counts as empty; a text without spans has the digest of the empty string;
null ids and rows of equal ids are rows like others, and repeated rows give repeated results.
Spans are in code points, end exclusive; base spans are never changed by novel ones. Other
columns are ignored, whatever their names; an empty table makes no row.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, whole_text

KINDS = ("assign", "access", "hex", "novel")
# The base rules. Letters of the first group in either case are spelled out, so that no other alphabet matches.
_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_ASSIGN = re.compile("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in x) for x in _NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SENSITIVE = re.compile(r"secret|token|bearer|authori[sz]ation|credential|passw|pwd|passphrase|private|signature|(?:api|access|account|auth|client|encryption|master|shared)[ _-]?(?:key|id)|_key|\bkey\b")
_HINTS = ("secret", "token", "bearer", "authori", "credential", "passw", "pwd", "passphrase", "private", "signature", "key", "api", "access", "account", "auth", "client")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Plain words and identifiers, which in short texts add as many bytes as random letters.
_WORDS = re.compile(r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{3,}+|[-_/+=])++")
#: Identifiers of code: called, dotted or assigned to.
_IDENTIFIER = re.compile(r"\b[A-Za-z_][A-Za-z0-9_]{2,39}(?=\(|\.[a-z]|\s?=)")

#: Characters after a sensitive word in which candidates lie beyond its line, context compressed with them, least novelty.
REACH, CONTEXT, LEAST_BYTES, LEAST_SHARE = 64, 256, 9, 0.62

#: Identifiers of the corpus in the dictionary, documents that an identifier must be in, distinct identifiers that a worker holds before it passes its counts on.
IDENTIFIERS, LEAST_DOCUMENTS, HELD = 1000, 3, 100_000

#: Code that primes the compressor before the identifiers of the corpus.
DICTIONARY = (
    "import os sys json re import numpy as np def __init__(self, name, value): return self.value class Config(object): "
    "public static final String private void function(request, response) { const let var => } else if (x == null) for (int i = 0; i < n; i++) "
    "SELECT * FROM users WHERE id = INSERT INTO VALUES localhost 127.0.0.1 http://www. https:// .com/api/v1/ application/json Content-Type: "
    "access_key_id secret_access_key client_secret auth_token api_key private_key public_key session_token password username bearer Authorization: Bearer "
    "example sample placeholder changeme your_api_key_here xxxxxxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 ffffffff "
).encode()


class Novelty:
    """Bytes that a candidate adds to its surroundings under a primed compressor."""

    def __init__(self, dictionary: bytes = DICTIONARY):
        import zstandard

        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added(self, before: str, candidate: str, after: str) -> int:
        around = (before + after).encode()
        return len(self.zstd.compress(around + candidate.encode())) - len(self.zstd.compress(around))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, sorted."""
    found = []
    low = text.lower()
    if any(x in low for x in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, low: str) -> list[tuple[int, int]]:
    """Key-like strings in the line of a sensitive word or within ``REACH`` after one; sensitive words are cut off them.

    A sensitive word with letters or digits on both sides is part of the string it stands in.
    """
    words = [m.span() for m in _SENSITIVE.finditer(low)]
    if not words:
        return []
    starts, ends = [a for a, _ in words], [b for _, b in words]
    found, line = [], (0, -1)
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if a > line[1]:
            first = text.rfind("\n", 0, a) + 1
            last = text.find("\n", a)
            line = (first, last if last >= 0 else len(text))
        k = bisect_left(starts, line[0])
        if not (k < len(starts) and starts[k] < line[1]):
            k = bisect_right(ends, a)
            if not (k and a - ends[k - 1] < REACH):
                continue
        for k in range(bisect_right(ends, a), len(words)):
            first, last = words[k]
            if first >= b:
                break
            if first > 0 and last < len(text) and text[first - 1].isalnum() and text[last].isalnum():
                continue
            if first - a >= 12:
                found.append((a, first))
            a = max(a, last)
        if b - a >= 12:
            found.append((a, b))
    return found


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible strings in sensitive context that no base span touches."""
    low = text.lower()
    if not any(x in low for x in _HINTS):
        return []
    if len(low) != len(text):  # a letter whose small form is longer: keep places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    ends, starts = [], []  # of the base spans' union
    for a, _, b in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    found = []
    for a, b in candidates(text, low):
        k = bisect_right(ends, a)
        if (k < len(starts) and starts[k] < b) or _WORDS.fullmatch(text, a, b):
            continue
        n = novelty.added(text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT])
        if n >= LEAST_BYTES and n >= LEAST_SHARE * (b - a):
            found.append((a, 3, b))
    return found


def corpus_dictionary(docs: DataFrame, size: int = IDENTIFIERS) -> bytes:
    """``DICTIONARY`` and the ``size`` identifiers that most documents have, the commonest last (where a compressor finds them cheapest).

    Only identifiers made of words count, so that no key that many copies hold becomes part of the dictionary.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def passed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if "(" in text or "=" in text or "." in text:
                    seen.update({x for x in _IDENTIFIER.findall(text) if _WORDS.fullmatch(x)})
                if len(seen) > HELD:
                    yield passed()
        yield passed()

    counts = docs.select(whole_text().alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    most = counts.where(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.col("n").desc(), "word").limit(size).collect()
    return DICTIONARY + " ".join(r["word"] for r in reversed(most)).encode()


def scan(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, novel_spans(text, base, novelty)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel; without a dictionary the corpus gives it."""
    bounded_batches(docs.sparkSession)
    dictionary = corpus_dictionary(docs) if dictionary is None else dictionary

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            rows = [scan(x, novelty) for x in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base + novel) for base, novel in rows], pa.int64()) for k in range(4)]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows])
            spans = pa.array([joined(sorted(base + novel)) for base, novel in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts[:3], digests, spans, counts[3]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
