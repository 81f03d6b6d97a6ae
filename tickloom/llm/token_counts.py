"""Token counts by prefix dynamic programming (operator 10).

For byte-pair vocabularies a sequence of pieces is the encoding of its text exactly
if each neighbouring pair is the encoding of its own two pieces. So the last piece of
the encoding of prefix ``i`` is the one piece ending there that is compatible with the
last piece of the prefix before it, and its count is that prefix's count plus one. The
table holds the exact count at every prefix; truncation and budget questions read it
and never encode again.

A text falls apart where no piece of the vocabulary spans two characters (before a
blank mark, around characters that are spelled in bytes); each part's table is worked
out once and kept, the text's table adds them up.

Cases: null counts as empty, with 0 tokens; white space, marks and unknown characters
count as the library counts them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, whole_text

BLANK = "▁"
#: Prefix states kept by a worker.
STATES = 1_800_000
_COUNTERS: dict[tuple[str, int], "PrefixCounter"] = {}
_RUNS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class PrefixCounter:
    """Exact token counts at every prefix for one sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in usable}
        self.spans = {(a, b) for piece in self.score for a, b in zip(piece, piece[1:])}
        if any(b == BLANK and a != BLANK for a, b in self.spans):
            raise ValueError("pieces of this vocabulary span blanks")
        letters = {a for a, _ in self.spans if a.isalpha()}
        #: Marks that no piece joins to a letter before them.
        self.tails = "".join(c for c in ".,;:!?|" if not any((a, c) in self.spans for a in letters))
        self.tail = re.compile(f"([^{re.escape(self.tails)}]+)([{re.escape(self.tails)}]+)") if self.tails else None
        ends: dict[str, set[int]] = {}
        for piece in self.score:
            ends.setdefault(piece[-3:], set()).add(len(piece))
        #: Lengths of the pieces that end in two or three characters, longest first.
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items() if len(k) > 1}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.states: dict[str, tuple[str, int]] = {}
        self.inner: dict[str, int] = {}
        self.first: dict[str, int] = {}

    def encode(self, text: str) -> list[str]:
        """Pieces by repeated best merge; for short strings."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, a: str, b: str) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > STATES:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.encode(a + b) == [a, b]
        return ok

    def _cost(self, piece: str) -> int:
        return 1 if piece in self.score else len(piece.encode())

    def _stands(self, piece: str) -> bool:
        ok = self.alone.get(piece)
        if ok is None:
            ok = self.alone[piece] = self.encode(piece) == [piece]
        return ok

    def state(self, part: str) -> tuple[str, int]:
        """Last piece and token count of ``part``; states of all its prefixes are kept on the way."""
        states = self.states
        found = states.get(part)
        if found is not None:
            return found
        if len(states) > STATES:
            states.clear()
        n = len(part)
        i = n - 1
        while i and part[:i] not in states:
            i -= 1
        score, pairs = self.score, self.pairs
        while i < n:
            i += 1
            for length in self.lengths(part, i):
                j = i - length
                if j < 0:
                    continue
                piece = part[j:i]
                if length > 1 and piece not in score:
                    continue
                if j == 0:
                    if self._stands(piece):
                        found = states[part[:i]] = (piece, self._cost(piece))
                        break
                else:
                    last, count = states[part[:j]]
                    ok = pairs.get((last, piece))
                    if ok or (ok is None and self._fits(last, piece)):
                        found = states[part[:i]] = (piece, count + (1 if piece in score else len(piece.encode())))
                        break
            else:
                raise AssertionError("no piece ends this prefix")
        return found

    def lengths(self, part: str, i: int) -> tuple[int, ...]:
        """Lengths that a piece which ends prefix ``i`` may have, longest first."""
        return self.ends.get(part[i - 3 : i] if i > 2 else "", ()) + ((2, 1) if i > 1 and part[i - 2 : i] in self.ends else (1,))

    def count_part(self, part: str) -> int:
        """Tokens of one part between places that no piece spans."""
        m = self.tail and self.tail.fullmatch(part.lstrip(BLANK))
        if m and m[1].isalpha():  # the same letters that the marks were tested with
            return self.state(part[: len(part) - len(m[2])])[1] + self.state(m[2])[1]
        if len(part) <= 64:
            return self.state(part)[1]
        total, start = 0, 0
        for k in range(1, len(part) + 1):  # long parts: cut where no piece can span
            if k == len(part) or (part[k - 1], part[k]) not in self.spans:
                total += self._long(part[start:k])
                start = k
        return total

    def _long(self, part: str) -> int:
        if len(part) <= 64:
            return self.state(part)[1]
        return self.table_part(part)[-1]

    def table_part(self, part: str) -> list[int]:
        """Counts at the prefixes 1.. of a part, in memory of its own (any length)."""
        last: list[str] = [""]
        count = [0]
        for i in range(1, len(part) + 1):
            for length in self.lengths(part, i):
                j, piece = i - length, part[max(0, i - length) : i]
                if j >= 0 and (length == 1 or piece in self.score) and (self._stands(piece) if j == 0 else self._fits(last[j], piece)):
                    last.append(piece)
                    count.append(count[j] + self._cost(piece))
                    break
            else:
                raise AssertionError("no piece ends this prefix")
        return count[1:]

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points and exact token counts at the ends of the text's parts."""
        if BLANK in text or "  " in text or text[:1] == " " or " \n" in text or "\n " in text:
            ends, counts, at = [], [], -1
            for line_no, line in enumerate((BLANK + text.replace(" ", BLANK)).split("\n") if text else []):
                if line_no:
                    at += 1
                    ends.append(at)
                    counts.append(self.state("\n")[1])
                for m in _RUNS.finditer(line):
                    at += len(m[0])
                    ends.append(at)
                    counts.append(self.count_part(m[0]))
            return np.array(ends, dtype=np.int64), np.cumsum(np.array(counts, dtype=np.int64))
        ends_, counts_ = [], []
        inner, first = self.inner, self.first
        if len(inner) > STATES // 2:
            inner.clear()
        if len(first) > STATES // 2:
            first.clear()
        newline = self.state("\n")[1]
        for line_no, line in enumerate(text.split("\n") if text else []):
            words = line.split(" ")
            head = words[0]
            if line_no:
                counts_.append(newline)
                ends_.append(1)
                if head:
                    n = first.get(head)
                    if n is None:
                        n = first[head] = self.count_part(head)
                    counts_.append(n)
                    ends_.append(len(head))
                words = words[1:]
            for word in words:
                n = inner.get(word)
                if n is None:
                    n = inner[word] = self.count_part(BLANK + word)
                counts_.append(n)
            ends_ += [len(w) + 1 for w in words]
        ends = np.cumsum(np.array(ends_, dtype=np.int64))
        return ends - 1, np.cumsum(np.array(counts_, dtype=np.int64))

    def table(self, text: str) -> np.ndarray:
        """Exact token counts of all prefixes: entry ``i`` is that of the first ``i`` code points."""
        ends, counts = self.boundaries(text)
        out = np.zeros(len(text) + 1, dtype=np.int64)
        start, base, shown = 0, 0, BLANK + text.replace(" ", BLANK)
        for end, count in zip(ends, counts, strict=True):
            rows = self.table_part(shown[start : end + 1])
            for k, n in enumerate(rows):
                if start + k > 0:
                    out[start + k] = base + n
            start, base = end + 1, count
        return out

    def fit(self, text: str, limit: int, found: tuple[np.ndarray, np.ndarray] | None = None) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens, read from the table."""
        ends, counts = found or self.boundaries(text)
        if not len(counts) or counts[-1] <= limit:
            return len(text)
        k = int(np.searchsorted(counts, limit, side="right"))
        base, start = (int(counts[k - 1]), int(ends[k - 1])) if k else (0, -1)
        shown = (BLANK + text[: int(ends[k])].replace(" ", BLANK))[start + 1 :]
        best = max(start, 0)
        for i, n in enumerate(self.table_part(shown), start + 1):
            if base + n <= limit:
                best = i
        return best


def counter(path: str) -> PrefixCounter:
    import os

    key = (path, os.getpid())
    if key not in _COUNTERS:
        _COUNTERS[key] = PrefixCounter(path)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit, fit_chars (longest prefix within the limit)."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = counter(model)
            texts = batch.column(1).to_pylist()
            n_tokens, fits = [], []
            for text in texts:
                found = table.boundaries(text)
                n_tokens.append(int(found[1][-1]) if len(found[1]) else 0)
                fits.append(table.fit(text, limit, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fits, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
