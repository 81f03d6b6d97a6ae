"""Toxicity with noisy-channel deobfuscation (operator 7).

Suspicious stretches (digits and signs inside words, stars, letters spelled with separators,
letters repeated) become lattices: each sign may stand for itself, for a letter it
imitates, or for nothing; a star for any letter; each repeat may be dropped. A Viterbi
search under a character trigram model, learned from the training rows' words, restores the
likeliest word. Spelled runs and stretches of more than 64 characters, which may hold
several words, are cut into words by a second Viterbi search over the words known, of any
length in linear time. Listed words that a blank or mark splits are joined where their
parts are no known words. The score is a noisy-or over the words of text and restored words:
each word, or its first four or five letters, has a share of toxic training documents. Shares
that chance explains are discounted: among all words seen in ``n`` training rows, a binomial
draw at the overall share tells how many would reach as many toxic rows by luck.

Cases: null and empty texts score 0; without toxic training rows every score is 0; null ids
belong to fold 0 and are scored; rows of equal ids and repeated rows are scored each; other
columns are ignored or pass through, whatever their names; an empty table makes no row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, saved, unused, whole_text
from .labelled import fold, labelled_rows

#: Words known: in so many training rows and so large a share of them, of all or of toxic ones. The shares bound the dictionary, whatever the rows.
KNOWN_ROWS, KNOWN_SHARE, KNOWN_TOXIC = 20, 1 / 300, 1 / 3000
#: Words and beginnings that a worker counts before it passes the counts on.
COUNTED = 500_000
#: Weight of the overall toxic share in a word's share, toxic rows a word needs, least share that counts.
PRIOR_ROWS, LEAST_ROWS, LEAST_SHARE = 0.5, 2, 0.88
#: Log costs of the channel: a sign for a letter, a separator dropped, a repeat dropped, another sign dropped.
SWAP, DROP, SKIP, LOSE = -1.0, -0.7, -3.0, -8.0
# Letters that signs imitate.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_*~'’"
#: Log cost of a letter outside the words known, and of any letter for a star; longest stretch of the character lattice and longest word.
UNKNOWN, WILD, LONGEST, WORD = -4.0, -2.5, 64, 24

_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"(?<!\S)(?=\S*?[0-9@$!|+(€£*])(?=\S*?[^\W\d_])\S{3,}")
_SPELLED = re.compile(r"(?<!\w)[^\W_](?=([ .\-_*~]))(?:\1[\w@$!]){3,}(?!\w)")
_REPEATS = re.compile(r"\b\w*?(\w)\1\1\w*")
_RUN = re.compile(r"(.)\1{2,}")
_SPLIT = re.compile(r"[^\W\d_]+(?:[ .\-_*~'’][^\W\d_]+)+")
_PLAIN = {ord(k): v[0] for k, v in LOOKS.items()} | {ord(c): None for c in SEPARATORS}
_EDGES = "!?.,|()*;:\"'"


class CharModel:
    """Interpolated character trigrams over words."""

    def __init__(self, words: dict[str, int]):
        self.three, self.two, self.one = Counter(), Counter(), Counter()
        pairs, singles = Counter(), Counter()
        for word, n in words.items():
            text = f"^^{word}$"
            for a, b, c in zip(text, text[1:], text[2:]):
                self.three[a + b + c] += n
                pairs[a + b] += n
                self.two[b + c] += n
                singles[b] += n
                self.one[c] += n
        total = sum(self.one.values()) or 1
        self.floor = 0.001 / (len(self.one) + 1)
        self.letters = sorted(c for c in self.one if c.isascii() and c.isalpha())
        self.p1 = {c: n / total for c, n in self.one.items()}
        self.p2 = {k: n / singles[k[0]] for k, n in self.two.items()}
        self.p3 = {k: n / pairs[k[:2]] for k, n in self.three.items()}
        self.kept: dict[str, float] = {}

    def log(self, history: str, c: str) -> float:
        key = history + c
        found = self.kept.get(key)
        if found is None:
            if len(self.kept) > 200_000:
                self.kept.clear()
            p = 0.7 * self.p3.get(key, 0) + 0.2 * self.p2.get(key[1:], 0) + 0.1 * self.p1.get(c, 0) + self.floor
            found = self.kept[key] = math.log(p)
        return found


def restore(token: str, model: CharModel) -> str:
    """The likeliest plain word behind an obfuscated token, by Viterbi over its lattice."""
    best: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    last = ""
    for c in token.lower():
        ways: list[tuple[str, float]] = []
        if c.isalpha():
            ways.append((c, 0.0))
            if c == last:
                ways.append(("", SKIP))
        elif c == "*" and c != last:
            ways += [(x, WILD) for x in model.letters]
            ways.append(("", DROP))
        else:
            ways += [(x, SWAP) for x in LOOKS.get(c, "")]
            ways.append(("", DROP if c in SEPARATORS or c == last else LOSE))
        last = c
        after: dict[str, tuple[float, str]] = {}
        for history, (score, text) in best.items():
            for letter, cost in ways:
                if letter:
                    to, s, t = history[1] + letter, score + cost + model.log(history, letter), text + letter
                else:
                    to, s, t = history, score + cost, text
                if to not in after or s > after[to][0]:
                    after[to] = (s, t)
        best = after
    return max((score + model.log(history, "$"), text) for history, (score, text) in best.items())[1]


def suspicious(text: str) -> set[str]:
    """Stretches of lower-case text that may hide a word; runs of three and more of a letter are cut to two."""
    found = set()
    for m in _SIGNS.findall(text):
        m = m.strip(_EDGES) if m[-1] in _EDGES or m[0] in _EDGES else m
        if len(m) > 2 and not m.isalpha():
            found |= {m, m.rstrip("@$|+(€£*")}  # a sign at the end is a letter or no part of the word
    for m in _SPELLED.finditer(text):
        found |= {m[0], m[0][2:]}  # the first letter may be a word of its own
    found |= {m[0] for m in _REPEATS.finditer(text)}
    return {_RUN.sub(r"\1\1", x) for x in found if len(x) > 2 and any(c.isalpha() for c in x)}


def spelled(token: str) -> bool:
    """Whether single characters take turns with one separator."""
    return len(token) > 4 and token[1] in SEPARATORS and token[1::2] == token[1] * (len(token) // 2)


def features(words: set[str]) -> set[str]:
    """Words and their beginnings, marked by kind."""
    return words | {f"4{w[:4]}" for w in words if len(w) > 4} | {f"5{w[:5]}" for w in words if len(w) > 5}


class ToxicModel:
    def __init__(self, shares: dict[str, float], words: dict[str, int]):
        self.shares, self.words = shares, words
        self.four = {k[1:]: v for k, v in shares.items() if k[0] == "4"}
        self.five = {k[1:]: v for k, v in shares.items() if k[0] == "5"}
        listed = {k for k in shares if k[0] not in "45"}
        self.listed, self.beginnings = listed, {k[:n] for k in listed for n in range(1, len(k))}
        total = sum(words.values()) + 1
        self.cost = {w: math.log(n / total) for w, n in words.items() if len(w) <= WORD} | {w: math.log(max(1, words.get(w, 0)) / total) for w in listed}
        self.chars = None
        self.known: dict[str, tuple[str, ...]] = {}

    def share(self, word: str) -> float:
        return max(self.shares.get(word, 0.0), self.four.get(word[:4], 0.0) if len(word) > 4 else 0.0, self.five.get(word[:5], 0.0) if len(word) > 5 else 0.0)

    def cut(self, letters: str) -> set[str]:
        """Known words on the likeliest way to cut a run of letters into words and unknown letters."""
        best, back = [0.0], [0]
        for i in range(1, len(letters) + 1):
            score, at = best[i - 1] + UNKNOWN, -1
            for j in range(max(0, i - WORD), i - 1):
                cost = self.cost.get(letters[j:i])
                if cost is not None and best[j] + cost > score:
                    score, at = best[j] + cost, j
            best.append(score)
            back.append(at)
        words, i = set(), len(letters)
        while i:
            if back[i] >= 0:
                words.add(letters[back[i] : i])
            i = back[i] if back[i] >= 0 else i - 1
        return words

    def restored(self, token: str) -> tuple[str, ...]:
        """Words behind one suspicious stretch."""
        plain = token.translate(_PLAIN)
        if len(token) > LONGEST:
            return tuple(self.cut(plain))
        words = {restore(token, self.chars)}
        return tuple(words | self.cut(plain) if spelled(token) else words)

    def words_of(self, text: str) -> set[str]:
        """Lower-case words of the text and those restored from its obfuscated stretches."""
        low = text.lower()
        row = _WORD.findall(low)
        words = set(row)
        if self.chars is None:
            self.chars = CharModel(self.words)
        for token in suspicious(low):
            found = self.known.get(token)
            if found is None:
                if len(self.known) > 50_000:
                    self.known.clear()
                found = self.restored(token)
                if len(token) <= LONGEST:
                    self.known[token] = found
            words.update(found)
        if not words.isdisjoint(self.beginnings):
            for k, part in enumerate(row[:-1]):
                if part in self.beginnings and part + row[k + 1] in self.listed and not (part in self.words and row[k + 1] in self.words):
                    words.add(part + row[k + 1])
        return words

    def score(self, text: str) -> float:
        words = self.words_of(text)
        hits = words & self.shares.keys()
        if self.four or self.five:
            four, five = self.four, self.five
            hits |= {w for w in words if w[:4] in four or w[:5] in five}
        rest = 1.0
        for word in hits:
            p = self.share(word)
            if p >= LEAST_SHARE:
                rest *= 1.0 - p
        return 1.0 - rest


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column | None = None) -> ToxicModel:
    """Learns shares and the character model from all labelled rows outside the held-out fold.

    Every word and beginning is counted. What reaches the driver is the dictionary (a word in 1 of 300 rows, so at most 300 times
    the words of a mean text), the words whose share chance does not explain, and the numbers of words by rows they are in.
    """
    bounded_batches(docs.sparkSession)
    rows = labelled_rows(docs, labels, "toxic", fold(3) != 1 if keep is None else keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def counted() -> pa.RecordBatch:
            keys = [*(toxic.keys() | clean.keys())]
            return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "toxic": pa.array([toxic[k] for k in keys], pa.int64()), "clean": pa.array([clean[k] for k in keys], pa.int64())})

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label > 0 else clean).update({"", *features(set(_WORD.findall(text.lower())))})  # the empty key counts rows
                if len(toxic) + len(clean) > COUNTED:
                    yield counted()
                    toxic.clear()
                    clean.clear()
        yield counted()

    counts = rows.select("label", "text").mapInArrow(count, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = saved(counts, "toxic-counts")
    totals = next(((r["toxic"], r["clean"]) for r in counts.where("key = ''").collect()), (0, 0))
    n, base = sum(totals), totals[0] / max(1, sum(totals))
    counts = counts.where("key <> ''")
    seen = F.col("toxic") + F.col("clean")
    high = (F.col("toxic") >= LEAST_ROWS) & (F.col("toxic") + PRIOR_ROWS * base >= (LEAST_SHARE - 1e-9) * (seen + PRIOR_ROWS))
    levels = counts.groupBy("toxic", "clean").count().withColumn("high", F.max(high).over(Window.partitionBy(seen))).where("high")
    levels = [(r["toxic"], r["clean"], r["count"]) for r in levels.collect()]
    by_level = word_shares([((t, c), t, c) for t, c, _ in levels if t >= LEAST_ROWS], levels, base)
    known = (seen >= max(KNOWN_ROWS, n * KNOWN_SHARE)) | (F.col("toxic") >= max(LEAST_ROWS, n * KNOWN_TOXIC))
    words = {r["key"]: r["toxic"] + r["clean"] for r in counts.where(known).collect()}
    shares = {}
    if by_level:
        real = docs.sparkSession.createDataFrame([*by_level], "toxic long, clean long")
        found = {r["key"]: (r["toxic"], r["clean"]) for r in counts.join(F.broadcast(real), ["toxic", "clean"]).collect()}
        apart = _apart(rows, set(found))
        real = word_shares([(k, *apart.get(k, (0, 0))) for k in found], levels, base)
        shares = {k: by_level[found[k]] for k in real}
        words |= {k: sum(found[k]) for k in real}
    return ToxicModel(shares, {k: v for k, v in words.items() if not k[0].isdigit()})


def _apart(rows: DataFrame, keys: set[str]) -> dict[str, tuple[int, int]]:
    """Toxic and clean rows of each word or beginning, near copies counted about once: the median of the numbers of different values of each minimum."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, label > 0, m) for label, text, m in zip(*[c.to_pylist() for c in batch.columns], strict=True) for k in features(set(_WORD.findall(text.lower()))) & keys]
            yield pa.RecordBatch.from_pydict({"key": pa.array([x[0] for x in out], pa.string()), "toxic": pa.array([x[1] for x in out], pa.bool_()), "minima": pa.array([x[2] for x in out], pa.list_(pa.int64()))})

    found = rows.select("label", "text", "minima").mapInArrow(hits, "key string, toxic boolean, minima array<long>")
    found = found.select("key", "toxic", F.posexplode("minima").alias("k", "least")).distinct().groupBy("key", "toxic", "k").count()
    found = found.groupBy("key", "toxic").agg(F.percentile("count", 0.5).alias("n"))
    n = {(r["key"], r["toxic"]): int(r["n"]) for r in found.collect()}
    return {k: (n.get((k, True), 0), n.get((k, False), 0)) for k in keys}


def word_shares(counts: list[tuple[Hashable, int, int]], levels: list[tuple[int, int, int]], base: float) -> dict[Hashable, float]:
    """Shares of at least ``LEAST_SHARE`` by word (or other key); ``levels`` counts the words seen in so many toxic and clean rows."""
    by_rows: dict[int, Counter] = {}
    for t, c, n in levels:
        by_rows.setdefault(t + c, Counter())[t] += n
    real: dict[tuple[int, int], float] = {}

    def not_luck(t: int, n: int) -> float:
        if (t, n) not in real:
            seen = by_rows.get(n, Counter())
            tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(base) + (n - k) * math.log1p(-base)) for k in range(t, n + 1))
            there = sum(v for k, v in seen.items() if k >= t)
            real[t, n] = max(0.0, 1.0 - seen.total() * tail / max(1, there))
        return real[t, n]

    shares = {}
    for key, t, c in counts:
        p = (t + PRIOR_ROWS * base) / (t + c + PRIOR_ROWS)
        if p >= LEAST_SHARE and 0 < base < 1:
            p = base + (p - base) * not_luck(t, t + c)
            if p >= LEAST_SHARE:
                shares[key] = p
    return shares


def score_toxicity(docs: DataFrame, model: ToxicModel, name: str = "toxic_score") -> DataFrame:
    """Every column of ``docs`` and the score as ``name``, which must be free."""
    bounded_batches(docs.sparkSession)
    if unused(docs, name) != [name]:
        raise ValueError(f"docs has a column {name}")
    shares, words = model.shares, model.words

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicModel(shares, words)
        for batch in batches:
            scores = pa.array([own.score(x or "") for x in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from 0.7)."""
    scored = score_toxicity(docs.select("doc_id", whole_text().alias("text")), fit_toxicity(docs, labels))
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= 0.7, 1).otherwise(0).alias("predicted"))
