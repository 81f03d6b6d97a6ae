"""Benchmark decontamination by greedy string tiling (operator 8).

Documents and benchmark items that share a window of ``SEED`` words (equal rolling
hashes, then equal words) are compared: running Karp-Rabin search finds their maximal
common word runs, the longest are marked first, marked words are used once, and the
search length falls to ``SEED``. A document is contaminated by an item whose words are
tiled to at least ``COVER``; since tiles may lie in any order, reordered passages count.

Equal items (equal words) become one before anything else, under their least id. They are
read in blocks of at most ``BLOCK_CHARS``: one block, as a rule; a larger benchmark takes
several passes over the documents, with the same result.

Cases: null and empty documents and items match nothing; items shorter than a seed are
one seed; of items that cover a document equally the least id is reported, a null one last; a
document covered best by an item of null id reports a null id with its coverage; repeated
rows and equal ids are rows of their own; other columns pass through untouched, whatever
their names; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, saved, unused
from .words import mix, windows, word_hashes

SEED, COVER = 5, 0.5
BLOCK_CHARS = 8_000_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Rolling:
    """Hashes of windows of any length of one word sequence, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _MULTIPLY)]))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words) * powers[:n])])

    def of(self, length: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that hold no marked word, and their hashes; ``free`` counts unmarked words before each place."""
        at = np.nonzero(free[length:] - free[: max(0, len(free) - length)] == length)[0]
        return at, (self.sums[at + length] - self.sums[at]) * self.back[at]


def tile(a: list[int], b: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in a, start in b, length) by greedy string tiling; 0 never matches.

    Each turn finds the length of the longest common run of unmarked words, by bisection over Karp-Rabin hashes of all
    windows of a length, and marks runs of that length from left to right until none is left. Lengths fall with each turn
    and marked runs do not overlap, so there are at most about the root of ``2 len(b)`` turns.
    """
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    in_x, in_y = Rolling(x), Rolling(y)
    open_x, open_y = x != 0, y != 0
    tiles: list[tuple[int, int, int]] = []
    most = min(len(x), len(y))

    def counted(marks: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(marks)])

    while most >= least:
        free_x, free_y = counted(open_x), counted(open_y)
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            if np.isin(in_x.of(middle, free_x)[1], in_y.of(middle, free_y)[1]).any():
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        at, hashes = in_y.of(low, free_y)
        places: dict[int, list[int]] = {}
        for j, h in zip(at[::-1].tolist(), hashes[::-1].tolist(), strict=True):
            places.setdefault(h, []).append(j)
        at, hashes = in_x.of(low, free_x)
        common = np.isin(hashes, np.fromiter(places, np.uint64, len(places)))
        end, marked = 0, False
        for i, h in zip(at[common].tolist(), hashes[common].tolist(), strict=True):
            if i < end:
                continue
            stack = places[h]
            while stack and not (open_y[stack[-1]] and open_y[stack[-1] + low - 1]):
                stack.pop()
            if stack and (x[i : i + low] == y[stack[-1] : stack[-1] + low]).all():
                j = stack.pop()
                open_x[i : i + low] = open_y[j : j + low] = False
                tiles.append((i, j, low))
                end, marked = i + low, True
        most = low if marked and len(tiles) and np.isin(*(side.of(low, counted(marks))[1] for side, marks in ((in_x, open_x), (in_y, open_y)))).any() else low - 1
    return tiles


class Benchmark:
    """Items of one block and the index of their seeds."""

    def __init__(self, items: list[tuple[int | None, str]], seed: int = SEED):
        self.seed = seed
        self.items = [(item_id, words) for item_id, words in ((k, word_hashes(text or "")) for k, text in sorted(items, key=lambda x: rank(x[0]))) if len(words)]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {min(seed, len(w)) for _, w in self.items}:
            pairs = [(np.unique(windows(w, n)), k) for k, (_, w) in enumerate(self.items) if min(seed, len(w)) == n]
            hashes = np.concatenate([h for h, _ in pairs])
            owner = np.concatenate([np.full(len(h), k) for h, k in pairs])
            order = np.argsort(hashes, kind="stable")
            self.by_length[n] = (hashes[order], owner[order])

    def best(self, text: str, cover: float) -> tuple[int | None, float, int]:
        """Item with the largest tiled share (of equal ones the least id), that share, and the number of items at ``cover`` or more."""
        words = word_hashes(text)
        seeds: dict[int, list[np.ndarray]] = {}
        for n, (hashes, owner) in self.by_length.items():
            own = windows(words, n)
            lo, hi = np.searchsorted(hashes, own), np.searchsorted(hashes, own, side="right")
            at = np.nonzero(hi > lo)[0]
            if not len(at):
                continue
            many = (hi - lo)[at]
            spots = np.repeat(at, many)
            which = owner[np.repeat(lo[at] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            order = np.argsort(which, kind="stable")
            which, spots = which[order], spots[order]
            cuts = np.nonzero(np.diff(which))[0] + 1
            for k, part in zip(which[np.concatenate([[0], cuts])].tolist(), np.split(spots, cuts), strict=True):
                seeds[k] = part
        item, share, above = None, 0.0, 0
        bounds = []
        for k, at in seeds.items():
            n = min(self.seed, len(self.items[k][1]))
            inside = np.zeros(len(words) + 1, np.int64)
            np.add.at(inside, at, 1)
            np.add.at(inside, at + n, -1)
            inside = np.cumsum(inside)[:-1] > 0
            bounds.append((-min(1.0, inside.sum() / len(self.items[k][1])), k, inside))
        best = None
        for bound, k, inside in sorted(bounds, key=lambda x: x[:2]):
            if -bound < max(share, 1e-12) and -bound < cover:
                break  # no item from here on can cover more
            item_id, target = self.items[k]
            at = np.nonzero(inside)[0]
            parts = np.insert(words[at], np.nonzero(np.diff(at) > 1)[0] + 1, 0)
            covered = sum(t[2] for t in tile(parts, target, min(self.seed, len(target)))) / len(target)
            above += covered >= cover
            if covered and (covered > share or (covered == share and k < best)):
                item, share, best = item_id, covered, k
        return item, share, above


def rank(item_id: int | None) -> tuple[bool, int]:
    """Order of item ids: null last."""
    return item_id is None, item_id or 0


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """item_id, text, words (their digest): one item of each sequence of words, under its least id (null last)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [hashlib.md5(word_hashes(x).tobytes()).digest() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.binary())], ["item_id", "text", "words"])

    bounded_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.mapInArrow(digest, "item_id long, text string, words binary")
    return rows.groupBy("words").agg(F.min(F.struct(F.col("item_id").isNull().alias("none"), "item_id", "text")).alias("of")).select("of.item_id", "of.text", "words")


def _blocks(benchmark: DataFrame, chars: int) -> Iterator[list[tuple[int | None, str]]]:
    rows = saved(distinct_items(benchmark), "items")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // chars))
    for k in range(n):
        yield [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k).collect()]


def tile_documents(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, names: tuple[str, str, str] = ("item_id", "coverage", "items"), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with three more columns: the best item's id, coverage (largest share of an item that is tiled) and items (those at ``cover``).

    ``names`` must be free in ``docs``; the pipeline takes others where they are not.
    """
    bounded_batches(docs.sparkSession)
    if any(x != y for x, y in zip(names, unused(docs, *names), strict=True)):
        raise ValueError(f"docs has columns named as the results: {names}")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.IntegerType())])
    docs = docs.withColumns({names[0]: F.lit(None).cast("long"), names[1]: F.lit(0.0), names[2]: F.lit(0)})
    at = docs.columns.index("text")
    for items in _blocks(benchmark, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Benchmark(sent.value)
            for batch in batches:
                new = []
                for text, *old in zip(*(batch.column(k).to_pylist() for k in (at, -3, -2, -1)), strict=True):
                    found = own.best(text or "", cover)
                    better = found[1] > old[1] or (found[1] == old[1] > 0 and rank(found[0]) < rank(old[0]))
                    new.append((*(found if better else old)[:2], old[2] + found[2]))
                last = [pa.array([x[k] for x in new], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *last], batch.schema.names)

        docs = docs.mapInArrow(match, schema)
    return docs


def decontamination(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """Per row: doc_id, contaminated, item_id (of the best cover, null if none or if that item has none), coverage, items."""
    return tile_documents(docs.select("doc_id", "text"), benchmark, cover).select("doc_id", (F.col("coverage") >= cover).alias("contaminated"), "item_id", "coverage", "items")
