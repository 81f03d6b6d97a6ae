"""Near-duplicate classes by DartMinHash and banded joins (operator 5).

Each shingle (five lower-case words) weighs the bit length of its count in the text: 1,
2 from two occurrences, 3 from four. It throws hashed darts: a Poisson process in time over
its weight, in strips of doubling width, so that any two documents see the same darts of
a common shingle. Darts below the weight and before a time that yields about
``k (ln k + 4)`` of them are dealt to ``k`` coordinates; the earliest of a coordinate
is its sign, and signs agree with the probability of the weighted Jaccard similarity.

Copies of a text become one representative. Signs are cut into bands; representatives
that share a band are candidates: all pairs in small buckets; in large ones pairs with a
hub, again with other hubs while rounds join many classes, and then, in every bucket that
still holds several classes, each member outside the largest class with all members of
other classes, in salted blocks. Every candidate pair is checked by the weighted Jaccard
similarity, worked out from 32-bit hashes (a shingle of weight ``w`` is ``w`` numbered
elements, so that the weighted similarity is that of plain sets). Classes are the
connected components of the links: the same as if all pairs of every bucket were checked.

Cases: null and empty texts are copies of each other; texts under five words are one
shingle; a null id joins the class of its text; equal ids of different texts are
separate rows; other columns pass through or are ignored, whatever their names; an empty
table makes no row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved, unused, whole_text
from .words import mix, shingles

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: Buckets of up to so many representatives give all their pairs.
PAIRED = 8
#: Hub rounds end when fewer than this share of a round's pairs are links.
HUB_SHARE = 0.05
#: Most representatives and, about, shingles in one block of a large bucket; shingles of more members of a block count by matrix products.
BLOCK, BLOCK_GRAMS, DENSE = 1024, 1_000_000, 48
#: A side of at most so many narrow rows is broadcast.
SMALL_ROWS = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def dart_signs(elements: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """``k`` 64-bit signs of a weighted set of 64-bit elements (weight 1 where none are given); zeros if it is empty."""
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
    elements, weights = elements[weights > 0], weights[weights > 0]
    if not len(elements):
        return np.zeros(k, np.uint64)
    until = k * (math.log(k) + 4) / weights.sum()
    strips = int(math.floor(math.log2(weights.max() + 1))) + 1
    while True:
        coords, times, names = [], [], []
        for strip in range(strips):
            low, width = 2.0**strip - 1, 2.0**strip
            inside = weights > low
            base = mix(elements[inside] ^ mix(np.full(1, strip + 1, np.uint64)))
            limit = weights[inside]
            clock, j = np.zeros(len(base)), 0
            block = max(1, math.ceil(until * width))
            while len(base):
                steps = np.arange(j, j + block, dtype=np.uint64) * _STEP
                draws = mix(base[:, None] + steps[None, :])
                gaps = -np.log(_uniform(draws)) / width
                arrive = clock[:, None] + np.cumsum(gaps, axis=1)
                other = mix(draws ^ _STEP)
                kept = (arrive <= until) & (low + width * _uniform(other) < limit[:, None]) if limit.min() < low + width else arrive <= until
                coords.append((other[kept] % np.uint64(k)).astype(np.int64))
                times.append(arrive[kept])
                names.append(draws[kept])
                more = arrive[:, -1] <= until
                base, limit, clock, j = base[more], limit[more], arrive[more, -1], j + block
        coord, time, name = np.concatenate(coords), np.concatenate(times), np.concatenate(names)
        order = np.argsort(-time, kind="stable")
        signs, first = np.zeros(k, np.uint64), np.zeros(k, bool)
        signs[coord[order]] = name[order]
        first[coord] = True
        if first.all():
            return signs
        until *= 2


def bands(signs: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band."""
    key = np.zeros(n, np.uint64)
    for row in signs.reshape(n, rows).T:
        key = mix(key * _STEP + row)
    return key


def weighted_shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights: the bit lengths of their counts."""
    own, counts = shingles(text, words, counted=True)
    return own, np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def numbered(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Distinct 32-bit hashes of (element, i) for i below its weight."""
    nth = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
    spread = np.repeat(elements, weights) + nth.astype(np.uint64) * _STEP
    spread[nth > 0] = mix(spread[nth > 0])
    return np.unique((spread >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def signatures(docs: DataFrame, words: int = WORDS, n: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, copy (md5 of the text), grams (array<int>: weighted shingles as numbered elements), bands (array<long>)."""
    bounded_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, keys = [], []
            for text in batch.column(2).to_pylist():
                own, weights = weighted_shingles(text, words)
                keys.append(bands(dart_signs(own, weights, n * rows), n, rows).view(np.int64))
                grams.append(numbered(own, weights))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in grams])]).astype(np.int32)
            flat = np.concatenate(grams) if grams else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * (len(keys) + 1), n, dtype=np.int32)), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))),
                ],
                ["doc_id", "copy", "grams", "bands"],
            )

    text = whole_text()
    return docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("copy"), text.alias("text")).mapInArrow(sign, "doc_id long, copy binary, grams array<int>, bands array<long>")


def _small(df: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast only if it is counted small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def verified(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Of ``pairs(a, b)`` (saved), those whose shingle sets have at least that Jaccard similarity."""
    ids = saved(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "near-ids")
    sets = saved(grams.join(_small(ids), "id", "left_semi"), "near-sets")
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def components(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, label (least id of its component) for the ends of ``links(a, b)``; min labels with pointer jumps."""
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hop = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = labels.join(seen, "id").join(hop, "label", "left").select("id", F.least("label", "near", F.coalesce("far", "label")).alias("label"), F.col("label").alias("old"))
        new = saved(new, "labels")
        labels = new.select("id", "label")
        if not new.where("label <> old").limit(1).count():
            return labels


def block_links(a: np.ndarray, b: np.ndarray, labels: np.ndarray, starts: np.ndarray, grams: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y), x of ``a`` and y of ``b``, of different labels and at least that Jaccard similarity; set k is ``grams[starts[k]:starts[k + 1]]``."""
    sizes = np.diff(starts)
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    _, code, seen = np.unique(grams, return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    owner, first = owner[order], np.concatenate([[0], np.cumsum(seen)[:-1]])
    left, right = np.full(n, -1), np.full(n, -1)
    left[a], right[b] = np.arange(len(a)), np.arange(len(b))
    shared = np.zeros((len(a), len(b)), np.float32)
    for f in range(2, DENSE + 1):  # a shingle of one set is shared by none
        at = first[seen == f]
        for part in np.array_split(at, max(1, len(at) * f * f // 4_000_000)):
            who = owner[part[:, None] + np.arange(f)]
            x, y = np.broadcast_arrays(left[who][:, :, None], right[who][:, None, :])
            inside = (x >= 0) & (y >= 0)
            shared += np.bincount(x[inside] * len(b) + y[inside], minlength=shared.size).reshape(shared.shape)
    often = np.nonzero(seen > DENSE)[0]
    for part in np.array_split(often, -(-len(often) // 2048)) if len(often) else []:
        has = np.zeros((n, len(part)), np.float32)
        for k, c in enumerate(part):
            has[owner[first[c] : first[c] + seen[c]], k] = 1
        shared += has[a] @ has[b].T
    near = shared >= similarity * (sizes[a][:, None] + sizes[b][None, :] - shared.astype(np.float64))
    x, y = np.nonzero(near & (labels[a][:, None] != labels[b][None, :]))
    return a[x], b[y]


def apart_links(members: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different classes in one bucket of ``members(band, key, id, label, size)`` (saved): every such pair is compared.

    Members outside a bucket's largest class are dealt to blocks, those of the largest to others; each pair of blocks
    but those of the largest class alone is one group. Buckets of equal members count once.
    """
    digest = [F.bit_xor(F.xxhash64("id", F.lit(k))) for k in (0, 1)]
    by_class = members.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), digest[0].alias("x0"), digest[1].alias("x1"))
    whole = [F.sum("n").alias("n"), F.sum("size").alias("size"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"), F.max(F.struct("n", "label", "size")).alias("most")]
    sizes = by_class.groupBy("band", "key").agg(*whole).groupBy("n", "x0", "x1").agg(F.min(F.struct("band", "key", "size", "most")).alias("of"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_GRAMS, F.lit(1.0)))
    apart = blocks(F.col("n") - F.col("of.most.n"), F.col("of.size") - F.col("of.most.size"))
    sizes = saved(sizes.select("of.band", "of.key", F.col("of.most.label").alias("most"), apart.alias("apart"), blocks(F.col("of.most.n"), F.col("of.most.size")).alias("together")), "near-sizes")
    place = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), n)
    inner = F.col("label") == F.col("most")
    dealt = members.join(_small(sizes), ["band", "key"]).withColumn("own", F.when(inner, F.col("apart") + place("together")).otherwise(place("apart")))
    tasks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(inner, F.col("apart")).otherwise(F.col("apart") + F.col("together")) - 1)))
    tasks = tasks.select("band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "label")
    sets = saved(grams.join(_small(saved(members.select("id").distinct(), "near-ids")), "id", "left_semi"), "near-sets")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, ids, labels = (table.column(c).to_numpy() for c in ("own", "id", "label"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        lists = table.column("grams").combine_chunks()
        starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        x, y = block_links(np.nonzero(own == lo)[0], np.nonzero(own == hi)[0], labels, starts, lists.flatten().to_numpy(), similarity)
        x, y = ids[x], ids[y]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    bounded_batches(grams.sparkSession)
    return tasks.join(sets, "id").groupBy("band", "key", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def near_links(signed: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between representatives and their components (id, label), from ``signed(id, grams, bands)``."""
    keyed = signed.select("id", F.size("grams").alias("size"), F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = saved(keyed.join(sizes, ["band", "key"]), "near-buckets")
    few = crowded.where(f"n <= {PAIRED}").groupBy("band", "key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    every = few.select(F.explode(F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", F.lit(1), i), lambda y: F.struct(y.alias("a"), x.alias("b")))))).alias("p")).select("p.a", "p.b")
    large = crowded.where(f"n > {PAIRED}").select("id", "band", "key", "size")
    crowds = large.limit(1).count()
    grams = signed.select("id", "grams")
    links = classes = None
    members = large.withColumn("label", F.col("id"))
    for turn in itertools.count():  # each round but the last joins many classes
        rank = F.xxhash64("id", "band", F.lit(turn))
        hubs = members.groupBy("band", "key").agg(F.min(F.struct(rank.alias("r"), F.col("id").alias("id"), F.col("label").alias("label"))).alias("hub"))
        hubs = hubs.select("band", "key", F.col("hub.id").alias("hub"), F.col("hub.label").alias("hub_label"))
        pairs = members.join(hubs, ["band", "key"]).where("label <> hub_label").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        pairs = saved((pairs if turn else pairs.union(every)).distinct(), "near-pairs")
        found = saved(verified(pairs, grams, similarity), "near-links")
        links = found if links is None else links.union(found)
        classes = components(links)
        if not crowds:
            return links, classes
        labelled = large.join(classes, "id", "left").withColumn("label", F.coalesce("label", "id"))
        apart = labelled.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band", "key")
        members = saved(labelled.join(apart, ["band", "key"]).select("band", "key", "id", "label", "size"), "near-apart")
        if not members.limit(1).count():
            return links, classes
        if found.count() < HUB_SHARE * pairs.count():
            break
    links = links.union(saved(apart_links(members, grams, similarity), "near-apart-links"))
    return links.distinct(), components(links)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, copy, class_id (least id of the class), class, row."""
    signed = saved(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "near-signs")
    rows = signed.select("doc_id", "copy", "row")
    copies = saved(rows.groupBy("copy").agg(F.min("row").alias("id"), F.min("doc_id").alias("least")), "near-copies")
    rows = saved(rows.join(copies, "copy"), "near-rows")
    own = signed.join(_small(saved(rows.where("row <> id").select("row"), "near-again")), "row", "left_anti")
    _, classes = near_links(own.select(F.col("row").alias("id"), "grams", "bands"), similarity)
    named = classes.join(copies, "id")
    lowest = named.groupBy("label").agg(F.min("least").alias("class_id"))
    linked = named.join(lowest, "label").select("id", "label", "class_id")
    known = rows.join(linked, "id", "left")
    return known.select("doc_id", "copy", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("label", "id").alias("class"), "row")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, class_id."""
    return near_classes(docs).select("doc_id", "class_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: of the least id, then of the least text digest; nothing else is dropped."""
    found = saved(near_classes(docs), "near-classes")
    best = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "copy", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    best = _small(saved(best.where("n > 1").drop("n"), "near-best"))
    gone = saved(found.join(best, "class").where("row <> best.row").select("doc_id", "copy", "class", F.col("best.doc_id").alias("best_id"), F.col("best.copy").alias("best_copy")), "near-gone")
    twin = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("copy") == F.col("best_copy"))
    key, other_id, other_key = unused(docs, "key", "other_id", "other_key")
    other = saved(gone.where(~twin).select(F.col("doc_id").alias(other_id), F.col("copy").alias(other_key)).distinct(), "near-others")
    keyed = docs.withColumn(key, F.unhex(F.md5(whole_text().cast("binary"))))
    kept = keyed.join(_small(other), F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key)), "left_anti")
    if gone.where(twin).limit(1).count():  # rows repeated whole: equal id and equal text
        kept = kept.dropDuplicates(["doc_id", key])
    return kept.select(*docs.columns)
