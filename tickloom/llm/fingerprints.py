"""Document fingerprints by consistent weighted sampling (operator 3), native.

A text's terms are its pairs of neighbouring words (its one word, if it has no more),
weighted ``1 + ln(count)``. Each term belongs to one of ``SAMPLES`` bins by its hash
and draws for it, as a function of term and bin alone, two Gamma(2, 1) variates
``r`` and ``c`` and a uniform ``beta``. With ``t = floor(ln(weight) / r + beta)`` and
``y = exp(r (t - beta))`` the bin keeps the term of least ``c / (y exp(r))`` and its
``t``. Two texts agree in a bin with the probability of the generalised Jaccard
similarity of the terms that fall to it. Bins that no term fell to borrow the sample of the
next filled one (densification), so that every text with a term has all ``SAMPLES`` samples; two
texts agree in a sample only where both took it from the same bin, which leaves the
probability as it is. Likeness is the share of agreeing samples. Splitting the terms among
the bins costs one draw a term in place of one a sample.

The edited text needs the next document, so rows are laid out in order in blocks of about
``BLOCK_ROWS``, whose starts are rows that a first, narrow pass over ids and text
hashes picks; the first row of each block is also sent to the block before it. Sparse ids and
ids or rows that repeat are dealt out like others.

Cases: null counts as empty; an empty text has no sample, is like an empty text (1) and
unlike any other (0); a null id counts as the least long, rows of equal ids come in order of a
hash of their text, equal rows as they are read; the last row's next is the first; one row is
its own next; other columns are ignored; an empty table makes no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, whole_text

SAMPLES = 64
BLOCK_ROWS = 1024
#: Most blocks: their starts become a constant of the plan. Beyond them blocks take more rows.
BLOCKS = 50_000
_UNIT = 1.0 / (1 << 21)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once: a lambda's body would repeat it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unit(h: Column, shift: int) -> Column:
    """A uniform draw of 21 of the hash's bits, inside (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0x1FFFFF).cast("long")).cast("double") + 0.5) * _UNIT


def _least(terms: Column) -> Column:
    """array<int>: the kept code of each filled sample; ``terms(k, rank, code)`` come with equal ``k`` side by side."""
    closed = lambda s: F.when(s["k"] < 0, s["out"]).otherwise(F.concat(s["out"], F.array(s["code"])))

    def step(s: Column, x: Column) -> Column:
        kept = F.struct(x["k"].alias("k"), x["rank"].alias("rank"), x["code"].alias("code"), s["out"].alias("out"))
        opened = F.struct(x["k"].alias("k"), x["rank"].alias("rank"), x["code"].alias("code"), closed(s).alias("out"))
        return F.when(x["k"] != s["k"], opened).when(x["rank"] < s["rank"], kept).otherwise(s)

    start = F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("rank"), F.lit(0).alias("code"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(terms, start, step, closed)


def weighted_samples(hashes: Column) -> Column:
    """array<int> of the samples of a multiset of term hashes, each with its number above 24 bits of (term, t)."""
    one = F.lit(1)

    def run_starts(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (F.get(s, i) != F.get(s, i - one)))

    def draw(s: Column, starts: Column) -> Column:
        counted = F.zip_with(
            F.slice(starts, one, F.size(starts) - 1), F.slice(starts, F.lit(2), F.size(starts) - 1), lambda a, b: F.struct(F.get(s, a).alias("h"), F.log(F.log((b - a).cast("double")) + 1.0).alias("lw"))
        )
        hashed = F.transform(counted, lambda x: F.struct(x["h"].alias("h"), x["lw"].alias("lw"), F.xxhash64(x["h"], F.lit(11)).alias("p"), F.xxhash64(x["h"], F.lit(13)).alias("q")))
        drawn = F.transform(
            hashed,
            lambda x: F.struct(
                x["h"].alias("h"), x["lw"].alias("lw"), (-F.log(_unit(x["p"], 0) * _unit(x["p"], 21))).alias("r"), F.log(-F.log(_unit(x["p"], 42) * _unit(x["q"], 0))).alias("lc"), _unit(x["q"], 21).alias("beta")
            ),
        )
        timed = F.transform(drawn, lambda x: F.struct(x["h"].alias("h"), x["r"].alias("r"), x["lc"].alias("lc"), x["beta"].alias("beta"), F.floor(x["lw"] / x["r"] + x["beta"]).alias("t")))
        return F.transform(
            timed,
            lambda x: F.struct(
                (F.shiftright(x["h"], 58) + 32).cast("int").alias("k"),  # rises with the sorted hashes
                (x["lc"] - x["r"] * (x["t"].cast("double") - x["beta"] + 1.0)).alias("rank"),
                ((F.shiftright(x["h"], 58) + 32) * 16777216 + F.xxhash64(x["h"], x["t"]).bitwiseAND(F.lit(0xFFFFFF).cast("long"))).cast("int").alias("code"),
            ),
        )

    drawn = _let(hashes, lambda s: F.when(F.size(s) > 0, _let(run_starts(s), lambda starts: _least(draw(s, starts)))).otherwise(F.array().cast("array<int>")))
    return drawn


def densified(samples: Column) -> Column:
    """All ``SAMPLES`` samples: an empty bin borrows from the next filled one, around the end; none of an empty text."""
    one, number = F.lit(1).cast("long"), F.lit(0).cast("long")

    def fill(mask: Column) -> Column:
        def at(i: Column) -> Column:
            turned = F.when(i == 0, mask).otherwise(F.call_function("shiftrightunsigned", mask, i).bitwiseOR(F.call_function("shiftleft", mask, 64 - i)))
            steps = F.when(turned == -(1 << 63), SAMPLES - 1).otherwise(F.bit_count(F.bitwise_not(turned).bitwiseAND(turned - one)))  # zeros below the lowest bit
            to = (i + steps) % SAMPLES
            return F.get(samples, F.bit_count(mask.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), to)))))

        return F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), at)

    filled = F.aggregate(samples, number, lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", one, F.shiftright(c, 24))))
    return F.when(F.size(samples) == SAMPLES, samples).when(F.size(samples) == 0, samples).otherwise(_let(filled, fill))


def fingerprint(text: Column) -> Column:
    """Samples of a text's weighted word pairs."""
    words = F.filter(F.split(F.translate(text, "\n\r\t", "   "), " "), lambda w: w != "")
    pairs = lambda ws: F.zip_with(F.slice(ws, F.lit(1), F.size(ws) - 1), F.slice(ws, F.lit(2), F.size(ws) - 1), lambda a, b: F.xxhash64(a, b))
    hashes = _let(words, lambda ws: F.sort_array(F.when(F.size(ws) > 1, pairs(ws)).otherwise(F.transform(ws, lambda w: F.xxhash64(w)))))
    return _let(weighted_samples(hashes), densified)


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing samples; 1 for two empty texts, 0 for one."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / F.lit(float(SAMPLES)))


def as_string(samples: Column) -> Column:
    """Eight hexadecimal digits for each sample."""
    return F.array_join(F.transform(samples, lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")), "")


def _key() -> list[Column]:
    """The order of rows: id, text hash, place in the input."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(whole_text()).alias("k2"), F.monotonically_increasing_id().alias("k3")]


def block_starts(docs: DataFrame) -> list[tuple[int, int, int]]:
    """Keys of the first rows of blocks, in order; the first is the first row's. At most about ``BLOCKS``."""
    ranges = partitions(docs.sparkSession)
    rows = docs.count()
    if not rows:
        return []
    step = max(BLOCK_ROWS, -(-rows // BLOCKS))
    keys = docs.select(*_key()).repartitionByRange(max(1, min(ranges, rows // step)), "k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3")
    found = keys.withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).where(F.col("at") % step == 0)
    return sorted((r["k1"], r["k2"], r["k3"]) for r in found.select("k1", "k2", "k3").collect())


def with_next(docs: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """doc_id, text and ``carried``, each also of the next row by id as ``next_*`` (after the last: the first)."""
    starts = block_starts(docs)
    n = max(1, len(starts))
    first, second, third = (F.split(F.lit(",".join(str(s[k]) for s in starts) or "0"), ",").cast("array<long>") for k in range(3))
    k1, k2, k3 = (F.col(f"k{i}") for i in (1, 2, 3))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"] + 1, 1)
        a, b, c = (F.get(x, middle) for x in (first, second, third))
        after = (a < k1) | ((a == k1) & ((b < k2) | ((b == k2) & (c <= k3))))
        return F.struct(F.when(after, middle).otherwise(s["lo"]).alias("lo"), F.when(after, s["hi"]).otherwise(middle - 1).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(max(1, (n - 1).bit_length())))
    block = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi")), lambda s, i: F.when(s["lo"] < s["hi"], halve(s, i)).otherwise(s), lambda s: s["lo"])
    full = docs.select("doc_id", whole_text().alias("text"), *_key()).withColumns(carried).withColumn("block", block)
    opens = (k1 == F.get(first, F.col("block"))) & (k2 == F.get(second, F.col("block"))) & (k3 == F.get(third, F.col("block")))
    homes = F.array_compact(F.array(F.struct(F.col("block").alias("to"), F.lit(0).alias("guest")), F.when(opens, F.struct(((F.col("block") + n - 1) % n).alias("to"), F.lit(1).alias("guest")))))
    sent = full.withColumn("home", F.explode(homes)).select("doc_id", "text", "k1", "k2", "k3", *carried, "home.to", "home.guest")
    following = Window.partitionBy("to").orderBy("guest", "k1", "k2", "k3")
    return sent.withColumns({f"next_{c}": F.lead(c).over(following) for c in ("text", *carried)}).where("guest = 0").drop("to", "guest", "k1", "k2", "k3")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs, {"own": fingerprint(F.col("text"))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "own", "next_own", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("changed"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("own")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next")
    )
