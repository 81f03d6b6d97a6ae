"""The training-data operators against brute force on small tables with nulls, ties, copies and empty texts."""

import hashlib
import io
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import decontamination, fingerprints, mixing, near_dup, quality, secrets, sharding, token_counts, token_frames, toxicity
from tickloom.llm.labelled import fold

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id long, toxic_score string"
WORDS = "the of and then stone river light green walk over under bridge small large house window door table paper silver".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed"]) + str(rng.randint(0, 40)) * (rng.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = [sentence(rng, rng.randint(5, 120)) for _ in range(60)]
    near = out[3].split()
    near[20 % len(near)] = "changed"
    out += [out[3], out[3], " ".join(near), "", None, "one", "  two  words \n", "é中😀 mixed text, with\tmarks.", "x" * 5000, "w " * 3000, sentence(rng, 4000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en", [None, "a", "b", "c"][i % 4] if i % 3 else "a", None, 7, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_frames(docs, empty, texts):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got, start = by_id(token_frames.token_files(docs, path)), 0
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        r = got[i * 3]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_frames.token_files(empty, path).count() == 0


def test_token_frames_decompress_only_what_is_asked():
    out = io.BytesIO()
    writer = token_frames.FrameWriter(out, frame_bytes=64)
    ids = [np.arange(k, k + n, dtype="<u4").tobytes() for k, n in ((0, 5), (1, 100), (2, 0), (3, 7), (4, 30))]
    for k, x in enumerate(ids):
        writer.add(k if k != 2 else None, x)
    writer.close()
    reader = token_frames.FrameReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert reader.ids(3) == ids[3] and reader.decompressed <= 2
    assert [reader.ids(k) for k in range(5)] == ids and reader.null.tolist() == [False, False, True, False, False]
    broken = bytearray(out.getvalue())
    broken[20] ^= 1
    with pytest.raises(Exception):
        bad = token_frames.FrameReader(io.BytesIO(bytes(broken)), len(broken))
        [bad.ids(k) for k in range(5)]


def test_prefix_counts(docs, empty, texts):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(token_counts.token_counts(docs, path, limit=50))
    for i, text in enumerate(texts):
        assert got[i * 3]["n_tokens"] == len(sp.encode(text or ""))
        assert got[i * 3]["n_bytes"] == len((text or "").encode())
    counter = token_counts.counter(path)
    rng = random.Random(1)
    for _ in range(150):
        s = "".join(rng.choice("ab \n\t.,é中😀▁ the<s>") for _ in range(rng.randint(0, 24)))
        table = counter.table(s)
        assert table.tolist() == [len(sp.encode(s[:k])) for k in range(len(s) + 1)]
        assert counter.fit(s, 3) == max(k for k, n in enumerate(table) if n <= 3)
    assert token_counts.token_counts(empty, path).count() == 0


def jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, docs, empty, texts):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(texts)
    slots = {}
    for r in got:
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 24), jump(r["doc_id"], 25))
        text = (texts[r["doc_id"] // 3] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(empty).count() == 0
    hard = spark.createDataFrame([(k,) for k in (-1, 0, 1, -(1 << 63), (1 << 63) - 1, 123456789012345)], "k long")
    for r in hard.select("k", sharding.jump_hash(hard["k"], 1000).alias("j")).collect():
        assert (r["j"]["shard"], r["j"]["grown"]) == (jump(r["k"], 1000), jump(r["k"], 1001))


def test_sharding_repeated_rows(spark):
    rows = spark.createDataFrame([(5, "same")] * 50 + [(None, None)] * 3, "doc_id long, text string")
    got = sharding.shard_documents(rows).collect()
    assert sorted(r["slot"] for r in got if r["doc_id"] == 5) == list(range(50))
    assert {r["shard"] for r in got if r["doc_id"] is None} == {jump(0, 24)}


def test_mixing(docs, empty, texts):
    got = mixing.mix_words(docs, block_words=16).collect()
    assert len(got) == len(texts)
    sizes, sources = {}, {}
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"] // 3] or ""))
        assert r["size"] == n and 0 <= r["taken"] <= 3 * n
        sizes.setdefault(r["source"], []).append(n)
        sources.setdefault(r["source"], []).append(r)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    total, target, open_ = sum(map(sum, sizes.values())), {}, dict(zip(order, [1, 2, 3, 1]))
    left = total
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * sum(sizes[s])]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sum(sizes[s])
            left -= target[s]
            del open_[s]
    for s, rows in sources.items():
        assert rows[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in rows) - target[s]) <= 1
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_words(docs, block_words=16).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert mixing.mix_words(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mix_schedule_is_even(spark):
    targets = spark.createDataFrame([(0, "a", 4000, 1000.0), (1, "b", 4000, 3000.0)], "src int, source string, source_size long, target double")
    slots = sorted((r["slot"], r["src"], r["rank"]) for r in mixing.schedule(targets, 10).collect())
    for source, n in ((0, 100), (1, 300)):
        assert sorted(k for _, s, k in slots if s == source) == list(range(n))
    for end in range(40, 400, 40):
        assert abs(sum(s == 0 for t, s, _ in slots if t < end) - end / 4) <= 3


def generalised_jaccard(a, b):
    def weights(text):
        w = [x for x in re.split(r"[ \n\r\t]", text) if x]
        counts = Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)
        return {k: 1 + math.log(n) for k, n in counts.items()}

    x, y = weights(a), weights(b)
    low, high = (sum(f(x.get(k, 0), y.get(k, 0)) for k in x.keys() | y.keys()) for f in (min, max))
    return low / high if high else 1.0


def test_fingerprints(docs, empty, texts):
    got, error = by_id(fingerprints.fingerprints(docs)), []
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i * 3]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        error.append(r["near_edited"] - generalised_jaccard(text, edited))
    assert abs(float(np.mean(error))) < 0.03 and max(map(abs, error)) < 0.35
    assert got[9]["fingerprint"] == got[180]["fingerprint"] == got[183]["fingerprint"]
    assert all(len(got[i * 3]["fingerprint"]) == 8 * 64 * bool((t or "").split()) for i, t in enumerate(texts))
    assert fingerprints.fingerprints(empty).count() == 0
    one = docs.where("doc_id = 9")
    assert fingerprints.fingerprints(one).first()["near_next"] == 1.0


def test_samples_equal_their_definition(spark):
    """Draws, least terms and borrowed bins, worked out one by one from Spark's hashes."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    texts = [sentence(rng, n) for n in (2, 3, 9, 40, 400)] + ["w " * 50 + "x", "one"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprints.fingerprint(F.col("t")).alias("f")).collect()
    terms = [list(zip(w, w[1:])) if len(w) > 1 else [tuple(w)] for w in (t.split() for t in texts)]
    flat = sorted({x for ts in terms for x in ts})
    pairs = spark.createDataFrame([(i, x[0], x[1] if len(x) > 1 else None) for i, x in enumerate(flat)], "i int, a string, b string")
    h = F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("a", "b"))
    drawn = {flat[r["i"]]: r for r in pairs.withColumn("h", h).select("i", "h", F.xxhash64("h", F.lit(11)).alias("p"), F.xxhash64("h", F.lit(13)).alias("q")).collect()}
    unit = lambda x, shift: (((x % 2**64) >> shift & 0x1FFFFF) + 0.5) / 2**21
    times = {}
    for ts in terms:
        for x, n in Counter(ts).items():
            d = drawn[x]
            r = -math.log(unit(d["p"], 0) * unit(d["p"], 21))
            times[x, n] = math.floor(math.log(1 + math.log(n)) / r + unit(d["q"], 21)), r
    keys = spark.createDataFrame([(drawn[x]["h"], t, i) for i, ((x, n), (t, _)) in enumerate(times.items())], "h long, t long, i int")
    codes = dict(zip(times, [r["c"] % 2**24 for r in keys.select("i", F.xxhash64("h", "t").alias("c")).orderBy("i").collect()], strict=True))
    for row, ts in zip(got, terms, strict=True):
        bins = {}
        for x, n in Counter(ts).items():
            d, (t, r) = drawn[x], times[x, n]
            k = (d["h"] >> 58) + 32
            rank = math.log(-math.log(unit(d["p"], 42) * unit(d["q"], 0))) - r * (t - unit(d["q"], 21) + 1)
            bins[k] = min(bins.get(k, (math.inf, 0)), (rank, codes[x, n]))
        want = []
        for i in range(64):
            k = next(j % 64 for j in range(i, i + 64) if j % 64 in bins)
            want.append((k << 24) + bins[k][1])
        assert [c % 2**32 for c in row["f"]] == want


def test_next_document_of_sparse_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 8)
    rng = random.Random(2)
    rows = [(i, f"text {i}") for i in range(40)] + [(10**15, "far"), (-5, "low"), (None, "none")] + [(7, f"hot {rng.random()}") for _ in range(60)] + [(9, "same")] * 30
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, text string, block string, k1 int")
    got = fingerprints.with_next(docs, {}).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, rows))
    after = {}
    for r in got:
        after.setdefault(r["text"], []).append(r["next_text"])
    assert sorted(x for v in after.values() for x in v) == sorted(t for _, t in rows)  # each is the next of one
    assert after["none"] == ["low"] and after["low"] == ["text 0"] and after["far"] == ["none"] and after["text 5"] == ["text 6"]
    assert after["same"].count("same") >= 28 and len(fingerprints.block_starts(docs)) > 8


def weighted_set(text):
    """Shingles of five words, each as often as the bit length of its count."""
    words = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(words))
    counts = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else {}
    return {(k, i) for k, c in counts.items() for i in range(c.bit_length())}


def test_near_duplicates(docs, empty, texts):
    sets = [weighted_set(t) for t in texts]
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        for a in range(len(texts)):
            for b in range(a):
                union = len(sets[a] | sets[b])
                if (texts[a] or "") == (texts[b] or "") or (union and len(sets[a] & sets[b]) / union >= 0.8):
                    label[a] = label[b] = min(label[a], label[b])
    got = by_id(near_dup.near_duplicates(docs))
    assert {k: r["class_id"] for k, r in got.items()} == {i * 3: c * 3 for i, c in enumerate(label)}
    kept = sorted(r["doc_id"] for r in near_dup.without_near_duplicates(docs).collect())
    assert kept == sorted({c * 3 for c in label})
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.without_near_duplicates(empty).count() == 0


def test_large_near_group(spark):
    rng = random.Random(5)
    base = sentence(rng, 200).split()
    rows = []
    for i in range(120):
        words = list(base)
        words[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(200, sentence(rng, 200)), (201, "again"), (201, "again"), (None, "null id"), (202, "null id")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got if r["doc_id"] is not None and r["doc_id"] < 120} == {0}
    assert {r["class_id"] for r in got if r["doc_id"] in (None, 202)} == {202}
    assert near_dup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4


def test_dart_signs_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    ids = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rng.uniform(0.2, 6, 300), rng.uniform(0.2, 6, 300)
    a[:60], b[-60:] = 0, 0
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = np.mean(near_dup.dart_signs(ids, a, 4096) == near_dup.dart_signs(ids, b, 4096))
    assert got == pytest.approx(want, abs=0.035)
    assert (near_dup.dart_signs(ids[:1], k=64) == near_dup.dart_signs(ids[:1], k=64)).all()


def test_secrets(spark, empty):
    rows = [
        (0, "é password=abcdef1 and TOKEN: 'x' then api_key = \"Zz09+/=._-\" end"), (1, "AKIA" + "B" * 16 + " AKIASHORT " + "0123456789abcdef" * 2), (2, None), (3, ""),
        (4, "client_secret -> q8Zx1Lw0Tn5Vr7Ys2Kd9Pb4M and client_secret -> xxxxxxxxxxxxxxxxxxxxxxx1"), (5, "ſecret=abcdefgh"),
    ]
    got = by_id(secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(got[k]["n_assign"], got[k]["n_access"], got[k]["n_hex"]) for k in range(6)] == [(2, 0, 0), (0, 1, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert got[0]["spans"].startswith("assign:2:18,assign:39:")
    assert got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[1]["base_sha256"] == hashlib.sha256(b"access:0:20,hex:31:63").hexdigest()
    assert got[4]["spans"] == "novel:17:41"
    assert secrets.secrets(empty).count() == 0


def test_tiling():
    a = [1, 2, 3, 4, 5, 9, 9, 6, 7, 8, 10, 11, 1, 2, 3]
    b = [6, 7, 8, 10, 11, 1, 2, 3, 4, 5]
    assert decontamination.tile(a, b, 3) == [(7, 0, 8)]
    assert sorted(decontamination.tile([6, 7, 8, 0, 1, 2, 3, 4], [1, 2, 3, 4, 6, 7, 8], 3)) == [(0, 4, 3), (4, 0, 4)]
    rng = random.Random(3)
    for _ in range(400):
        x, y = [rng.randint(0, 4) for _ in range(rng.randint(0, 20))], [rng.randint(1, 4) for _ in range(rng.randint(1, 15))]
        assert sorted(decontamination.tile(x, y, 3)) == sorted(plain_tiles(x, y, 3))


def plain_tiles(a, b, least):
    """Greedy string tiling letter by letter: all runs of the greatest length from left to right, then the next length."""
    used_a, used_b, tiles = [v == 0 for v in a], [v == 0 for v in b], []
    while True:
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                best = max(best, n)
        if best < least:
            return tiles
        for i in range(len(a) - best + 1):
            for j in range(len(b) - best + 1):
                if a[i : i + best] == b[j : j + best] and not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                    used_a[i : i + best] = used_b[j : j + best] = [True] * best
                    tiles.append((i, j, best))
                    break


def test_junk_texts_take_linear_time():
    began = time.process_time()
    own = decontamination.Benchmark([(1, "word " * 2000), (2, "word other " * 500)])
    assert own.best("word " * 20_000, 0.5)[:2] == (1, 1.0)
    novelty = secrets.Novelty()
    for text in ("token key " * 100_000, "secret " + "a" * 200_000 + "1", "tokentoken" * 100_000, "token=x " * 100_000, "key_" * 200_000):
        secrets.scan(text, novelty)
    assert time.process_time() - began < 10


def test_decontamination_does_not_depend_on_blocks(spark):
    rng = random.Random(4)
    item = sentence(rng, 30)
    bench = spark.createDataFrame([(9 - i, item.upper() if i % 2 else item) for i in range(8)] + [(20, item + " more"), (None, sentence(rng, 30))], "item_id long, text string")
    docs = spark.createDataFrame([(1, item, 7, 0.25), (1, item, 7, 0.25), (None, "clean", None, 1.0)], "doc_id long, text string, _id long, score double")
    whole, parts = (sorted(map(tuple, decontamination.tile_documents(docs, bench, block_chars=n).collect()), key=str) for n in (10**9, 150))
    assert whole == parts == [(1, item, 7, 0.25, 2, 1.0, 2), (1, item, 7, 0.25, 2, 1.0, 2), (None, "clean", None, 1.0, None, 0.0, 0)]
    with pytest.raises(ValueError):
        decontamination.tile_documents(docs.withColumn("ITEMS", docs["_id"]), bench)


def plain_secrets(text):
    """The base rules, character by character."""
    spans, n = [], len(text)
    small = lambda c: c.lower() if c.isascii() else c
    low = "".join(map(small, text))
    i = 0
    while i < n:
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, i):
                j = i + len(name)
                j += j < n and text[j] in "\"'"
                while j < n and text[j] == " ":
                    j += 1
                if j < n and text[j] in ":=":
                    j += 1
                    while j < n and text[j] == " ":
                        j += 1
                    j += j < n and text[j] in "\"'"
                    k = j
                    while k < n and (text[k].isascii() and text[k].isalnum() or text[k] in "+/_.=-"):
                        k += 1
                    if k > j:
                        if k - j >= 6:
                            spans.append((i, 0, k))
                        i = k - 1
                        break
        i += 1
    for kind, head, inside, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        i = 0
        while i < n:
            k = i + len(head)
            while text.startswith(head, i) and k < n and text[k] in inside:
                k += 1
            if k > i + len(head) and k - i >= least:
                spans.append((i, kind, k))
            i = max(k, i + 1) if k > i + len(head) else i + 1
    return sorted(spans)


def test_base_spans_equal_plain_scan():
    rng = random.Random(6)
    pieces = ["password", "PassWD", "secret", "Token", "api_key", "APIKEY", "apikeys", " ", "  ", ":", "=", "'", '"', "abc", "Z9+/_.=-", "AKIA", "ABCDEF123456", "0123456789abcdef", "deadbeef", "é", "ſ", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == plain_secrets(text), text


def test_novelty_is_the_bytes_a_candidate_adds(spark):
    """Spans of the scan are those whose compressed surroundings grow enough, worked out here with fresh compressors."""
    import zstandard

    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows = []
    for i in range(60):
        value = "".join(rng.choice(letters) for _ in range(rng.randint(12, 32))) if i % 2 else "some_identifier" * 2
        rows.append((i, f"{sentence(rng, 8)}\nthe bearer value is {value}, {sentence(rng, 5)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dictionary = secrets.corpus_dictionary(docs)
    assert dictionary.startswith(secrets.DICTIONARY)
    got = by_id(secrets.secrets(docs))
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = lambda x: len(zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress(x.encode()))
    for i, text in rows:
        base, want = plain_secrets(text), []
        for m in re.finditer("[A-Za-z0-9+/_=-]{12,}", text):
            if text.rfind("\n", 0, m.start()) < text.find("bearer") and m.start() < text.find("bearer"):
                continue
            around = text[max(0, m.start() - 256) : m.start()] + text[m.end() : m.end() + 256]
            grown = size(around + m[0]) - size(around)
            plain = re.fullmatch(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{3,}|[-_/+=])+", m[0])
            if not plain and grown >= 9 and grown >= 0.62 * len(m[0]) and not any(a < m.end() and m.start() < b for a, _, b in base):
                want.append((m.start(), 3, m.end()))
        assert got[i]["spans"] == secrets.joined(sorted(base + want)), text
    assert sum(r["n_novel"] for r in got.values()) >= 25


def test_decontamination(spark, docs, empty, texts):
    rng = random.Random(8)
    item = sentence(rng, 30)
    words = item.split()
    moved = " ".join(words[15:] + ["between"] + words[:15])
    rows = [(0, f"{texts[0]} {item.upper()}, {texts[1]}"), (1, moved), (2, " ".join(words[:8])), (3, None), (4, texts[2])]
    bench = spark.createDataFrame([(5, item), (6, item), (7, None), (8, "short one"), (None, "x")], "item_id long, text string")
    got = by_id(decontamination.decontamination(spark.createDataFrame(rows, "doc_id long, text string"), bench))
    assert [got[k]["contaminated"] for k in range(5)] == [True, True, False, False, False]
    assert got[0]["item_id"] == 5 and got[0]["coverage"] == 1.0 and got[1]["coverage"] == 1.0
    assert decontamination.decontamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.decontamination(docs, bench.where("false")).collect())


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(600):
        toxic, poor = i % 5 == 0, i % 4 == 0
        words = sentence(rng, rng.randint(20, 60)).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["villain", "rascal"]))
        text = " ".join(w.upper() + "!!" for w in words) if poor else " ".join(words) + "."
        rows.append((i, text))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(1000, "you v1lla1n"), (1001, "such a r-a-s-c-a-l"), (1002, "raaascal"), (1003, None), (1004, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (9999, None, None)], "doc_id long, quality int, toxic int"), labels


def test_toxicity(labelled, empty):
    docs, labels, truth = labelled
    got = by_id(toxicity.toxicity(docs, labels))
    held = [(got[i]["predicted"], t) for i, _, t in truth if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in truth)
    assert np.mean([p == t for p, t in held]) > 0.97
    assert [got[k]["predicted"] for k in range(1000, 1005)] == [1, 1, 1, 0, 0]
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.0}


def test_restore_equals_all_paths():
    """The Viterbi word is the best of all readings of the lattice, enumerated."""
    rng = random.Random(5)
    model = toxicity.CharModel({"idiot": 5, "stone": 9, "tone": 4, "toot": 2, "is": 7, "sit": 6})

    def readings(token):
        paths, last = [(0.0, "")], ""
        for c in token:
            if c.isalpha():
                ways = [(c, 0.0)] + [("", toxicity.SKIP)] * (c == last)
            elif c == "*" and c != last:
                ways = [(x, toxicity.WILD) for x in model.letters] + [("", toxicity.DROP)]
            else:
                ways = [(x, toxicity.SWAP) for x in toxicity.LOOKS.get(c, "")] + [("", toxicity.DROP if c in toxicity.SEPARATORS or c == last else toxicity.LOSE)]
            last = c
            paths = [(cost + more, text + x) for cost, text in paths for x, more in ways]
        for cost, text in paths:
            padded = f"^^{text}"
            yield cost + sum(model.log(padded[k : k + 2], (text + "$")[k]) for k in range(len(text) + 1)), text

    for _ in range(200):
        token = "".join(rng.choice("idiotsn10-*!7#") for _ in range(rng.randint(1, 7)))
        best = max(readings(token))
        assert max(x for x, t in readings(token) if t == toxicity.restore(token, model)) == pytest.approx(best[0]), token


def test_words_hidden_in_other_ways():
    plain = "the you are such an what that this is stone river light green walk over under bridge so".split()
    model = toxicity.ToxicModel({w: 0.99 for w in "villain rascal scoundrel oaf".split()}, {w: 50 for w in plain} | {w: 9 for w in "villain rascal scoundrel oaf ton rig".split()})
    for text in ("an 0af", "v1lla1n+", "rasc*l", "sco-undrel", "ras.cal", "vil lain", "raaa" + "a" * 70 + "scal", "y o u r a s c a l s c o u n d r e l", " ".join("youaresuchanoafwhatthatthisisvillainthestoneriverwalkover")):
        assert model.score(text) > 0.9, text
    for text in ("the stone bridge", "over-under the (2nd) bridge, 3 rivers!", "t h e s t o n e r i v e r", "", "7" * 500, "a1b2" * 300):
        assert model.score(text) == 0.0, text
    began = time.process_time()
    for text in ("x5" * 100_000, "a b c d " * 25_000, "a" * 500_000, "!*(0" * 50_000, "a-b-" * 50_000):
        model.score(text)
    assert time.process_time() - began < 20


def test_labelled_rows_are_bounded(spark):
    from tickloom.llm.labelled import labelled_sample
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "same")] * 300 + [(1, f"text {i}") for i in range(200)] + [(2, "other"), (3, "third one"), (4, "third one")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    assert labelled_sample(docs, labels, "quality", F.lit(True), 1).count() == 1
    assert sorted(map(tuple, labelled_sample(docs.where("text <> 'same'"), labels, "quality", F.lit(True), 10).where("text NOT LIKE 'text%'").collect())) == [(0, "other"), (0, "third one"), (1, "third one")]
    copies = [labelled_sample(docs.repartition(n), labels, "quality", F.lit(True), 10, once=True).where("text = 'third one'").collect() for n in (1, 3)]
    assert copies[0] == copies[1] and len(copies[0]) == 1


def test_counts_of_marks_and_fractions():
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    sp, counter, rng = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.counter(path), random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("m²³¹½¼ªº.,;:!?|'\"-ab éß 中の😀\n\t 12٣ⅳ①̈́’“”…·") for _ in range(rng.randint(0, 7)))
        counts = counter.boundaries(text)[1]
        assert (int(counts[-1]) if len(counts) else 0) == len(sp.encode(text)), text


def test_quality(labelled, empty):
    docs, labels, truth = labelled
    got = by_id(quality.quality(docs, labels))
    held = [(got[i]["predicted"], q) for i, q, _ in truth if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in truth)
    assert np.mean([p == q for p, q in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.quality(empty, labels).count() == 0 and quality.quality(docs, labels.where("false")).count() == 605


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    m = quality.FactorMachine(0.3, rng.normal(size=quality.INPUTS).astype(np.float32), rng.normal(size=(quality.INPUTS, quality.FACTORS)).astype(np.float32))
    at, x = np.array([3, 17, 900, 8200]), np.array([0.5, 1.0, 2.0, 1.0], np.float32)
    pairs = sum(float(m.factors[at[i]] @ m.factors[at[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.margin(at, x) == pytest.approx(0.3 + float(m.weights[at] @ x) + pairs, rel=1e-4)


def test_fold_of_null_id(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(fold(3).alias("f")).first()["f"] == 0


def test_pipeline(spark, tmp_path, labelled, docs):
    import corpus_pipeline

    own, labels, _ = labelled
    rng = random.Random(2)
    item = sentence(rng, 30)
    extra = spark.createDataFrame([(2000, item + " " + sentence(rng, 20)), (2001, "you rascal there"), (2002, "copied text of six plain words"), (2003, "copied text of six plain words")], "doc_id long, text string")
    from pyspark.sql import functions as F

    full = own.union(extra).select("doc_id", "text", F.lit("en").alias("lang"), (F.col("doc_id") % 3).cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    full.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out.cache()
        seen[name] = {r["doc_id"] for r in docs.collect()}
    assert 2001 not in seen["toxicity"] and {1000, 1001, 1002}.isdisjoint(seen["toxicity"]) and 1003 in seen["toxicity"]
    assert 2002 in seen["near_duplicates"] and 2003 not in seen["near_duplicates"]
    assert 2000 in seen["near_duplicates"] and 2000 not in seen["decontamination"]
    assert seen["near_duplicates"] - seen["decontamination"] == {2000}
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in result} <= seen["decontamination"] and len(result) > 0
    kept = docs
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix_words(kept).collect()}
    times = Counter(r["doc_id"] for r in corpus_pipeline.mixing(spark, kept, str(tmp_path)).collect())
    assert times == {k: n for k, (t, size) in taken.items() if (n := math.floor(t / size + 0.5) if size else 1)}
    assert Counter(r["doc_id"] for r in result) == times
    slots = {}
    for r in result:
        assert r["shard"] == jump(r["doc_id"], 24) and r["grown_shard"] == jump(r["doc_id"], 25)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_pipeline_of_clashing_columns_and_empty_tables(spark, tmp_path, labelled):
    import corpus_pipeline
    from pyspark.sql import functions as F

    own, labels, _ = labelled
    names = ["_id", "_key", "_copy", "_t", "_tie", "_nth", "_times", "_k", "key", "row", "copy", "toxic_score", "coverage", "items", "size", "n"]
    full = own.where("doc_id % 7 = 0").unionAll(own.where("doc_id = 14")).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("n_chars"), F.lit(7).cast("long").alias("item_id"), *[F.lit(n).alias(n) for n in names])
    for name, docs in (("some", full), ("none", full.where("false"))):
        at = f"{tmp_path}/{name}"
        docs.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, "one two three four five six")] * (name == "some"), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        before = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, at)
            assert docs.columns == full.columns
            assert all(r["item_id"] == 7 and all(r[n] == n for n in names) for r in docs.collect())
        assert docs.count() <= before and (name == "none") == (corpus_pipeline.run(spark, at).count() == 0)


def test_near_links_of_large_buckets_equal_brute_force(spark):
    """Texts that share a passage fill large buckets; links between them are rare, and none is lost."""
    rng = random.Random(8)
    sets = []
    for i in range(700):
        rare = [10_000 + i * 100 + k for k in range(14)]
        sets.append([*range(86), *rare])  # 0.754 to any other
    for i in range(0, 80, 2):
        sets[i + 1] = [*range(86), *sets[i][86:90], *sets[i + 1][90:]]  # 0.818 to the one before
    rng.shuffle(sets)
    rows = [(i, x, [1 if i < 600 else 2, i % 3]) for i, x in enumerate(sets)]  # one bucket takes several blocks
    links, classes = near_dup.near_links(spark.createDataFrame(rows, "id long, grams array<int>, bands array<long>"))
    own = [set(x) for x in sets]
    want = {(a, b) for b in range(700) for a in range(b) if set(enumerate(rows[a][2])) & set(enumerate(rows[b][2])) and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])}
    assert len(want) > 30 and {(r["a"], r["b"]) for r in links.collect()} == want
    assert {(r["id"], r["label"]) for r in classes.collect()} == {x for a, b in want for x in ((a, a), (b, a))}


def test_template_group_classes_equal_brute_force(spark):
    """Texts that share a template about 0.7 alike, a few pairs above 0.8: every class that brute force finds."""
    rng = random.Random(12)
    template = sentence(rng, 120).split()
    texts = []
    for i in range(160):
        words = list(template)
        words[(at := rng.randrange(0, 90)) : at + 22] = sentence(rng, 22).split()
        texts.append(" ".join(words))
        if i % 16 == 0:
            words[3] = f"other{i}"
            texts.append(" ".join(words))
    texts += [texts[0] + " " + texts[0], " ".join(template), "again and again " * 40, "again and again " * 45]
    sets = [weighted_set(t) for t in texts]
    label = list(range(len(texts)))
    links = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert 10 < len(set(label)) < len(texts) - 10
    assert [got[i]["class_id"] for i in range(len(texts))] == label


def test_near_duplicates_keep_clashing_columns(spark):
    rows = [(1, "one two three four five six", "a", 1, 2), (2, "one two three four five six", "b", 3, 4), (3, "something else", "c", 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, key int, other_id int")
    assert sorted(map(tuple, near_dup.without_near_duplicates(docs).collect()))[1] == rows[2]
    assert sorted(r["_id"] for r in near_dup.without_near_duplicates(docs).collect()) == ["a", "c"]


def test_secrets_of_letters_or_digits_anywhere_in_the_line(spark):
    key, digits, mixed = "qXvZkWjRtBnMpLsGhYdC", "7391846205518273649028", "q8Zx1Lw0Tn5Vr7Ys2Kd9Pb4M"
    filler = "and the rest of this long line goes on with plain words about rivers and bridges "
    texts = [f"bearer {key}", f"client secret is {digits}", f"{key} is the bearer value", f"token {filler}{filler}{mixed}", f"{filler}{key}", f"{key}\n{filler} token", "the token responsibilities of administrators"]
    got = by_id(secrets.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i in range(4):
        hidden = (key, digits, key, mixed)[i]
        at = texts[i].index(hidden)
        assert (i, got[i]["n_novel"], got[i]["spans"]) == (i, 1, f"novel:{at}:{at + len(hidden)}")
    assert [got[i]["n_novel"] for i in (4, 5, 6)] == [0, 0, 0]


def test_benchmark_items_without_an_id(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(None, passage), (None, "alpha beta gamma delta epsilon zeta eta theta"), (3, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    rows = spark.createDataFrame([(0, f"before {passage} after"), (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "clean words only")], "doc_id long, text string")
    got = {k: (r["contaminated"], r["item_id"], r["coverage"], r["items"]) for k, r in by_id(decontamination.decontamination(rows, bench)).items()}
    assert got == {0: (True, None, 1.0, 1), 1: (True, 3, 1.0, 1), 2: (False, None, 0.0, 0)}
