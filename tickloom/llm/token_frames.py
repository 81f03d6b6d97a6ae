"""Token ids in seekable zstandard files (operator 1).

A file holds independent zstandard frames of little-endian uint32 ids (about
``FRAME_BYTES`` each, content checksum on), then one skippable frame with the
document index, then the seek table of the public seekable format: per frame its
compressed size, its plain size and a 32-bit checksum, closed by a fixed footer. A
reader loads footer, table and index and then decompresses only the frames that
overlap the documents it wants.

Cases: a null text counts as empty and has only the end id; null ids sort first;
rows with equal ids are ordered by a hash of their text; an empty table makes no
file and no row.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, scratch, whole_text

FRAME_BYTES = 1 << 18
LEVEL = 3
# Fixed values of the public seekable zstandard format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
#: Our document index sits in another skippable frame.
INDEX = 0x184D2A50
#: Entries of one generation of a worker's parts and of its words; two generations are kept.
CACHE = 900_000

_ENCODERS: dict[tuple[str, int], "CachedEncoder"] = {}
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = ".,;:!?|"


class CachedEncoder:
    """Ids of whole texts by the tokenizers library, each distinct part encoded once.

    Holds for tokenizers that drop white space and never join across it (checked on
    loading): the ids of a text are those of its parts between blanks, one after
    another. Parts of plain letters are lower-cased and split from trailing marks as
    the tokenizer itself does; every other part goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex", "") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        strips = any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec["added_tokens"])
        self.by_part = kinds == ["NFC", "Replace", "Lowercase"] and r"[^\s\p{L}\p{N}]+" in split[:1][0] and not strips and spec["post_processor"] is None
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts: dict[str, bytes] = {"": b""}
        self.known: dict[str, bytes] = {"": b""}
        self.old_parts: dict[str, bytes] = {}
        self.old_known: dict[str, bytes] = {}

    def _learn_words(self, words: list[str]) -> None:
        known = self.known
        for at in range(0, len(words), 1000):
            block = words[at : at + 1000]
            found = self.words.encode(block, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(found.ids, dtype="<u4").tobytes()
            starts = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(block) + 1))).tolist()
            known.update(zip(block, [raw[a:b] for a, b in zip(starts, starts[1:])], strict=True))

    def _learn(self, new: set[str]) -> None:
        """Fills ``parts`` for ``new``; what the generation before knew is taken over, not encoded again."""
        parts, old = self.parts, self.old_parts
        if old:
            again = new & old.keys()
            parts.update({part: old[part] for part in again})
            new = new - again
        plain, rest = [], []
        for part in new:
            word = part.rstrip(_MARKS)
            if word.isalpha() and (word.isascii() or _LETTERS.fullmatch(word)):
                plain.append((part, word.lower(), part[len(word) :]))
            else:
                rest.append(part)
        if len(self.known) > CACHE:
            self.old_known, self.known = self.known, {"": b""}
        known, old = self.known, self.old_known
        missing = {x[1] for x in plain}.union([x[2] for x in plain]).difference(known)
        if old:
            again = missing & old.keys()
            known.update({x: old[x] for x in again})
            missing -= again
        self._learn_words(list(missing))
        parts.update({part: known[word] + known[marks] if marks else known[word] for part, word, marks in plain})
        for at in range(0, len(rest), 512):
            block = rest[at : at + 512]
            for part, found in zip(block, self.whole.encode_batch_fast(block, add_special_tokens=False), strict=True):
                parts[part] = np.array(found.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian uint32 ids of each text."""
        if not self.by_part:
            for text in texts:
                yield np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            return
        for at in range(0, len(texts), 256):
            split = [x.replace("\n", " ").split(" ") for x in texts[at : at + 256]]
            if len(self.parts) > CACHE:
                self.old_parts, self.parts = self.parts, {"": b""}
            known = self.parts
            new = set().union(*split).difference(known)
            if new:
                self._learn(new)
            get = self.parts.__getitem__
            for x in split:
                yield b"".join(map(get, x))


def encoder(path: str) -> CachedEncoder:
    import os

    key = (path, os.getpid())
    if key not in _ENCODERS:
        _ENCODERS[key] = CachedEncoder(path)
    return _ENCODERS[key]


def open_fs(uri: str):
    """File system and path of a URI or plain path."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes documents' ids to an open file; memory is bounded by one frame and the index."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.plain = bytearray()
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.plain += ids
        while len(self.plain) >= self.frame_bytes:
            self._flush(self.frame_bytes)

    def _flush(self, n: int) -> None:
        import xxhash

        raw = bytes(self.plain[:n])
        del self.plain[:n]
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.plain:
            self._flush(len(self.plain))
        null = np.array([x is None for x in self.ids], dtype="u1")
        index = self.zstd.compress(struct.pack("<Q", len(self.ids)) + np.array([x or 0 for x in self.ids], dtype="<i8").tobytes() + np.array(self.sizes, dtype="<i8").tobytes() + null.tobytes())
        self.out.write(struct.pack("<II", INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE))


class FrameReader:
    """Random access to the documents of one file (a seekable pyarrow or Python file)."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        file.seek(size - 9)
        n, kind, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or kind != 0x80:
            raise ValueError("no seek table at the end of the file")
        file.seek(size - 9 - 12 * n)
        entries = np.frombuffer(file.read(12 * n), dtype="<u4").reshape(n, 3).astype("i8")
        self.checks = entries[:, 2]
        self.at = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.plain_at = np.concatenate([[0], np.cumsum(entries[:, 1])])
        file.seek(int(self.at[-1]))
        magic, length = struct.unpack("<II", file.read(8))
        if magic != INDEX:
            raise ValueError("no document index behind the frames")
        raw = self.zstd.decompress(file.read(length))
        count = struct.unpack_from("<Q", raw)[0]
        self.doc_ids = np.frombuffer(raw, "<i8", count, 8)
        self.sizes = np.frombuffer(raw, "<i8", count, 8 + 8 * count)
        self.null = np.frombuffer(raw, "u1", count, 8 + 16 * count).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.decompressed = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        import xxhash

        if self._last[0] != k:
            self.file.seek(int(self.at[k]))
            raw = self.zstd.decompress(self.file.read(int(self.at[k + 1] - self.at[k])))
            if len(raw) != self.plain_at[k + 1] - self.plain_at[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.decompressed += 1
            self._last = (k, raw)
        return self._last[1]

    def ids(self, n: int) -> bytes:
        """Id bytes of the n-th document of the file."""
        lo, hi = 4 * int(self.starts[n]), 4 * int(self.starts[n + 1])
        k = int(np.searchsorted(self.plain_at, lo, side="right")) - 1
        parts = []
        while lo < hi:
            base, end = int(self.plain_at[k]), int(self.plain_at[k + 1])
            parts.append(self.frame(k)[lo - base : min(hi, end) - base])
            lo, k = min(hi, end), k + 1
        return b"".join(parts)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, files: int | None = None) -> list[dict]:
    """Writes ids of ``docs(doc_id, text)`` in ascending id order; the manifest, one entry per file.

    Each attempt of a task writes a file of its own name and only the attempt whose
    summary arrives is listed, so retries and lost executors leave no double rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    files = files or partitions(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, target, out = None, "", None
        end = struct.pack("<I", end_id)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system, root = open_fs(folder)
                system.create_dir(root, recursive=True)
                target = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
                out = system.open_output_stream(target)
                writer = FrameWriter(out)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1).to_pylist()), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [target], "docs": [len(writer.ids)], "tokens": [sum(writer.sizes)]})

    rows = (
        docs.select("doc_id", whole_text().alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(files, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(pack, "part int, path string, docs long, tokens long")
        .collect()
    )
    manifest, base = [], 0
    for row in sorted(rows, key=lambda r: r["part"]):
        manifest.append({"path": row["path"], "base": base})
        base += row["tokens"]
    return manifest


def read_token_files(spark, folder: str, manifest: list[dict]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, frames (frames its ids lie in)."""
    bounded_batches(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, frames int"
    if not manifest:
        return spark.createDataFrame([], schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_fs(folder)
        for batch in batches:
            for entry in batch.to_pylist():
                with system.open_input_file(entry["path"]) as file:
                    reader = FrameReader(file, file.size())
                    n = len(reader.sizes)
                    for at in range(0, n, 4096):
                        to = min(n, at + 4096)
                        first = np.searchsorted(reader.plain_at, 4 * reader.starts[at:to], side="right")
                        last = np.searchsorted(reader.plain_at, 4 * reader.starts[at + 1 : to + 1], side="left")
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.doc_ids[at:to], mask=reader.null[at:to]),
                                pa.array(reader.starts[at:to] + entry["base"]),
                                pa.array(reader.sizes[at:to]),
                                pa.array([zlib.crc32(reader.ids(k)) for k in range(at, to)], pa.int64()),
                                pa.array(np.maximum(last - first + 1, 0), pa.int32()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32", "frames"],
                        )

    files = spark.createDataFrame(manifest, "path string, base long").repartition(len(manifest))
    return files.mapInArrow(unpack, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes and reads back; files lie in the shared folder."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, tokenizer, end_id))
