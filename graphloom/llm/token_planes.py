"""Token ids in bit-plane segments.

A segment is one self-contained byte string that holds the ids of complete documents:

    b"GLP1" | kind u8 | width u8 | block u32 | n_docs u32 | n_ids u64 | n_chunks u32
    doc index    n_docs x (doc_id i64, has_id u8, n_tokens u64), zstd, length u32 before it
    chunk index  n_chunks x (offset u64, size u32): one entry for each plane of each block
    payload      the planes, one zstandard frame each

Ids are cut into blocks of ``block`` ids; each block is transposed into byte planes (``kind`` 0)
or bit planes (``kind`` 1), so that the nearly constant high planes shrink to nothing.  Planes
above the highest used one are not stored (``width`` says how many are).  The chunk index lets a
reader fetch one block without the others.

Files are written as rows ``(shard, seg, n_ids, data)`` of a Parquet table, because a shared
folder may be in any store that Spark can reach; shards follow ascending doc_id, and segments
follow each other within a shard.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import written

HEAD = struct.Struct("<4sBBIIQI")
DOC = np.dtype([("id", "<i8"), ("has", "u1"), ("n", "<u8")])
CHUNK = np.dtype([("at", "<u8"), ("size", "<u4")])
BLOCK = 65_536
#: A segment ends with the document that reaches so many ids.
SEGMENT_IDS = 1 << 20


def encode_segment(docs: list[tuple[int | None, int]], ids: np.ndarray, block: int = BLOCK, bits: bool = False) -> bytes:
    """``docs``: (doc_id, number of ids) in order; ``ids``: all of them, unsigned 32-bit."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()).bit_length() if len(ids) else 0
    width = max(1, top if bits else -(-top // 8))
    pack = zstandard.ZstdCompressor(level=3)
    index, parts, at = [], [], 0
    for k in range(0, len(ids), block):
        planes = ids[k : k + block].view("u1").reshape(-1, 4).T
        if bits:
            planes = np.unpackbits(np.ascontiguousarray(planes), axis=1, bitorder="little")
            planes = np.concatenate([planes[p].reshape(-1, 8).T for p in range(4)])[:width]
            planes = np.packbits(planes, axis=1, bitorder="little")
        for p in range(width):
            parts.append(pack.compress(np.ascontiguousarray(planes[p]).tobytes()))
            index.append((at, len(parts[-1])))
            at += len(parts[-1])
    table = pack.compress(np.array([(i or 0, i is not None, n) for i, n in docs], DOC).tobytes())
    head = HEAD.pack(b"GLP1", bits, width, block, len(docs), len(ids), len(index))
    return b"".join([head, struct.pack("<I", len(table)), table, np.array(index, CHUNK).tobytes(), *parts])


def decode_segment(data: bytes) -> tuple[list[tuple[int | None, int]], np.ndarray]:
    """What :func:`encode_segment` was given."""
    magic, bits, width, block, n_docs, n_ids, n_chunks = HEAD.unpack_from(data)
    if magic != b"GLP1":
        raise ValueError("not a segment")
    at = HEAD.size
    (size,) = struct.unpack_from("<I", data, at)
    open_ = zstandard.ZstdDecompressor()
    docs = np.frombuffer(open_.decompress(data[at + 4 : at + 4 + size]) if n_docs else b"", DOC)
    at += 4 + size
    index = np.frombuffer(data, CHUNK, n_chunks, at)
    at += n_chunks * CHUNK.itemsize
    out = np.zeros((n_ids, 4), "u1")
    for k, (start, size) in enumerate(index):
        b, p = divmod(k, width)
        n = min(block, n_ids - b * block)
        plane = np.frombuffer(open_.decompress(data[at + int(start) : at + int(start) + int(size)]), "u1")
        if bits:
            out[b * block : b * block + n, p // 8] |= np.unpackbits(plane, bitorder="little")[:n] << (p % 8)
        else:
            out[b * block : b * block + n, p] = plane
    return [(int(d["id"]) if d["has"] else None, int(d["n"])) for d in docs], out.reshape(-1).view("<u4")


class WordCache(dict):
    """Encodes texts with the tokenizers library, each distinct word once.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    words in a row.  Lower-case Latin-1 words pass its normalizer and splitter unchanged and go to
    its model at once, in the byte alphabet; punctuation that ends such a word is a token run of its
    own; all other words, and texts with special-token strings, go through the whole library.  At
    most ``room`` words are kept.
    """

    PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,;:!?$%&*#]*)")

    def __init__(self, path: str, room: int = 600_000):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        super().__init__()
        self.tokenizer = t = Tokenizer.from_file(path)
        parts = str(t.pre_tokenizer), str(t.normalizer)
        self.by_word = isinstance(t.model, BPE) and "Split" in parts[0] and "ByteLevel" in parts[0] and "Lowercase" in parts[1] and "\\s+" in parts[1]
        self.model = t.model
        self.alphabet = {b: c for b, c in enumerate(_byte_alphabet())}
        self.room = room

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():
            ids = array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        elif (letters := word.rstrip(b".,;:!?")).isalpha():
            return self[letters] + self[word[len(letters) :]]  # kept as its parts
        elif m := self.PLAIN.fullmatch(word):
            letters, end = m.groups()
            if end:
                return self[letters] + self[end]  # kept as its parts
            ids = array("I", [t.id for t in self.model.tokenize(letters.decode("latin-1").translate(self.alphabet))]).tobytes()
        else:
            ids = self.whole(word.decode())
        self[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_word or "<|" in text:
            return self.whole(text)
        if len(self) > self.room:
            self.clear()
        return b"".join(map(self.__getitem__, text.encode().lower().split()))


def _byte_alphabet() -> list[str]:
    """The letter that stands for each byte in byte-level models."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in shown)
    extra = {b: chr(256 + k) for k, b in enumerate(rest)}
    return [extra.get(b, chr(b)) for b in range(256)]


_caches: dict[str, WordCache] = {}


def write_segments(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block: int = BLOCK, bits: bool = False) -> DataFrame:
    """Tokenises whole texts and writes segments in ascending order of the id; returns the table.

    Null text counts as empty (its document holds the end id alone), null ids come first, equal
    ids follow by text.  ``tokenizer`` is a path that every executor can read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seg, end = TaskContext.get().partitionId(), 0, struct.pack("<I", end_id)
        cache = _caches.get(tokenizer) or _caches.setdefault(tokenizer, WordCache(tokenizer))
        held: list[bytes] = []
        own: list[tuple[int | None, int]] = []
        n = 0

        def row() -> pa.RecordBatch:
            data = encode_segment(own, np.frombuffer(b"".join(held), "<u4"), block, bits)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([seg], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["shard", "seg", "n_ids", "data"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = cache(text.as_py() or "") + end
                held.append(ids)
                own.append((i, len(ids) // 4))
                n += len(ids) // 4
                if n >= SEGMENT_IDS:
                    yield row()
                    held, own, n, seg = [], [], 0, seg + 1
        if own:
            yield row()

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    placed = rows.repartitionByRange(parts, F.col("id")).sortWithinPartitions("id", "text")
    return written(placed.mapInArrow(encode, "shard long, seg long, n_ids long, data binary"), "token-planes")


def read_documents(segments: DataFrame) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before: shard totals (one row per written
    partition) are summed on the driver, segments within each shard by a window.
    """
    spark: SparkSession = segments.sparkSession
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    base, at = [], 0
    for r in totals:
        base.append((r["shard"], at))
        at += r["n"]
    offsets = spark.createDataFrame(base, "shard long, base long")
    before = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1))
    starts = segments.select("shard", "seg", "n_ids").withColumn("before", F.coalesce(before, F.lit(0)))
    starts = written(starts.join(F.broadcast(offsets), "shard").select("shard", "seg", (F.col("base") + F.col("before")).alias("start")), "starts")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, ids = decode_segment(data.as_py())
                raw, at, out = memoryview(ids.tobytes()), 0, []
                for i, n in docs:
                    out.append((i, start + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                    at += n
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = segments.join(starts, ["shard", "seg"]).select("start", "data")
    return joined.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
