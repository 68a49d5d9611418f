"""Carving script payloads out of binaries, and choosing among them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKER = b"// @bun"
CHUNK, DENSE, MISSES = 8192, 0.92, 4
_ENDS = (b"\0/$bunfs/", b"\0// @bun")
_PRINTABLE = bytes(c for c in range(256) if 32 <= c < 127 or c in (9, 10, 13) or c >= 128)


def density(chunk: bytes) -> float:
    """Share of bytes that text may hold."""
    return 1 - len(chunk.translate(None, _PRINTABLE)) / len(chunk) if chunk else 0.0


def payload_end(data: bytes, start: int, limit: int) -> int:
    """Where the payload that starts at a marker ends: a terminator, 8 NULs, or where text thins out."""
    found = [k for e in _ENDS if (k := data.find(e, start, limit)) >= 0]
    nul = data.find(b"\0" * 8, min(start + 100, limit), limit)
    end = min([*found, *([nul] if nul >= 0 else [])], default=-1)
    if end < 0:
        end, low = limit, 0
        for at in range(start, limit, CHUNK):
            if density(data[at : min(at + CHUNK, limit)]) >= DENSE:
                low = 0
                continue
            low += 1
            if low > MISSES:
                end = at - (low - 1) * CHUNK
                break
        if end == limit:
            return limit
    line = data.rfind(b"\n", start, end)
    return line + 1 if line > start else end


def carve(data: bytes, marker: bytes = MARKER) -> list[tuple[int, int]]:
    """(start, end) of each payload."""
    at = [m.start() for m in re.finditer(b"(?=" + re.escape(marker) + b")", data)]
    return [(a, payload_end(data, a, b)) for a, b in zip(at, [*at[1:], len(data)], strict=False)]


def payloads(binaries: DataFrame, marker: bytes = MARKER, key: str = "path", at_once: int = 64) -> DataFrame:
    """``(path, payload_ix, start, size, text)`` of ``binaries(path, content)``; Python holds the payloads of ``at_once`` of them at most."""
    kind = pa.schema([(key, pa.string()), ("payload_ix", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("text", pa.string())])

    def rows(path: str | None, data: bytes) -> list[tuple]:
        return [(path, n, a, b - a, data[a:b].decode("utf-8", "replace")) for n, (a, b) in enumerate(carve(data, marker))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once).to_pydict()
                found = [x for k, c in zip(part[key], part["content"], strict=True) for x in rows(k, c)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True) if found else [()] * 5, kind, strict=True)], schema=kind)

    return binaries.select(F.col(key).cast("string").alias(key), "content").mapInArrow(run, f"{key} string, payload_ix long, start long, size long, text string")


#: White space as scripts count it.
BLANK = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def signals(text: Column, size: Column) -> Column:
    """Score of a payload: size and counts of what scripts hold, in its first 200,000 bytes; wrapper in the
    first 4,096 bytes, flag in the first 200 characters."""
    first = lambda n: F.substring(text.cast("binary"), 1, n).cast("string")
    sample, head = first(200_000), first(4096)
    n = lambda p: F.regexp_count(sample, F.lit(p))
    iife = head.rlike(rf"\(function{BLANK}*\(exports{BLANK}*,{BLANK}*require{BLANK}*,{BLANK}*module")
    code = F.substring(head, 1, 200).rlike("@bytecode|@bun-cjs")
    score = F.log10(F.greatest(size, F.lit(1))) * 100 + F.when(iife, 500).otherwise(0) + F.when(code, 200).otherwise(0) + F.least(n(rf"\bfunction{BLANK}"), F.lit(1000)) * 0.5 + F.least(n(rf"\bvar{BLANK}"), F.lit(1000)) * 0.3 + F.least(n(r"\brequire\("), F.lit(500)) * 0.4
    return F.when(size < 1024, 0.0).otherwise(score)


def choose(found: DataFrame, mode: str = "main", index: int = 0, key: str = "path") -> DataFrame:
    """The payloads of a mode: ``main`` (best score, first on ties), ``all``, ``index`` or ``info``.

    Raises ``ValueError`` for an index that no binary has.
    """
    scored = found.withColumn("score", signals(F.col("text"), F.col("size")))
    if mode == "all":
        return scored
    if mode == "info":
        return scored.drop("text")
    if mode == "index":
        out = scored.where(F.col("payload_ix") == index)
        if out.isEmpty():
            raise ValueError(f"no payload {index}")
        return out
    w = Window.partitionBy(key).orderBy(F.desc("score"), "payload_ix")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


WRAPPER = r"(?s)^((?:\s*//[^\n]*\n)*)\s*\(function\s*\(\s*exports\s*,\s*require\s*,\s*module\s*,\s*__filename\s*,\s*__dirname\s*\)\s*\{(.*)\}\s*\)\s*;?\s*$"


def unwrap(text: Column) -> Column:
    """The body of a five-parameter wrapper, its leading comments kept; other text unchanged."""
    return F.when(text.rlike(WRAPPER), F.concat(F.regexp_extract(text, WRAPPER, 1), F.regexp_extract(text, WRAPPER, 2))).otherwise(text)
