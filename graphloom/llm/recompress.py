"""Substring deduplication by recompression.

Names are global: a name is a hash of what it stands for, so every executor gives equal substrings
equal names with no dictionary.  In each round a salted bit of its name makes every symbol *left*
or *right*; a left symbol followed by a right one becomes one symbol, named by the pair.  Equal
neighbours never pair, so a run stays a run; its windows share one key, which travels once per document with its count.  Whether two symbols join depends on nothing but these two, so after
three rounds (symbols of at most 8 words) two equal stretches of text agree in all symbols except
within 7 words of their ends.

Of a window of 35 words, the cuts at offsets 7 to 14 (at least one exists) are hence the same
wherever its words occur; so are the symbols from such a cut on until 7 words are covered (at
offset 28 at most).  The cut with the least of these high-level names is the window's anchor, and
the name of the 28 words around it (7 before), which every window with this anchor holds, is its
key: windows that are equal share a key.  Only keys travel to be counted (a fifth as many as words),
then only windows whose key occurs again are named in full (128 bits over 35 words, from two independent names of each
word), and counting those names verifies the repeats.  Documents with identical text are named once, with their number as weight.

All rounds of a document run in the task that holds it: since names are hashes, they need no exchange.  A table of
(document, place, symbol) that Spark rounds would name holds a row of 20 bytes for each word, several times the input on disk.

Defined results: null ids are ids like others; null and empty texts have no words; windows never cross documents; a document
shorter than a window loses nothing; repeated rows count as separate documents; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, release, written

U = np.uint64
ROUNDS = 3
EDGE = (1 << ROUNDS) - 1  # words at either end whose symbols may differ
CUTS = 1 << ROUNDS  # cuts to choose from
COVER = 7  # words that a key covers at least
AROUND = 28  # words that all windows with one anchor hold, EDGE of them before it
SHORTEST = EDGE + AROUND  # windows of fewer words have no guarantee
M1, M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95
NONE = U(2**64 - 1)
#: Words handled at a time (a longer document is handled alone).
CHUNK = 1 << 18


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ U(salt)) * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def _powers(m: int, n: int) -> np.ndarray:
    out = np.full(n, m, U)
    out[:1] = 1
    return np.cumprod(out)


_INVERSE = {m: pow(m, -1, 2**64) for m in (M1, M2)}


def _spans(values: np.ndarray, a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """Name of ``values[a:b]`` for each pair of ends, equal for equal sequences wherever they are."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * _powers(m, len(values)), out=sums[1:])
    return (sums[b] - sums[a]) * _powers(_INVERSE[m], len(values) + 1)[a]


def _best(values: np.ndarray, n: int, best, fill) -> np.ndarray:
    """``best`` of ``values[i:i + n]`` at each i, for n a power of two."""
    step = 1
    while step < n:
        moved = np.full_like(values, fill)
        moved[:-step] = values[step:]
        values = best(values, moved)
        step *= 2
    return values


class _Words(dict):
    """Name of each word; bounded by clearing between chunks."""

    def __missing__(self, word: bytes) -> int:
        name = self[word] = xxhash.xxh64_intdigest(word, 11)
        return name


class _Others(dict):
    """A second name of each word, independent of the first."""

    def __missing__(self, word: bytes) -> int:
        name = self[word] = xxhash.xxh3_64_intdigest(word, 5)
        return name


_words, _others = _Words(), _Others()


def name_words(words: list[bytes], known: dict = _words) -> np.ndarray:
    if len(known) > 1_000_000:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), U, len(words))


def anchors(names: np.ndarray, doc: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of valid windows, the anchor of each, and the key of each."""
    n = len(names)
    sym, at = names, np.arange(n)
    for r in range(ROUNDS):
        right = _mix(sym, 0x51ED + 977 * r) >> U(63) == 1
        pair = ~right[:-1] & right[1:] & (doc[at[:-1]] == doc[at[1:]])
        named = sym.copy()
        k = np.flatnonzero(pair)
        named[k] = _mix(sym[k] * U(M1) + sym[k + 1] * U(M2) + U(r + 1))
        stay = np.ones(len(sym), bool)
        stay[k + 1] = False
        sym, at = named[stay], at[stay]
    ends = np.searchsorted(at, at + COVER)
    at_cut = np.full(n, NONE, U)
    at_cut[at] = np.minimum(_mix(_spans(sym, np.arange(len(sym)), ends, M1)), NONE - U(1))
    starts = np.flatnonzero(valid)
    least = _best(at_cut, CUTS, np.minimum, NONE)[starts + EDGE]
    anchor = np.zeros(len(starts), np.int64)
    for k in reversed(range(CUTS)):  # of equal names the first
        p = starts + EDGE + k
        anchor = np.where(at_cut[p] == least, p, anchor)
    return starts, anchor, _mix(_spans(names, anchor - EDGE, anchor - EDGE + AROUND, M1))


def _valid(doc: np.ndarray, window: int) -> np.ndarray:
    valid = np.zeros(len(doc), bool)
    if len(doc) >= window:
        valid[: len(doc) - window + 1] = doc[: len(doc) - window + 1] == doc[window - 1 :]
    return valid


def _chunks(texts: Iterator[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Documents' words in chunks, each with the number of its first document."""
    held, n, first = [], 0, 0
    for k, text in enumerate(texts):
        words = (text or "").encode().split()
        if held and n + len(words) > CHUNK:
            yield first, held
            held, n, first = [], 0, k
        held.append(words)
        n += len(words)
    if held:
        yield first, held


def _named(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word names and document numbers of a chunk, and where each document starts."""
    sizes = np.array([len(w) for w in docs])
    names = np.concatenate([name_words(w) for w in docs]) if sizes.sum() else np.zeros(0, U)
    return names, np.repeat(np.arange(len(docs)), sizes), np.cumsum(sizes) - sizes


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def keys_of(docs: DataFrame, window: int) -> DataFrame:
    """``(d1, d2, key, n)``: how often each chosen key occurs in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = (batch.column(c).to_numpy() for c in (0, 1))
            for first, words in _chunks(t.as_py() for t in batch.column(2)):
                names, doc, _ = _named(words)
                if len(names) < window:
                    continue
                _, anchor, key = anchors(names, doc, _valid(doc, window))
                if not len(key):
                    continue
                _, own = np.unique(anchor, return_index=True)
                k, d = key[own], doc[anchor[own]]
                order = np.lexsort((k, d))
                k, d = k[order], d[order]
                new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
                rows = first + d[new]
                yield pa.RecordBatch.from_arrays([pa.array(d1[rows]), pa.array(d2[rows]), _signed(k[new]), pa.array(np.diff(np.r_[new, len(k)]))], ["d1", "d2", "key", "n"])

    return docs.select("d1", "d2", "text").mapInArrow(run, "d1 long, d2 long, key long, n long")


def windows_of(docs: DataFrame, window: int) -> DataFrame:
    """``(w1, w2, d1, d2, s, weight)``: full names of the windows whose key is among ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2, weight = (batch.column(c).to_numpy() for c in (0, 1, 4))
            for first, words in _chunks(t.as_py() for t in batch.column(2)):
                names, doc, starts = _named(words)
                if len(names) < window:
                    continue
                start, _, key = anchors(names, doc, _valid(doc, window))
                hit = np.zeros(len(start), bool)
                for k, a in enumerate(starts):
                    i, j = np.searchsorted(start, (a, a + len(words[k])))
                    hit[i:j] = np.isin(key[i:j], batch.column(3)[first + k].values.to_numpy().view(U))
                s = start[hit]
                rows = first + doc[s]
                again = np.concatenate([name_words(w, _others) for w in words]) if len(s) else names
                for k in range(0, len(s), 1 << 17):
                    p, r = s[k : k + (1 << 17)], rows[k : k + (1 << 17)]
                    full = [_signed(_spans(n, p, p + window, m)) for n, m in ((names, M1), (again, M2))]
                    yield pa.RecordBatch.from_arrays([*full, pa.array(d1[r]), pa.array(d2[r]), pa.array((p - starts[doc[p]]).astype(np.int32)), pa.array(weight[r])], ["w1", "w2", "d1", "d2", "s", "weight"])

    return docs.select("d1", "d2", "text", "keys", "weight").mapInArrow(run, "w1 long, w2 long, d1 long, d2 long, s int, weight long")


def cut_repeats(words: list[bytes], starts, window: int) -> list[bytes]:
    """The words that no window starting at ``starts`` covers."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts) + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone, strict=True) if not g]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, with_text: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256`` and, if asked, ``kept``.

    Every word in a window of ``window`` words whose sequence starts anywhere else too is removed.
    """
    if window < SHORTEST:
        raise ValueError(f"windows need {SHORTEST} words or more")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(7), text).alias("d2"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    same = ["d1", "d2"]
    keys = written(keys_of(rows, window), "keys")
    # a table of its own, so that the join may split a key that very many documents have
    shared = written(keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "shared")
    release(spark)
    marked = keys.join(shared, "key").groupBy(*same).agg(F.collect_set("key").alias("keys"))
    classes = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("first"))
    marked = written(marked.join(classes, same), "marked")
    discard(keys)
    discard(shared)
    release(spark)
    first = rows.join(marked, same).where(F.col("doc_id").eqNullSafe(F.col("first")))
    named = written(windows_of(first, window), "windows")
    discard(marked)
    release(spark)
    again = written(named.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).where("n > 1").select("w1", "w2"), "again")  # likewise
    release(spark)
    starts = written(named.join(again, ["w1", "w2"]).groupBy(*same).agg(F.collect_set("s").alias("starts")), "repeats")
    discard(named)
    discard(again)
    release(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, s in zip(*batch.columns, strict=True):
                words = t.as_py().encode().split()
                kept = cut_repeats(words, s.values.to_numpy(), window) if s.is_valid else words
                joined = b" ".join(kept)
                out.append((i.as_py(), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = rows.join(starts, same, "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
