"""Benchmark decontamination by template canonicalisation (built-in functions only).

Words are lower-cased and lose their punctuation; numbers, units that follow a number, and names
(runs of capitalised words inside a sentence) become typed placeholders, one for a run.  Windows of ``window`` such words
are hashed; documents' windows are joined with benchmark items' windows, so that questions with
other numbers, names or units are found too.  Hits are gathered per document, item and diagonal
(offset of one against the other), then over every range of at most ``shift + 1`` neighbouring
diagonals, since words put in or taken out move what follows.  A document is a leak of an item when
at least ``share`` of the item's windows, and ``least`` of them where it has so many, match in one range (each
window counts once) and the placeholders' values correspond one to one over all of them: the same slot
always holds the same value, and different slots different ones.

A window of which fewer than ``fixed`` words are no placeholders is not used as a template, nor is
any window of an item that has under ``window`` such words.  All items are compared word by word too (lower-cased, names not joined, nothing replaced), so that
copies in other case and of items that make no templates are found: by ``share`` of these windows where
fewer than that are usable as templates, else by all of them.  ``n_windows`` counts the windows of the
comparison that found the leak.  A text of fewer words than a window is one window: such an item is
found in documents that have nothing else.

Documents' windows first pass a bitmap of the items' hashes (at most ``BITS`` bits, a
subquery), so only those travel that have a partner or are among the few false hits.  The item side is counted:
up to ``broadcast_windows`` windows it is broadcast, beyond that both sides are shuffled; what travels is
a window's words, never a text.

Defined results: null texts and texts without words match nothing; a document is an id and a text: rows that repeat both are one, equal
ids (or null ids) with other texts are separate; repeated items with other ids each
give a row; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACE

NAME, NUMBER, UNIT, JOIN = "\ue000", "\ue001", "\ue002", "\ue003"  # private-use characters; texts' own ones are removed first
BLANKS = " \t\n\x0b\x0c\r"
#: Bits of the largest bitmap.
BITS = 1 << 22
GAP = r"[\x20\x09-\x0D]{1,3}"
# possessive, as every loop over a group below: Java takes stack for each turn that it could give back, and what follows never needs one back
CAPITALISED = r"\p{Lu}\p{Ll}++[\p{L}\p{M}\p{N}]*+"
UNITS = "km|cm|mm|m|mi|miles?|kilomet(?:er|re)s?|met(?:er|re)s?|feet|foot|ft|inch(?:es)?|yards?|kg|kilograms?|mg|g|grams?|lbs?|pounds?|ounces?|oz|tons?|l|lit(?:er|re)s?|ml|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|mph|kph|usd|eur|dollars?|euros?|cents?|percent|degrees?"


def _unmarked(text: Column) -> Column:
    """The text without placeholder characters of its own, which next to no text has."""
    found = text.contains(NAME) | text.contains(NUMBER) | text.contains(UNIT) | text.contains(JOIN)
    return F.when(found, F.translate(text, NAME + NUMBER + UNIT + JOIN, "")).otherwise(text)


def _split(lower: Column) -> Column:
    """Words of lower-case text, without punctuation."""
    text = F.regexp_replace(lower, rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}-{JOIN}\x20\x09-\x0D]+", "")
    return F.split(F.btrim(text, F.lit(BLANKS)), SPACE)


def plain_words(text: Column) -> Column:
    """The words that a text's templates stand for; those of a name are joined."""
    # a name's first word follows a word or a comma, each further one the last match
    joined = F.regexp_replace(_unmarked(text), rf"([\p{{L}}\p{{N}},;:%]{GAP}{CAPITALISED}|\G(?!^){CAPITALISED}){GAP}(?=\p{{Lu}}\p{{Ll}})", f"$1{JOIN}")
    return _split(F.lower(joined))


def template_words(text: Column) -> Column:
    """Words with placeholders, one for each of :func:`plain_words`."""
    text = F.regexp_replace(_unmarked(text), rf"\p{{Lu}}(?<=[\p{{L}}\p{{N}},;:%]{GAP}\p{{Lu}})\p{{Ll}}+[\p{{L}}\p{{M}}\p{{N}}]*(?:{GAP}{CAPITALISED})*+", NAME)
    text = F.regexp_replace(F.lower(text), r"\p{N}+(?:[.,:/]\p{N}+)*+", NUMBER)
    return _split(F.regexp_replace(text, rf"({NUMBER}[\x20\x09-\x0D]*)(?:{UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}"))


def raw_words(text: Column) -> Column:
    """The words of a text as they are, in lower case."""
    return _split(F.lower(_unmarked(text)))


def _hash_at(hashes: Column, i: Column, window: int) -> Column:
    """Hash of the words at ``i`` and after; of fewer than ``window`` where the text ends."""
    return F.xxhash64(*(F.get(hashes, i + k) for k in range(window)))


def _starts(words: Column, window: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(words) - window, F.lit(0)))


def _window_hashes(hashes: Column, window: int) -> Column:
    return F.transform(_starts(hashes, window), lambda i: _hash_at(hashes, i, window))


def _is_slot(word: Column) -> Column:
    return word.rlike(f"[{NAME}{NUMBER}{UNIT}]")


def item_windows(items: DataFrame, window: int, fixed: int, share: float) -> DataFrame:
    """``(item_id, n_windows, ipos, after, raw, need, h, tmpl, plain)`` of all usable windows.

    ``raw``: windows of words as they are.
    """
    texts = items.where("text is not null").select("item_id", "text", raw_words(F.col("text")).alias("words")).where("words[0] <> ''")
    own = texts.select("item_id", "text", "words", template_words(F.col("text")).alias("tmpl"), plain_words(F.col("text")).alias("plain"))
    # as if a word came before the item, which may make a name of its first word and join it with the next ones
    more = F.concat(F.lit("x "), "text")
    later = own.select("item_id", F.col("tmpl").alias("own"), template_words(more).alias("tmpl"), plain_words(more).alias("plain"))
    later = later.select("item_id", "own", *(F.slice(c, 2, F.size(c)).alias(c) for c in ("tmpl", "plain"))).where(F.size("tmpl") != F.size("own"))
    both = own.select("item_id", "tmpl", "plain", F.lit(False).alias("after")).union(later.select("item_id", "tmpl", "plain", F.lit(True)))
    both = both.where(F.size(F.filter("tmpl", lambda w: ~_is_slot(w))) >= window)

    def windows(df: DataFrame, words: str, plain: str) -> DataFrame:
        each = df.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w))).withColumn("ipos", F.explode(_starts(F.col(words), window)))
        part = lambda c: F.slice(c, F.col("ipos") + 1, window)
        return each.select("item_id", "ipos", "after", "raw", "need", _hash_at(F.col("__h"), F.col("ipos"), window).alias("h"), part(words).alias("tmpl"), part(plain).alias("plain"))

    rows = windows(both.select("*", F.lit(False).alias("raw"), F.lit(share).cast("double").alias("need")), "tmpl", "plain")
    usable = rows.where(F.size(F.filter("tmpl", lambda w: ~_is_slot(w))) >= fixed)
    # where templates cover too little of an item to judge it, its words do; else they add whole copies only
    counts = usable.where("not after").groupBy("item_id").agg(F.countDistinct("ipos").alias("n"))
    bare = own.join(counts, "item_id", "left").withColumn("all", F.greatest(F.size("tmpl") - (window - 1), F.lit(1)))
    need = F.when(F.coalesce("n", F.lit(0)) < share * F.col("all"), F.lit(share)).otherwise(1.0).cast("double")
    raw = windows(bare.select("item_id", "words", F.lit(False).alias("after"), F.lit(True).alias("raw"), need.alias("need")), "words", "words")
    every = usable.union(raw)
    return every.join(every.groupBy("item_id", "after", "raw").agg(F.countDistinct("ipos").alias("n_windows")), ["item_id", "after", "raw"])


def _probes(h: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(bits - 1)) for k in (0, 20, 40)]


def bitmap(grams: DataFrame, n: int) -> tuple[Column, int]:
    """Bits of the hashes of ``grams(h)``, three for each, as a subquery for an array of 64-bit numbers; and how many bits it has."""
    bits = 1 << 12
    while bits < min(64 * n, BITS):
        bits *= 2
    at = grams.select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("at"))
    sums = at.groupBy(F.shiftright("at", 6).cast("int").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v"))
    longs = [0] * (bits // 64)
    for r in sums.collect():  # at most BITS / 64 rows
        longs[r["k"]] = r["v"]
    return grams.sparkSession.createDataFrame([(longs,)], "known array<bigint>").scalar(), bits


def points(rows: DataFrame, grams: DataFrame, n: int, window: int) -> DataFrame:
    """``(doc_id, own, raw, pos, h, values)``: the windows of ``rows(doc_id, own, text)`` that the bitmap lets pass."""
    known, bits = bitmap(grams, n)

    def may(h: Column) -> Column:
        out = F.lit(True)
        for p in _probes(h, bits):
            word, place = F.get("known", F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")
            out = out & (F.call_function("shiftrightunsigned", word, place).bitwiseAND(F.lit(1)) == 1)
        return out

    def passing(c: str) -> Column:
        return F.filter(_starts(F.col(c), 1), lambda i: may(F.get(F.col(c), i)))

    # generators of one row keep the optimizer from moving an array's expression into the loop that reads it
    once = lambda df, keep, **cols: df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in cols.items())))))
    keep = ["doc_id", "own", "text"]
    hashed = once(rows, keep, **{c: F.transform(f(F.col("text")), lambda w: F.xxhash64(w)) for c, f in (("t", template_words), ("r", raw_words))})
    hashed = once(hashed, keep, known=known, **{c: _window_hashes(F.col(c), window) for c in ("t", "r")})
    found = once(hashed, [*keep, "t", "r"], in_t=passing("t"), in_r=passing("r")).where((F.size("in_t") > 0) | (F.size("in_r") > 0))
    split = once(found, ["doc_id", "own", "t", "r", "in_t", "in_r"], plain=plain_words(F.col("text")), words=raw_words(F.col("text")))

    def each(at: str, hashes: str, words: str, raw: bool) -> Column:
        return F.transform(at, lambda i: F.struct(F.lit(raw).alias("raw"), i.alias("pos"), F.get(F.col(hashes), i).alias("h"), F.slice(words, i + 1, window).alias("values")))

    return split.select("doc_id", "own", F.explode(F.concat(each("in_t", "t", "plain", False), each("in_r", "r", "words", True))).alias("w")).select("doc_id", "own", "w.*")


def text_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5, fixed: int = 2, share: float = 0.5, least: int = 4, shift: int = 3, broadcast_windows: int = 200_000) -> DataFrame:
    """:func:`leaks` with ``own``, the hash of the document's text."""
    grams = item_windows(items.select("item_id", "text"), window, fixed, share)
    n = grams.limit(broadcast_windows + 1).count()
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text"))
    hits = points(rows, grams, n, window).join(F.broadcast(grams) if n <= broadcast_windows else grams, ["raw", "h"])
    slots = F.filter(F.arrays_zip(F.col("tmpl").alias("t"), F.col("plain").alias("i"), F.col("values").alias("d")), lambda x: _is_slot(x["t"]))
    key = ["doc_id", "own", "item_id", "after", "raw", "need", "n_windows"]
    found = hits.select(*key, (F.col("pos") - F.col("ipos")).alias("diagonal"), "ipos", slots.alias("slots"))
    lines = found.groupBy(*key, "diagonal").agg(F.collect_set("ipos").alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    ranges = F.array(*(F.struct((F.col("diagonal") - k).alias("low"), F.lit(more).alias("more")) for more in range(shift + 1) for k in range(more + 1)))
    spread = lines.select(*key, "at", "slots", F.explode(ranges).alias("range"))
    lines = spread.groupBy(*key, "range").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_matched"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    part = lambda k: F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(x["t"], x[k]))))
    size = F.size("slots")
    enough = (F.col("n_matched") >= F.col("need") * F.col("n_windows")) & (F.col("n_matched") >= F.least(F.lit(least), "n_windows"))
    good = lines.where(enough & (part("i") == size) & (part("d") == size))
    kind = F.when(F.forall("slots", lambda x: x["i"] == x["d"]), "verbatim").otherwise("reparameterised")
    score = F.struct((F.col("n_matched") / F.col("n_windows")).alias("part"), (kind == "verbatim").alias("same"), (~F.col("raw")).alias("tmpl"), "n_matched", "n_windows", size.alias("n_slots"), kind.alias("kind"))
    best = good.groupBy("doc_id", "own", "item_id").agg(F.max(score).alias("b"))
    return best.select("doc_id", "own", "item_id", "b.kind", "b.n_windows", "b.n_matched", F.col("b.n_slots").cast("long").alias("n_slots"))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per contaminated (document, item): ``doc_id, item_id, kind, n_windows, n_matched, n_slots``.

    ``kind`` is ``verbatim`` when all slots hold the item's own values, else ``reparameterised``.
    """
    return text_leaks(docs, items, id_col, text_col, **options).drop("own")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that leak no item, all columns kept."""
    bad = text_leaks(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("__bad"), F.col("own").alias("__own")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")) & (F.xxhash64(text_col) == F.col("__own")), "left_anti")
