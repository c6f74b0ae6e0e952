"""Benchmark decontamination by winnowing, in built-in functions.

Every `gram`-word gram is hashed; of each run of grams that covers `width` words the smallest hash is kept (the leftmost of equals).
Two texts that share `width` words keep the same gram of that passage, so a join of the kept hashes finds every shared passage. A
hit is then extended word by word to both sides, up to the passage's length. Items shorter than `width` are one window: they lie in
the same index by the hash of their first words, `gram` at most, and documents ask for them at every place.

The documents are read once. A bitmap of the index's hashes drops most hashes that it lacks, before the words around them are taken
along; the join decides about the rest. The index is broadcast while it takes at most `broadcast_bytes`, and joined by a shuffle
beyond; each document also sends one row of its own through that join, so that documents without hits need no second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.native import bound, id_and_text, leading, words_of
from tideline.llm.store import written

#: An array of Spark has less than 2 ** 31 bytes and a word takes 16 of them, so places need 27 bits.
_PLACE_BITS = 28
_BITMAP_BITS = 1 << 22  # at most; 16 for each hash of the index while they suffice


def _from(a: Column, k: int) -> Column:
    """The array from its k-th element (from 0) on."""
    return F.slice(a, k + 1, F.greatest(F.lit(0), F.size(a) - k))


def _doubled(own: Column, n: int, join) -> Column:
    """join over each run of n elements, from those of runs of half the length; the last n - 1 places hold shorter runs."""
    if n == 1:
        return own
    half = n // 2
    pairs = bound(_doubled(own, half, join), lambda a: F.zip_with(a, _from(a, half), join))
    return pairs if n % 2 == 0 else F.zip_with(pairs, _from(own, n - 1), join)


def run_hashes(words: Column, size: int, salt: int = 0) -> Column:
    """For each run of `size` words 36 bits of its hash, with its place (from 1) in the 28 bits below. Fewer words: none."""
    hashed = F.transform(words, lambda w: F.xxhash64(w, F.lit(salt)))
    every = bound(hashed, lambda h: _doubled(h, size, lambda a, b: F.xxhash64(a, b)))
    packed = F.transform(F.slice(every, 1, F.greatest(F.lit(0), F.size(words) - (size - 1))), lambda x, i: F.shiftleft(F.shiftright(x, _PLACE_BITS), _PLACE_BITS).bitwiseOR((i + 1).cast("bigint")))
    return packed


def winnowed(words: Column, gram: int, width: int) -> Column:
    """The kept hashes, each once. Fewer words than `width`: none."""
    run = width - gram + 1
    least = bound(run_hashes(words, gram), lambda g: F.slice(_doubled(g, run, lambda a, b: F.least(a, b)), 1, F.greatest(F.lit(0), F.size(g) - (run - 1))))
    return F.when(F.size(words) >= width, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")


def _around(words: Column, at: Column, width: int) -> list[Column]:
    """Up to width - 1 words before place `at` (from 1), nearest first, and width words from it on."""
    before = F.slice(words, F.greatest(F.lit(1), at - (width - 1)), F.least(F.lit(width - 1), at - 1))
    return [F.reverse(before).alias("before"), F.slice(words, at, width).alias("after")]


def benchmark_index(items: DataFrame, gram: int, width: int) -> DataFrame:
    """(hash, item_before, item_after, whole, items): the kept hashes of the items of `width` words and more, and shorter items whole,
    by the hash of their first words."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where("item_id is not null and size(words) > 0")
    long = items.where(F.size("words") >= width).select("item_id", "words", F.explode(winnowed(F.col("words"), gram, width)).alias("kept"))
    around = [c.alias(f"item_{n}") for c, n in zip(_around(F.col("words"), _place(F.col("kept")), width), ("before", "after"), strict=True)]
    long = long.select("item_id", F.shiftright("kept", _PLACE_BITS).alias("hash"), *around, F.lit(False).alias("whole"))
    short = items.where(F.size("words") < width)
    first = F.coalesce(*[F.when(F.least(F.size("words"), F.lit(gram)) == m, F.get(run_hashes(F.col("words"), m, salt=m), F.lit(0))) for m in range(1, gram + 1)])
    short = short.select("item_id", F.shiftright(first, _PLACE_BITS).alias("hash"), F.array().cast("array<string>").alias("item_before"), F.col("words").alias("item_after"), F.lit(True).alias("whole"))
    return long.unionByName(short).groupBy("hash", "item_before", "item_after", "whole").agg(F.collect_set("item_id").alias("items"))


def _bitmap(index: DataFrame) -> tuple[list[int], int]:
    """The index's hashes as bits of `n` 64-bit words."""
    n = 1
    while n * 64 < min(_BITMAP_BITS, 16 * index.count()):
        n *= 2
    place = F.pmod(F.col("hash"), F.lit(64 * n))
    rows = index.groupBy(F.floor(place / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))).alias("bits")).collect()  # 65,536 rows at most
    held = {r["word"]: r["bits"] for r in rows}
    return [held.get(i, 0) for i in range(n)], n


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, gram: int = 5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_hit, items (the ids found, sorted as strings) and text_hash.

    A word is hit if an item's window of `width` words, or a whole shorter item, occurs there. Null texts have no words; items
    without words or without an id count for nothing; equal ids with different texts are judged apart, and equal rows get a row
    each; an empty table of documents gives none, one of items no hits; other columns, whatever their names, are ignored.
    """
    index = written(benchmark_index(items, gram, width), "fingerprints")
    size = index.agg(F.sum(F.octet_length(F.to_json(F.struct(*index.columns)))).alias("n")).first()["n"] or 0
    short = sorted(r["m"] for r in index.where("whole").select(F.least(F.size("item_after"), F.lit(gram)).alias("m")).distinct().collect())  # `gram` at most
    bits, n = _bitmap(index)
    bitmap = F.from_json(F.lit(str(bits)), "array<bigint>")

    def listed(packed: Column) -> Column:
        at = F.pmod(F.shiftright(packed, _PLACE_BITS), F.lit(64 * n))
        return F.getbit(F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    base = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    asked = F.concat(F.filter(winnowed(F.col("words"), gram, width), listed), *[F.filter(run_hashes(F.col("words"), m, salt=m), listed) for m in short])

    # each hash takes along the few words around it, so that no row holds a whole text
    def sent(kept: Column) -> Column:
        return F.struct(F.shiftright(kept, _PLACE_BITS).alias("hash"), _place(kept).alias("at"), *_around(F.col("words"), _place(kept), width))

    # the row that a document sends for itself has a hash of its own, beyond those of grams, so that these rows spread
    empty = F.array().cast("array<string>")
    itself = F.struct(F.col("text_hash").bitwiseOR(F.lit(1 << 62)).alias("hash"), F.lit(None).cast("int").alias("at"), empty.alias("before"), empty.alias("after"))
    rows = base.withColumn("asked", asked).select("doc_id", "text_hash", "n", F.explode(F.concat(F.array(itself), F.transform("asked", sent))).alias("s")).select("doc_id", "text_hash", "n", "s.*")
    met = rows.join(F.broadcast(index) if size <= broadcast_bytes else index.hint("shuffle_hash"), "hash", "left")
    met = met.where("items is not null or at is null").withColumn("left", leading(F.col("before"), F.col("item_before"))).withColumn("right", leading(F.col("after"), F.col("item_after")))
    fits = F.when(F.col("whole"), F.col("right") == F.size("item_after")).otherwise((F.col("right") >= gram) & (F.col("left") + F.col("right") >= width))
    hit = F.col("at").isNotNull() & F.coalesce(fits, F.lit(False))
    span = F.struct((F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right") - 1).alias("end"))
    found = met.where(hit | F.col("at").isNull()).select("doc_id", "text_hash", "n", F.col("at").isNull().cast("int").alias("own"), F.when(hit, span).alias("span"), F.when(hit, F.col("items")).alias("items"))
    per = found.groupBy("doc_id", "text_hash").agg(F.max("n").alias("n"), F.sum("own").alias("times"), F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"]))))
    out = per.select("doc_id", "text_hash", F.col("n").cast("bigint").alias("n_words"), F.size(covered).cast("bigint").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time"))
    return out.drop("time")
