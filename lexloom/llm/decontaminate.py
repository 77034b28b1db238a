"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask names the word positions of a window that count; the others may hold anything. The hashes of every
masked window of the documents join those of the benchmark items. Around each hit the two texts are aligned
without gaps, and an item is found in a document when some stretch of ``stretch`` aligned words (the whole
item, if shorter) has at least ``percent`` percent equal words. The masks are those of which one at least fits
every such stretch, wherever its unequal words are.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from lexloom.functions.binding import let
from lexloom.plans.scratch import Scratch

#: Fixed masks; ``#`` positions count. These alone miss some stretches that pass, see ``SETS``.
MASKS = ("##.##.###", "###..#.###", "#.###.#.##")
#: Sets of masks, the most selective first; a stretch is looked for by the first set that fits all its patterns.
SETS = ((*MASKS, "####.##"), ("####", "##.##"), ("####", "##.##", "###.#", "#.###"))
#: Patterns of unequal words that are tried, at most; for more of them, a run of equal words is looked for.
TRIED = 100_000
#: Seed hashes of the benchmark that are broadcast, at most (16 bytes each); more of them are shuffled.
BROADCAST_SEEDS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def word_codes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def fits_all(masks: tuple[str, ...], length: int, unequal: int) -> bool:
    """Whether any stretch of ``length`` words, ``unequal`` of them or fewer not equal, fits some mask at some place."""
    placed = {frozenset(i + k for k, c in enumerate(m) if c == "#") for m in masks for i in range(length - len(m) + 1)}
    return all(any(p.isdisjoint(gone) for p in placed) for gone in combinations(range(length), unequal))


def masks_for(length: int, percent: int) -> tuple[str, ...]:
    """Masks of which one at least fits any stretch of ``length`` words with ``percent`` percent equal ones."""
    unequal = length - max(-(-length * percent // 100), 1)
    if comb(length, unequal) <= TRIED:
        for masks in SETS:
            if fits_all(masks, length, unequal):
                return masks
    # The equal words fall into unequal + 1 runs, so the longest has at least this many.
    return ("#" * -(-(length - unequal) // (unequal + 1)),)


def _hashes(codes: Column, mask: str, number: int) -> Column:
    """Hash of each window under one mask; empty for shorter texts."""
    at = [i for i, c in enumerate(mask) if c == "#"]
    steps = F.sequence(F.lit(0), F.size(codes) - len(mask))
    window = lambda i: F.xxhash64(F.lit(number), *[F.get(codes, i + k) for k in at])
    return F.when(F.size(codes) >= len(mask), F.transform(steps, window)).otherwise(F.array().cast("array<bigint>"))


def _seeds(table: DataFrame, key: str, codes: Column, masks: dict[str, int]) -> DataFrame:
    """``key, seed, place``: seeds of word codes by numbered masks; place is the index of the window's first word."""
    laid = let(codes, lambda c: F.struct(F.size(c).alias("n"), F.concat(*[_hashes(c, m, i) for m, i in masks.items()]).alias("seeds")))
    rows = table.select(key, laid.alias("_laid")).select(key, F.col("_laid.n").alias("_n"), F.posexplode("_laid.seeds").alias("_pos", "seed"))
    place, past = F.col("_pos"), F.lit(0)
    for m in masks:
        place = F.when(F.col("_pos") >= past, F.col("_pos") - past).otherwise(place)
        past = past + F.greatest(F.col("_n") - len(m) + 1, F.lit(0))
    return rows.select(key, "seed", place.alias("place"))


def overlaps(docs: DataFrame, benchmark: DataFrame, stretch: int = 13, percent: int = 80) -> DataFrame:
    """Benchmark items found in documents: ``doc_id, item_id, n_equal, n_words``, one row for each such pair.

    ``docs(doc_id, text)``, ``benchmark(item_id, text)``. ``n_equal`` is the most equal words of one
    alignment, ``n_words`` the item's length. Items of few words have seeds of fewer positions, down to the item as a whole (of up to four words all must be equal).
    Null or empty texts and null ids find nothing. Repeated rows of a document or an item count once. Other columns are ignored;
    empty tables give an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = scratch.save(benchmark.where("item_id is not null").select("item_id", word_codes(F.col("text")).alias("codes")).where(F.size("codes") > 0))
    length = F.least(F.lit(stretch), F.size("codes"))
    lengths = [r[0] for r in items.select(length).distinct().collect()]  # of the stretches; at most ``stretch``
    sets: dict[tuple[str, ...], list[int]] = {}
    for n in sorted(lengths, reverse=True):
        sets.setdefault(masks_for(n, percent), []).append(n)
    masks = {m: i for i, m in enumerate(dict.fromkeys(m for chosen in sets or SETS[:1] for m in chosen))}
    # Items of each length have the seeds of their own masks only.
    wanted = [_seeds(items.where(length.isin(ns)), "item_id", F.col("codes"), {m: masks[m] for m in chosen}) for chosen, ns in sets.items()]
    wanted = scratch.save(reduce(DataFrame.union, wanted or [_seeds(items, "item_id", F.col("codes"), masks)]).withColumnRenamed("place", "item_place"))
    texts = docs.where("doc_id is not null")
    seeds = _seeds(texts, "doc_id", word_codes(F.col("text")), masks)
    small = wanted.count() <= BROADCAST_SEEDS
    hits = seeds.join(F.broadcast(wanted) if small else wanted, "seed")
    hits = scratch.save(hits.select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct())

    found = texts.select("doc_id", "text").join(hits.select("doc_id").distinct(), "doc_id").select("doc_id", word_codes(F.col("text")).alias("codes"))
    found = scratch.save(found)
    aligned = hits.join(found, "doc_id").join(items.withColumnRenamed("codes", "item_codes"), "item_id")
    # Words of the document that face the item's; outside the document: none.
    facing = F.transform("item_codes", lambda w, j: F.when(F.get("codes", F.when(F.col("shift") + j >= 0, F.col("shift") + j)) == w, 1).otherwise(0))
    length = F.least(F.lit(stretch), F.size("item_codes"))
    add = lambda s, e: s + e
    best = lambda e: F.array_max(F.transform(F.sequence(F.lit(1), F.size(e) - length + 1), lambda i: F.aggregate(F.slice(e, i, length), F.lit(0), add)))
    judged = aligned.select("doc_id", "item_id", F.size("item_codes").alias("n_words"), let(facing, lambda e: F.struct(best(e).alias("best"), F.aggregate(e, F.lit(0), add).alias("n_equal"))).alias("seen"))
    passed = judged.where(F.col("seen.best") * 100 >= F.least(F.lit(stretch), F.col("n_words")) * percent)
    return passed.groupBy("doc_id", "item_id").agg(F.max("seen.n_equal").alias("n_equal"), F.max("n_words").alias("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, stretch: int = 13, percent: int = 80) -> DataFrame:
    """``docs`` without those in which a benchmark item is found; all columns stay.

    Rows without a doc_id are searched as well, by their texts.
    """
    found = overlaps(docs, benchmark, stretch, percent).select("doc_id").distinct()
    clean = docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    nameless = docs.where("doc_id is null")
    if not nameless.limit(1).count():
        return clean
    leaks = overlaps(nameless.select(F.xxhash64("text").alias("doc_id"), "text").distinct(), benchmark, stretch, percent).select("doc_id").distinct()
    # The key is the only column that the row's struct can meet.
    keyed = nameless.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("text").alias("doc_id"))
    rest = keyed.join(leaks, "doc_id", "left_anti").select("_row.*")
    return clean.where("doc_id is not null").union(rest)
