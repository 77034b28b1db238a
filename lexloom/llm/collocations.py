"""Phrases whose words keep company, by dynamic itemset counting over shards of the corpus.

Texts are dealt into shards once, and the shards are read in a cycle, one a step. Words are counted in the first
cycle. A longer phrase is counted from the step after both its subphrases (all but the last word, all but the
first) have reached the threshold, wherever in a cycle that is, until it has seen every shard once; so long
phrases start while shorter ones are still being counted. Reading stops when no phrase has shards left.

The first cycle also sums the occurrences of two-word phrases by a part of their hash, the sieve. A phrase whose
sum stays below the threshold does so itself, so it is never counted by its words; most rare phrases are of this kind.

What has reached the threshold goes to the tasks as Bloom filters of a fixed size. A wrong hit only counts a
phrase that will stay below the threshold: a shard's count of a phrase is the same in any step, and each phrase
marks the shards that it has, so nothing is counted twice. Filters that fill up cost time and no result.
"""

from __future__ import annotations

import gc
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from lexloom.llm.words import WordHashes, mixed
from lexloom.plans.scratch import Scratch

SHARDS = 2
LONGEST = 4
#: Words of one language, about, that a task holds before it counts them.
HELD = 750_000
#: Bits of a filter, a power of two: 8 MiB, whatever the corpus; it is gathered in pieces of so many 64-bit words.
FILTER_BITS, PIECE = 1 << 26, 4096
#: Bits of the sieve's sums that reached the threshold (8 MiB), and those by which more sums are told apart; the first ones deal the sums into pieces.
SIEVE, APART, SIEVE_PIECES = 26, 6, 10
#: A byte that no UTF-8 text holds marks the ends of pieces; tabs become spaces and A-Z a-z.
BREAK = b"\xff"
PIECES = bytes(255 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd multipliers, to tell the places of a phrase and the two probes of a filter apart.
PLACE, PROBE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
COUNTS = "lang string, words int, phrase string, f long"
#: Sums of one piece of the sieve: keys in ascending order, 4 bytes each, and occurrences, one byte each.
SUMS = "piece int, keys binary, times binary"


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Words of translated texts as numbers, 0 before, between and after the pieces, and the words by number."""
    whole = BREAK.join([b"", *texts, b""]).replace(BREAK, b" \xff ")
    found = pc.split_pattern(pa.array([whole], pa.large_binary()), " ").flatten().dictionary_encode()
    numbers = found.indices.to_numpy()  # 0 are the empty words between spaces, 1 the breaks
    return numbers[numbers > 0].astype(np.int64) - 1, found.dictionary.to_pylist()[1:]


class Filter:
    """Bloom filter of two probes over 64-bit hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each probe, the 64-bit word of a filter of ``size`` bits and the mask in it."""
        found = [probe & np.uint64(size - 1) for probe in (hashes, mixed(hashes * PROBE))]
        return [((at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))) for at in found]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for word, mask in self.places(hashes, 64 * len(self.bits)):
            out &= self.bits[word] & mask != 0
        return out


def _hashes(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the phrases that start at some places of a row of word hashes; a word's is its own."""
    if length == 1:
        return hashes[starts]
    out = np.zeros(len(starts), np.uint64)
    for i in range(length):
        out = mixed(out * PLACE + hashes[starts + i])
    return out


def _seed(lang: str, known: WordHashes) -> np.uint64:
    return np.uint64(known[b"lang " + lang.encode()])


def _phrase_hashes(langs: list[str], lengths: np.ndarray, phrases: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of phrases, of each without its last word, and without its first; these two are 0 for words."""
    known, seeds = WordHashes(), {}
    words = " ".join(phrases).encode().split(b" ")
    seed = np.array([seeds[x] if x in seeds else seeds.setdefault(x, _seed(x, known)) for x in langs], np.uint64)
    hashes = mixed(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) ^ np.repeat(seed, lengths))
    own, head, tail = (np.zeros(len(phrases), np.uint64) for _ in range(3))
    first = np.cumsum(lengths) - lengths
    for n in range(1, LONGEST + 1):
        at = np.flatnonzero(lengths == n)
        own[at] = _hashes(hashes, first[at], n)
        if n > 1:
            head[at], tail[at] = _hashes(hashes, first[at], n - 1), _hashes(hashes, first[at] + 1, n - 1)
    return own, head, tail


def _sieve_keys(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << SIEVE + APART) - 1)).astype(np.uint32)


def _in_sieve(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = _sieve_keys(hashes) >> np.uint32(APART)
    return (sieve[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _sums(ids: np.ndarray, hashes: np.ndarray, most: int):
    """Occurrences of two-word phrases by key, in the pieces of the sieve: ``piece, keys, times``; from ``most`` on they count as ``most``."""
    pairs = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    keys, times = np.unique(_sieve_keys(_hashes(hashes[ids], pairs, 2)), return_counts=True)
    times = np.minimum(times, most).astype(np.uint8)
    ends = np.searchsorted(keys >> np.uint32(SIEVE + APART - SIEVE_PIECES), np.arange(1 << SIEVE_PIECES), "right")
    for piece, (begin, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        if begin < end:
            yield piece, keys[begin:end].astype("<u4").tobytes(), times[begin:end].tobytes()


def _sieve(sums: list[DataFrame], most: int) -> np.ndarray:
    """Bits of the sums that reach ``most``: each piece is summed on its own, the driver gets the bits."""
    size = 1 << SIEVE - SIEVE_PIECES

    def summed(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u4")
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint8)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        enough = keys[first[np.add.reduceat(times[order], first, dtype=np.int64) >= most]]
        bits = np.zeros(size, bool)
        bits[(enough >> np.uint32(APART)) & np.uint32(size - 1)] = True
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    all_ = reduce(DataFrame.unionByName, [s.where("piece is not null").select("piece", "keys", "times") for s in sums])
    rows = all_.groupBy("piece").applyInArrow(summed, "piece int, bits binary").toArrow()
    bits = np.zeros((1 << SIEVE_PIECES, size // 8), np.uint8)
    for at, raw in zip(rows.column("piece").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        bits[at] = np.frombuffer(raw, np.uint8)
    return bits.reshape(-1)


def _windows(ids: np.ndarray, words: pa.Array, hashes: np.ndarray, reached: Filter, recent: Filter, sieve: np.ndarray):
    """Counts of one language's phrases that this step counts: ``words, phrases, f``.

    Phrases of one length are numbered by the pair (number of the phrase without its last word, last word), so
    they are told apart exactly.
    """
    # At each place, the number of the phrase that starts there, or -1.
    number, of_number, placed = np.where(ids == 0, -1, ids), hashes, hashes[ids]
    for length in range(2, LONGEST + 1):
        there, late = reached.has(of_number), recent.has(of_number)
        a, b = number[:-1], number[1:]
        here = (a >= 0) & (b >= 0)
        here[here] = there[a[here]] & there[b[here]]
        starts = np.flatnonzero(here)
        if length == 2:
            starts = starts[_in_sieve(sieve, _hashes(placed, starts, 2))]
        counted = late[a[starts]] | late[b[starts]]
        if not counted.all():
            # A phrase that this step does not count is only of use where longer ones may be built on it.
            starts = starts[counted | reached.has(_hashes(placed, starts, length))]
        if not len(starts):
            return
        _, first, inverse, f = np.unique((number[starts] << 32) | ids[starts + length - 1], return_index=True, return_inverse=True, return_counts=True)
        at = starts[first]
        head, tail = number[at], number[at + 1]
        new = _hashes(placed, at, length)
        counted = np.flatnonzero(late[head] | late[tail])
        yield length, pc.binary_join_element_wise(*(words.take(pa.array(ids[at[counted] + i])) for i in range(length)), " "), f[counted]
        number = np.full(len(number) - 1, -1, np.int64)
        number[starts] = inverse
        of_number = new


def _counts(shard: DataFrame, step: int, most: int, filters: tuple[Broadcast, Broadcast, Broadcast] | None) -> DataFrame:
    """Partial counts of a shard, by task and language; without filters, those of words, and the sums of the sieve."""
    held_most = HELD

    def rows(n: int, **columns) -> pa.RecordBatch:
        kinds = {"lang": pa.string(), "words": pa.int32(), "phrase": pa.string(), "f": pa.int64(), "piece": pa.int32(), "keys": pa.binary(), "times": pa.binary()}
        kinds = kinds if filters is None else {c: kinds[c] for c in ("lang", "words", "phrase", "f")}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], list(kinds))

    def emit(lang: str, texts: list[bytes]):
        ids, raw = _numbered(texts)
        hashes = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw)) ^ _seed(lang, WordHashes()))
        words = pa.array([b"", *raw[1:]], pa.binary()).cast(pa.string())
        if filters is None:
            f = np.bincount(ids, minlength=len(raw))[1:]
            yield rows(len(f), lang=[lang] * len(f), words=[1] * len(f), phrase=words[1:], f=f)
            sums = list(_sums(ids, hashes, most))
            if sums:
                yield rows(len(sums), **dict(zip(("piece", "keys", "times"), zip(*sums, strict=True), strict=True)))
            return
        reached, recent, sieve = (b.value for b in filters)
        for length, phrases, f in _windows(ids, words, hashes, Filter(reached), Filter(recent), sieve):
            yield rows(len(f), lang=[lang] * len(f), words=[length] * len(f), phrase=phrases, f=f)

    def run(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = raw.translate(PIECES)
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + text.count(b" ") + text.count(BREAK) + 1
                if sizes[lang] >= held_most:
                    sizes[lang] = 0
                    yield from emit(lang, held.pop(lang))
        for lang, texts in held.items():
            yield from emit(lang, texts)

    return shard.mapInArrow(run, COUNTS if filters else f"{COUNTS}, {SUMS}")


def _filters(state: DataFrame, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the phrases that have reached the threshold, and of those whose longer phrases still have shards left in this step.

    Each task marks its phrases in filters of its own, and these are joined piece by piece; the driver gets the two filters.
    """
    size, piece = FILTER_BITS // 64, min(PIECE, FILTER_BITS // 64)

    def mark(batches):
        bits = np.zeros((2, size), np.uint64)
        for batch in batches:
            hashes = _phrase_hashes(batch.column("lang").to_pylist(), batch.column("words").to_numpy(), batch.column("phrase").to_pylist())[0]
            late = batch.column("reached").to_numpy() > step - SHARDS
            for own, some in zip(bits, (hashes, hashes[late]), strict=True):
                for words, masks in Filter.places(some, 64 * size):
                    np.bitwise_or.at(own, words, masks)
        pieces = bits.reshape(-1, piece)
        used = np.flatnonzero(pieces.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([pieces[i].tobytes() for i in used], pa.binary())], ["piece", "bits"])

    def joined(table: pa.Table) -> pa.Table:
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, piece)
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": [np.bitwise_or.reduce(bits, axis=0).tobytes()]})

    some = state.where(F.col("reached").isNotNull() & (F.col("words") < LONGEST)).select("lang", "words", "phrase", "reached")
    rows = some.mapInArrow(mark, "piece long, bits binary").groupBy("piece").applyInArrow(joined, "piece long, bits binary").toArrow()
    bits = np.zeros((2 * size // piece, piece), np.uint64)
    for at, raw in zip(rows.column("piece").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        bits[at] = np.frombuffer(raw, np.uint64)
    reached, recent = bits.reshape(2, size)
    return reached, recent


def _merged(state: DataFrame | None, found: DataFrame, step: int, min_count: int, filters) -> DataFrame:
    """The state with a step's counts: a shard that a phrase has already is not added again.

    Once a cycle is over, phrases below the threshold that this step no longer counts leave: they are complete,
    or their subphrases have not reached it (should they do so later, all shards are counted from then on).
    """
    none = F.lit(None)
    columns = ["lang", "words", "phrase"]
    rows = found.select(*columns, F.lit(0).cast("long").alias("f"), F.col("f").alias("more"), F.lit(0).alias("seen"), none.cast("int").alias("reached"))
    if state is not None:
        if step > SHARDS:
            reached, recent, _ = filters

            @F.pandas_udf("boolean")
            def counted(lang: pd.Series, words: pd.Series, phrase: pd.Series) -> pd.Series:
                _, a, b = _phrase_hashes(lang.tolist(), words.to_numpy(), phrase.tolist())
                here, late = Filter(reached.value), Filter(recent.value)
                return pd.Series(here.has(a) & here.has(b) & (late.has(a) | late.has(b)))

            rare = state.where((F.col("f") < min_count) & (F.col("words") > 1))
            state = state.where(F.col("f") >= min_count).unionByName(rare.where(counted("lang", "words", "phrase")))
        rows = rows.unionByName(state.withColumn("more", F.lit(0).cast("long")))
    sums = rows.groupBy("lang", "phrase").agg(
        *(F.max(c).alias(c) for c in ("words", "seen", "reached")), F.sum("f").alias("f"), F.sum("more").alias("more")
    )
    bit = 1 << step % SHARDS
    f = F.col("f") + F.when(F.col("seen").bitwiseAND(bit) == 0, F.col("more")).otherwise(0)
    seen = F.when(F.col("more") > 0, F.col("seen").bitwiseOR(bit)).otherwise(F.col("seen"))
    sums = sums.select(*columns, f.alias("f"), seen.alias("seen"), "reached")
    return sums.withColumn("reached", F.coalesce("reached", F.when(F.col("f") >= min_count, F.lit(max(step + 1, SHARDS)))))  # phrases start in the second cycle


def frequent_phrases(docs: DataFrame, min_count: int = 30) -> tuple[DataFrame, DataFrame]:
    """``lang, words, phrase, f`` of all phrases of up to four words with ``f >= min_count``, and ``lang, n`` of all words.

    See ``collocations`` for the words and pieces.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    dealt = texts.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(SHARDS)).cast("int"))
    root = f"{scratch.root}/texts"
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(root)
    shards = spark.read.schema("lang string, text binary, shard int").parquet(root)

    state = totals = filters = sieve = None
    most, sums = max(1, min(min_count, 255)), []
    for step in range(LONGEST * SHARDS):
        if step >= SHARDS:
            reached, recent = _filters(state, step)
            if not recent.any():
                break
            filters = spark.sparkContext.broadcast(reached), spark.sparkContext.broadcast(recent), sieve
        found = _counts(shards.where(F.col("shard") == step % SHARDS).select("lang", "text"), step, most, filters)
        if step < SHARDS:
            sums.append(scratch.save(found))
            found = sums[-1].where("piece is null")
        after = scratch.save(_merged(state, found, step, min_count, filters))
        if state is not None:
            scratch.drop(state)
        for old in filters[:2] if filters else ():
            old.destroy()
        state = after
        if step == SHARDS - 1:
            totals = scratch.save(state.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n")))
            sieve = spark.sparkContext.broadcast(_sieve(sums, most))
            scratch.drop(*sums)
        # The shuffle files of a step go when the driver's heap is swept, which it seldom is by itself.
        found = None
        gc.collect()
        spark._jvm.System.gc()
    sieve.destroy()
    kept = scratch.save(state.where(F.col("f") >= min_count).select("lang", "words", "phrase", "f"))
    scratch.drop(state)
    return kept, totals


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, absorb: int = 80) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's phrases of 2 to 4 words whose parts occur together most.

    ``docs(text, lang)``; a null text is empty, a null language ``und``. With A-Z lower-cased, texts are split at
    ``.,;:!?`` and line ends (bytes 10 to 13) into pieces, and those at spaces and tabs into words; a phrase lies
    within a piece. A phrase with ``a >= min_count`` occurrences is scored at its weakest cut:
    ``floor(2000000 * a / (l + r))``, with the occurrences of the parts (the earlier cut where two are equal). One
    that lies inside a longer phrase of at least ``absorb`` percent of its occurrences is left out. ``n`` counts the
    language's words. The ``top`` of each language go by score, then ``a``, both descending, then phrase in byte
    order. Repeated rows count each; an empty table gives an empty result; other columns are ignored.
    """
    kept, totals = frequent_phrases(docs, min_count)
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    longer = kept.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda side, f: kept.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    big = lambda c: c.cast("decimal(19,0)")
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * big(F.col("a")), big(F.col("l")) + big(F.col("r")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = longer.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    around = inner.groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("around"))
    share = F.coalesce(big(F.col("around")), F.lit(0)) * 100 >= big(F.col("a")) * absorb
    best = scored.join(around, ["lang", "phrase"], "left").where(~share)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
