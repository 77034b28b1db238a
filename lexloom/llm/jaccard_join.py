"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles whose sizes lie in one band differ in at most ``k`` elements when they are similar
enough. The hash domain is cut into first-level partitions, each into second-level ones; the sums of the
elements over every sufficiently large subset of second-level partitions are the signatures, and two such
sets always share one. Rows are shuffled by signature, never paired with all others:

1. equal sets collapse to one representative (an aggregation with map-side combine);
2. each bucket of a signature is paired with its member of most shared buckets (a star, linear);
3. buckets that still hold several components are paired between the components, so no link is missed; of
   buckets with the same members one is enough, and large ones are paired in blocks;
4. parity sketches, which never overstate the difference of two sets, rule out most pairs that cannot
   link, and every other pair is verified on the whole shingle sets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.llm.words import WordHashes, mixed, shingle_set
from lexloom.plans.components import components
from lexloom.plans.scratch import Scratch

#: 64-bit words of a set's narrow parity sketch, and the fewest of its wide one, which has a bit or more for each
#: element. Sketches of one width differ in no more bits than their sets in elements.
SKETCH = 8
#: Sets of a bucket that meet in one piece of work; of a larger bucket, every two blocks meet in one.
BLOCK = 2048
#: Partitionings of a band that are tried on a set, at most.
SALTS = 32
#: Shingle sets that a verifying task keeps for centres it meets again.
KEPT_SETS = 256


@lru_cache(8)
def bands(percent: int) -> np.ndarray:
    """Smallest size of each band; the largest of a band is 100/percent times its smallest."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // percent + 1)
    return np.array(low, np.int64)


@lru_cache(4096)
def scheme(percent: int, band: int) -> tuple[int, int, int, int]:
    """``(first-level parts, second-level parts, errors allowed in one part, full parts needed)`` of a band.

    Linked sets differ in at most ``k`` elements, so more than ``errors`` second-level parts differ in at most
    ``k // (errors + 1)`` first-level parts. A first-level part is full for a set if more than ``errors`` of its
    second-level parts hold elements: then each of its signatures covers some. With one full part more than can
    differ, a set shares a signature that is not empty with every set it links with.
    """
    most = int(bands(percent)[band + 1]) - 1
    k = 2 * (100 - percent) * most // (100 + percent)
    if k <= 4:
        return 1, k + 3 if k else 1, k, 1
    need = k // 2 + 1
    return need + need // (12 if percent >= 80 else 4) + 1, 3, 1, need


@lru_cache(4096)
def subsets(percent: int, band: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Subsets of second-level parts, one a row, and a tag for each first-level part (row) and subset (column)."""
    n1, n2, errors, _ = scheme(percent, band)
    chosen = np.array(list(combinations(range(n2), n2 - errors)), np.int64)
    place = np.arange(n1 * len(chosen), dtype=np.uint64).reshape(n1, len(chosen))
    return chosen, mixed(place + np.uint64(band << 48 | salt << 40 | 1))


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set in the instances of its own band and of the next; none of them is empty.

    A partitioning that leaves a set fewer full parts than it needs is followed by another one, whose
    signatures it gives as well, until one suffices. Of two linked sets, the one that stops first shares a
    signature with the other there. Only a set that no partitioning suits adds the empty ones of the last.
    """
    found = []
    own = int(np.searchsorted(bands(percent), len(elements), "right")) - 1
    for band in (own, own + 1):
        n1, n2, errors, need = scheme(percent, band)
        if errors == 0:
            continue  # such sets link only when they are equal, and equal sets have collapsed before
        for salt in range(SALTS):
            chosen, tags = subsets(percent, band, salt)
            spread = mixed(elements + np.uint64((band * 0x9E3779B97F4A7C15 + salt * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1))
            part = (spread % np.uint64(n1 * n2)).astype(np.int64)
            held = np.bincount(part, minlength=n1 * n2).reshape(n1, n2) > 0
            sums = np.zeros(n1 * n2, np.uint64)
            np.add.at(sums, part, spread)
            parts = mixed(sums.reshape(n1, n2) + np.arange(1, n2 + 1, dtype=np.uint64))
            total, any_ = tags.copy(), np.zeros(tags.shape, bool)
            for columns in chosen.T:
                total += parts[:, columns]
                any_ |= held[:, columns]
            enough = int((held.sum(axis=1) > errors).sum()) >= need
            found.append(mixed(total.ravel() if salt == SALTS - 1 and not enough else total[any_]))
            if enough:
                break
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def sketch(elements: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parity of the number of elements that hash to each bit; ``words`` is a power of two."""
    place = (mixed(elements ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * words)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def wide_sketch(elements: np.ndarray) -> np.ndarray:
    """A sketch that grows with the set; half of it folded on the other is the sketch of half its width."""
    return sketch(elements, max(SKETCH, 1 << max(len(elements) - 1, 0).bit_length() >> 6))


def _digest(elements: np.ndarray) -> tuple[int, int]:
    """A set's 128 bits as two signed numbers; zeros for the empty set."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(elements.tobytes())) if len(elements) else (0, 0)


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(x).cast(pa.binary()).to_pylist() if pa.types.is_string(batch.schema.field(x).type) else batch.column(x).to_pylist() for x in names]


def _digests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids, texts = _columns(batch, "doc_id", "text")
            sets = [shingle_set(t, n, known) for t in texts]
            halves = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
            bits = np.array([sketch(s) for s in sets], np.int64).reshape(-1, SKETCH)
            wide = pa.array([wide_sketch(s) for s in sets], pa.list_(pa.int64()))
            arrays = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), *(pa.array(bits[:, i]) for i in range(SKETCH)), wide]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "d0", "d1", *(f"k{i}" for i in range(SKETCH)), "wide"])

    return run


def _signed(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = WordHashes(), set()
        for batch in batches:
            (texts,) = _columns(batch, "text")
            sig, own, size = [], [], 0
            for t in texts:
                s = shingle_set(t, n, known)
                if len(s) == 0 or (digest := _digest(s)[0]) in met:
                    continue
                if len(met) < 1 << 20:
                    met.add(digest)
                sig.append(signatures(s, percent))
                own.append(np.full(len(sig[-1]), digest, np.int64))
                size += len(sig[-1])
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(own))], ["sig", "d0"])
                    sig, own, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(own))], ["sig", "d0"])

    return run


def _verified(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = WordHashes(), {}
        for batch in batches:
            a, b, ta, tb = _columns(batch, "a", "b", "text_a", "text_b")
            linked = []
            for x, y, tx, ty in zip(a, b, ta, tb, strict=True):
                if x not in kept:
                    if len(kept) >= KEPT_SETS:
                        kept.clear()
                    kept[x] = shingle_set(tx, n, known)
                p, q = kept[x], shingle_set(ty, n, known)
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            at = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in at], pa.int64()), pa.array([b[i] for i in at], pa.int64())], ["a", "b"])

    return run


def _verify(scratch: Scratch, docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that are linked."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = scratch.save(docs.join(wanted, "doc_id", "left_semi"))
    full = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    links = scratch.save(full.select("a", "b", "text_a", "text_b").mapInArrow(_verified(n, percent), "a long, b long"))
    scratch.drop(texts)
    return links


def _leaves_room(differ: Column, percent: int) -> Column:
    """Whether ``x`` and ``y`` may link although they differ in ``differ`` elements or more."""
    return differ * (100 + percent) <= (F.col("x.n_shingles") + F.col("y.n_shingles")) * (100 - percent)


def _not_ruled_out(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that their wide sketches do not rule out."""

    def narrowed(bits: Column, other: Column) -> Column:
        for _ in range(((100 + percent - 1) // percent - 1).bit_length()):  # sizes of a pair differ by 100/percent at most
            half = (F.size(bits) / 2).cast("int")
            bits = F.when(F.size(bits) <= F.size(other), bits).otherwise(F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda u, v: u.bitwiseXOR(v)))
        return bits

    x, y = sketches.alias("x"), sketches.alias("y")
    p, q = F.col("x.wide"), F.col("y.wide")
    differ = F.aggregate(F.zip_with(narrowed(p, q), narrowed(q, p), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, v: n + v)
    return pairs.join(x, F.col("a") == F.col("x.rep")).join(y, F.col("b") == F.col("y.rep")).where(_leaves_room(differ, percent)).select("a", "b")


def _buckets(scratch: Scratch, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """``sig, rep, n_shingles``: signatures that several different sets share, one for all of equal members.

    Rows carry a digest of their set, so copies in other tasks fall together in the shuffle by signature.
    """
    by_sig = Window.partitionBy("sig")
    rows = docs.mapInArrow(_signed(n, percent), "sig long, d0 long")
    shared = scratch.save(rows.withColumns({"lo": F.min("d0").over(by_sig), "hi": F.max("d0").over(by_sig)}).where("lo < hi").select("sig", "d0").distinct())
    members = shared.groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor("d0").alias("one"), F.bit_xor(F.xxhash64("d0")).alias("two"))
    kept = members.groupBy("n", "one", "two").agg(F.min("sig").alias("sig")).select("sig")
    buckets = scratch.save(shared.join(kept, "sig", "left_semi").join(classes.select("d0", "rep", "n_shingles"), "d0").select("sig", "rep", "n_shingles"))
    scratch.drop(shared)
    return buckets


def _between(apart: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of a bucket but of different components whose sizes and narrow sketches let them link.

    A bucket of ``n`` rows is cut into blocks; a row goes to the pieces of work that its block takes part in.
    """
    bits = [f"k{i}" for i in range(SKETCH)]
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    drawn = apart.join(sketches.select("rep", *bits), "rep").withColumns({"own": F.pmod(F.xxhash64("rep"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    x, y = drawn.alias("x"), drawn.alias("y")
    differ = sum((F.bit_count(F.col(f"x.{k}").bitwiseXOR(F.col(f"y.{k}"))) for k in bits), F.lit(0))
    size_x, size_y = F.col("x.n_shingles"), F.col("y.n_shingles")
    fits = F.least(size_x, size_y) * 100 >= F.greatest(size_x, size_y) * percent
    meet = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    found = x.join(y, meet & (F.col("x.component") < F.col("y.component")) & fits & _leaves_room(differ, percent))
    return found.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate classes of ``docs(doc_id, text)``: ``doc_id, n_shingles, representative, component_id, n_links``.

    Two documents link when 100 times the intersection of their sets of ``words``-word shingles is at least
    ``percent`` times the union. ``component_id`` is the smallest doc_id reachable by links,
    ``representative`` the smallest with the same set, ``n_links`` the number of verified links between the
    representative and other sets (tests within one component stop once it is known to be one).

    Null and empty texts, and texts without words, have an empty set and link with nothing. A text of fewer
    words is one shingle. Rows with a null doc_id are left out; repeated rows each come back. Other columns
    are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = scratch.save(docs.mapInArrow(_digests(words), "doc_id long, n_shingles long, d0 long, d1 long, " + ", ".join(f"k{i} long" for i in range(SKETCH)) + ", wide array<long>"))
    classes = scratch.save(sets.where("n_shingles > 0").groupBy("n_shingles", "d0", "d1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    copied = classes.where("copies > 1").drop("copies")
    of_class = scratch.save(sets.join(copied, ["n_shingles", "d0", "d1"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))

    buckets = _buckets(scratch, docs, classes, words, percent)
    bits = [f"k{i}" for i in range(SKETCH)]
    sketches = scratch.save(sets.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", *bits, "wide").dropDuplicates(["rep"]))

    by_sig = Window.partitionBy("sig")
    degrees = buckets.groupBy("rep").agg(F.count("*").alias("degree"))
    ranked = buckets.join(degrees, "rep").withColumn("centre", F.max(F.struct("degree", (-F.col("rep")).alias("minus"), "n_shingles")).over(by_sig))
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    stars = ranked.where(-F.col("centre.minus") != F.col("rep")).where(fits(F.col("centre.n_shingles"), F.col("n_shingles"))).select((-F.col("centre.minus")).alias("a"), F.col("rep").alias("b")).distinct()
    tested = scratch.save(_not_ruled_out(stars, sketches, percent))
    links = _verify(scratch, docs, tested, words, percent)
    found = scratch.save(components(scratch, links))

    # Between components that still share a bucket: all pairs that no star has tested and no sketch rules out.
    known = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    apart = scratch.save(known.withColumns({"lo": F.min("component").over(by_sig), "hi": F.max("component").over(by_sig), "n": F.count("*").over(by_sig)}).where("lo < hi").select("sig", "rep", "n_shingles", "component", "n"))
    cross = _between(apart, sketches, percent)
    rest = scratch.save(_not_ruled_out(cross, sketches, percent).join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        links = links.union(_verify(scratch, docs, rest, words, percent))
        found = scratch.save(components(scratch, links))
    counts = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    final = scratch.save(found.withColumnRenamed("node", "rep").join(counts, "rep", "left"))
    scratch.drop(sets, classes, buckets, tested, apart, sketches, rest)
    return of_class.join(final, "rep", "left").select("doc_id", "n_shingles", F.col("rep").alias("representative"), F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the row of the smallest doc_id. Rows without a doc_id all stay."""
    groups = jaccard_components(docs, words, percent)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
