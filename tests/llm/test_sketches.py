"""Signatures are shared by all linked sets, and parity sketches never overstate how far two sets differ."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import jaccard_join
from lexloom.llm.jaccard_join import SKETCH, _not_ruled_out, sketch, wide_sketch


def bits(x):
    return int(np.unpackbits(x.view(np.uint8)).sum())


@pytest.mark.parametrize("n", [0, 1, 63, 512, 513, 1024, 5000])
def test_wide_sketch(n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    b = np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 20, dtype=np.uint64)])
    wide = wide_sketch(a)
    assert len(wide) >= SKETCH and 64 * len(wide) >= n
    half = len(wide) // 2
    assert (wide[:half] ^ wide[half:]).tolist() == sketch(a, half).tolist()
    differ = len(np.setxor1d(a, b))
    assert bits(sketch(a, len(wide)) ^ sketch(b, len(wide))) <= differ


def test_pairs_of_other_widths(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1100, dtype=np.uint64)
    sets = {1: base, 2: base[:1000], 3: rng.integers(0, 1 << 63, 1000, dtype=np.uint64)}
    assert len(wide_sketch(sets[1])) == 2 * len(wide_sketch(sets[2]))
    rows = [(k, len(v), wide_sketch(v).tolist()) for k, v in sets.items()]
    sketches = spark.createDataFrame(rows, "rep long, n_shingles long, wide array<long>")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (2, 3)], "a long, b long")
    kept = _not_ruled_out(pairs, sketches, 80).orderBy("a").select(F.col("a"), F.col("b")).collect()
    assert [tuple(r) for r in kept] == [(1, 2), (2, 1)]


@pytest.mark.parametrize("percent", [75, 80, 90])
def test_linked_sets_share_a_signature(percent):
    """At the very limit of the similarity, for sets of all sizes; and no signature covers no element."""
    draw = np.random.default_rng(percent)
    for size in [*range(2, 40), 60, 100, 200, 500, 2000]:
        for _ in range(10 if size < 500 else 2):
            one = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
            gone = int(draw.integers(0, size * (100 - percent) // 100 + 1))
            added = max(0, (100 * (size - gone) - percent * size) // percent)
            other = np.unique(np.concatenate([one[gone:], draw.integers(0, 1 << 63, added, dtype=np.uint64)]))
            if not np.array_equal(one, other) and len(other):
                assert len(np.intersect1d(jaccard_join.signatures(one, percent), jaccard_join.signatures(other, percent))), (size, gone, added)


def test_unrelated_sets_share_none():
    draw = np.random.default_rng(5)
    seen = [jaccard_join.signatures(np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64)), 80) for n in range(10, 200) for _ in range(5)]
    every = np.concatenate([np.unique(s) for s in seen])
    assert len(np.unique(every)) == len(every)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """Every pair of members meets once, however many blocks a bucket is cut into."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    none = {f"k{i}": F.lit(0).cast("long") for i in range(SKETCH)}
    members = spark.range(20).select(F.lit(7).cast("long").alias("sig"), F.col("id").alias("rep"), F.lit(10).cast("long").alias("n_shingles"), F.col("id").alias("component"), F.lit(20).cast("long").alias("n"))
    sketches = spark.range(20).select(F.col("id").alias("rep"), *[v.alias(k) for k, v in none.items()])
    pairs = [(r.a, r.b) for r in jaccard_join._between(members, sketches, 80).collect()]
    assert sorted(pairs) == [(a, b) for a in range(20) for b in range(a + 1, 20)]
