"""Suffix-array dedup: repeated byte strings by longest-previous-factor arrays.

A string of ``length`` bytes belongs to the window with the smallest hash inside it (its anchor), so equal
strings share an anchor wherever they lie. Each text is cut into runs of starts with one anchor; equal runs
collapse to one. Runs that share an anchor but differ meet in one group, whose suffixes are sorted: the
previous and next smaller positions in suffix order give each start its longest factor that occurs earlier
(and, mirrored, later). A group of more than ``GROUP`` runs is split before: its strings are dealt by where
the anchor lies in them, in ever narrower intervals, and by all the bytes that the strings of an interval have
in common; equal strings still meet, and at the last split they are all that meets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexloom.llm.words import mixed
from lexloom.plans.scratch import Scratch

WINDOW = 100
#: Different runs of one anchor that are sorted together, at most.
GROUP = 2000
#: Intervals of the anchor's place, split after split; the last ones hold a single place.
SPLITS = (8, 64, 1 << 20)
#: Bytes after which a task sorts the groups it has gathered.
BATCH = 1 << 20
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


POWERS, BACK = _powers(BASE, PIECE + 8192), _powers(INVERSE, PIECE + 8192)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` bytes (at most PIECE + 8192 bytes of data)."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * POWERS[: len(data)], dtype=np.uint64)])
    return mixed((sums[width:] - sums[:-width]) * BACK[:n])


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of each window of ``width``, from running minima of blocks in both directions."""
    n = len(keys)
    padded = np.concatenate([keys, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor hash, first start, last start, anchor's place)`` of the runs of starts that share an anchor."""
    data, found = np.frombuffer(text, np.uint8), []
    t = length - WINDOW + 1
    for first in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[first : first + PIECE + length - 1]
        h = window_hashes(part, WINDOW)
        place = np.arange(len(h), dtype=np.uint64)
        least = sliding_least((h & ~np.uint64((1 << 21) - 1)) | place, t)
        at = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
        begin = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        end = np.concatenate([begin[1:], [len(at)]]) - 1
        found.append((h[at[begin]], begin + first, end + first, at[begin] + first))
    if not found:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], [], []]
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if not text or len(text) < length:
                    continue
                anchor, first, last, _ = runs(text, length)
                same = [xxhash.xxh3_64_intdigest(text[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                n = len(anchor)
                for c, v in zip(columns, (anchor.view(np.int64), np.array(same, np.uint64).view(np.int64), np.full(n, doc), np.full(n, key), np.zeros(n), first, last - first + 1), strict=True):
                    c.append(v)
            kinds = [np.int64] * 4 + [np.int32] * 3
            arrays = [pa.array(np.concatenate(c).astype(k)) if c else pa.array(np.zeros(0, k)) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "same", "doc_id", "text_key", "base", "first", "starts"])

    return run


def suffix_ranks(data: np.ndarray, levels: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 8, 16, ... bytes, one array for each of ``levels`` doublings."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    ranks = [np.unique(key, return_inverse=True)[1].astype(np.uint32)]
    for level in range(levels - 1):
        step = 8 << level
        after = np.zeros(n, np.uint64)
        after[: max(0, n - step)] = ranks[-1][step:].astype(np.uint64) + np.uint64(1)
        ranks.append(np.unique((ranks[-1].astype(np.uint64) << np.uint64(32)) | after, return_inverse=True)[1].astype(np.uint32))
    return ranks


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier element that is smaller; -1 where there is none."""
    at = np.arange(len(values)) - 1
    open_ = np.flatnonzero((at >= 0) & (values[at] > values))
    while len(open_):
        at[open_] = at[at[open_]]
        a = at[open_]
        open_ = open_[(a >= 0) & (values[a] > values[open_])]
    return at


def common_prefix(ranks: list[np.ndarray], x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes x and y, to 8 bytes, ``most`` at most; 0 where y is -1."""
    size, ok = np.zeros(len(x), np.int64), y >= 0
    n = len(ranks[0])
    for level in range(len(ranks) - 1, -1, -1):
        step = 8 << level
        for _ in range(2 if level == len(ranks) - 1 else 1):
            a, b = x + size, y + size
            same = ok & (np.maximum(a, b) < n)
            same[same] = ranks[level][a[same]] == ranks[level][b[same]]
            size[same] += step
    return np.minimum(size, most)


def factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start, the longest factor that also begins at an earlier and at a later one of ``starts``.

    Each is capped at ``length`` and exact there; ``length`` bytes must follow every start.
    """
    levels = max(1, (length // 8).bit_length())
    ranks = suffix_ranks(data, levels)
    step = 8 << (levels - 1)
    tail = ranks[-1][starts + max(0, length - step)] if length > step else ranks[-1][starts]
    order = np.lexsort((starts, tail, ranks[-1][starts]))
    position = starts[order]
    longest = []
    for sign in (1, -1):
        value = sign * position
        before = nearest_smaller(value)
        after = nearest_smaller(value[::-1])[::-1]
        after = np.where(after >= 0, len(value) - 1 - after, -1)
        best = np.zeros(len(value), np.int64)
        for near in (before, after):
            other = np.where(near >= 0, position[near], -1)
            best = np.maximum(best, _exact(ranks, tail[order], near, position, other, length, step))
        out = np.zeros(len(value), np.int64)
        out[order] = best
        longest.append(out)
    return longest[0], longest[1]


def _exact(ranks, tail, near, x, y, length, step):
    """Common prefix to 8 bytes below ``length``; ``length`` exactly if head and tail ranks agree."""
    size = np.minimum(common_prefix(ranks, x, y, length), length - 1)
    ok = near >= 0
    whole = ok.copy()
    whole[ok] = (ranks[-1][x[ok]] == ranks[-1][y[ok]]) & (tail[ok] == tail[near[ok]])
    return np.where(whole, length, size)


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


CUT = "anchor long, same long, doc_id long, text_key long, base int, first int, starts int"
PIECES = "anchor long, same long, hot boolean, doc_id long, text_key long, first int, piece binary"
RESULT = "doc_id long, text_key long, first int, starts int, earlier boolean"


def _sorted_groups(length: int):
    """Runs of several anchors at once: equal strings have equal anchors, so groups do not disturb each other."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[2]) for r in rows])
        begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        counts = sizes - length + 1
        starts = np.concatenate([b + np.arange(c) for b, c in zip(begin, counts, strict=True)])
        earlier, later = factors(data, starts, length)
        out, at = [], 0
        for (_, _, _, doc, key, first), c in zip(rows, counts, strict=True):
            e, l = earlier[at : at + c] >= length, later[at : at + c] >= length
            at += c
            for flags, kind in ((e, True), (l & ~e, False)):
                for a, b in zip(*_spans(flags), strict=True):
                    out.append((doc, key, first + a, b - a, kind))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["doc_id", "text_key", "first", "starts", "earlier"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "same", "piece", "doc_id", "text_key", "first")), strict=True):
                if rows and rows[-1][:2] == r[:2]:
                    continue  # a repeated row of the same document
                if size >= BATCH and rows[-1][0] != r[0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[2])
        if rows:
            yield solve(rows)

    return run


def _split(length: int, intervals: int):
    """Runs to shorter ones, of strings in which the anchor's place lies in one interval; their key is what these have in common."""
    places = length - WINDOW + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, doc, key, first, piece in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "text_key", "first", "piece")), strict=True):
                at = int(runs(piece, length)[3][0])
                offset = at - np.arange(len(piece) - length + 1)
                own = offset * intervals // places
                begin = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
                for p, q in zip(begin.tolist(), [*(begin[1:] - 1).tolist(), len(own) - 1], strict=True):
                    k = int(own[p])
                    least, most = -(-k * places // intervals), -(-(k + 1) * places // intervals) - 1
                    common = piece[at - least : at - most + length]
                    group = xxhash.xxh3_64_intdigest(common, seed=(anchor ^ k) & (1 << 64) - 1)
                    out.append((group - (1 << 63), xxhash.xxh3_64_intdigest(piece[p : q + length]) - (1 << 63), doc, key, first, first + p, q - p + 1))
            kinds = [pa.int64()] * 4 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["anchor", "same", "doc_id", "text_key", "base", "first", "starts"])

    return run


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], [], []]
            for doc, key, base, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "base")), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    at = w["first"] - base
                    for c, v in zip(columns, (w["anchor"], w["same"], w["hot"], doc, key, w["first"], text[at : at + w["starts"] + length - 1]), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "same", "hot", "doc_id", "text_key", "first", "piece"])

    return run


def repeated_spans(scratch: Scratch, texts: DataFrame, length: int, earlier_only: bool) -> DataFrame:
    """``texts(doc_id, text_key, text)`` to ``doc_id, text_key, firsts, counts``: starts of repeated strings, as runs.

    With ``earlier_only``, those of strings that also start at an earlier place (by doc_id, then position).
    Runs may overlap and repeat. Tables of a split are deleted once the next one is done.
    """
    texts = texts.withColumn("base", F.lit(0))
    cut, levels = scratch.save(texts.mapInArrow(_cut(length), CUT)), []
    for intervals in (*SPLITS, 0):
        runs_ = scratch.save(cut.groupBy("anchor", "same").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "first", "text_key", "base", "starts")).alias("rep")))
        # Equal runs: every start repeats; the first copy's own starts have no earlier one unless the sort finds it.
        copied = runs_.where("copies > 1").select("anchor", "same", F.col("rep.doc_id").alias("d"), F.col("rep.first").alias("f"))
        equal = cut.join(copied, ["anchor", "same"]).select("doc_id", "text_key", "first", "starts", ((F.col("doc_id") != F.col("d")) | (F.col("first") != F.col("f"))).alias("earlier"))
        # Different runs of one anchor: only the first copy of each goes on.
        sizes = runs_.groupBy("anchor").agg(F.count("*").alias("different")).where("different > 1")
        wanted = runs_.join(sizes, "anchor").select("anchor", "same", (F.col("different") > GROUP).alias("hot"), "rep.doc_id", "rep.text_key", "rep.base", "rep.first", "rep.starts")
        source = ["doc_id", "text_key", "base"]
        per_doc = wanted.groupBy(*source).agg(F.collect_list(F.struct("anchor", "same", "hot", "first", "starts")).alias("wanted"))
        pieces = scratch.save(texts.join(per_doc, source).select(*source, "text", "wanted").mapInArrow(_pieces(length), PIECES))
        by_anchor = pieces.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "first", "same")
        found = equal.unionByName(by_anchor.mapInArrow(_sorted_groups(length), RESULT))
        if earlier_only:
            found = found.where("earlier")
        levels.append(scratch.save(found.groupBy("doc_id", "text_key").agg(F.collect_list("first").alias("firsts"), F.collect_list("starts").alias("counts"))))
        scratch.keep(*levels, pieces)
        hot = pieces.where("hot").dropDuplicates(["anchor", "same"])
        if not intervals or not pieces.where("hot").limit(1).count():
            break
        texts = hot.select("doc_id", "text_key", F.col("first").alias("base"), F.col("piece").alias("text"))
        cut = scratch.save(hot.mapInArrow(_split(length, intervals), CUT))
    scratch.keep(*levels)
    whole = reduce(DataFrame.unionByName, levels)
    return whole.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("firsts")).alias("firsts"), F.flatten(F.collect_list("counts")).alias("counts"))


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, first, starts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("firsts").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                text = text or b""
                if not first:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
                    continue
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, np.array(first), 1)
                np.add.at(edge, np.array(first) + np.array(starts) + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((len(text), int(gone.sum()), len(_spans(gone)[0]), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, keep: str = "first") -> DataFrame:
    """Cut repeated strings of ``length`` bytes from ``docs(doc_id, text)``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in the same document or
    another; with ``keep="first"`` only strings that also start earlier (by doc_id, then position) count, so
    the first copy stays. Strings are judged on the input; matches never cross documents. ``kept`` holds the
    remaining bytes, which may break a character.

    Null and empty texts count as empty, shorter texts keep all. Rows with a null doc_id are left out;
    repeated rows are copies of each other (and under ``keep="first"`` all keep what the first of them
    does). Other columns are ignored; an empty table gives an empty result.
    """
    if keep not in ("first", "none") or length < 2 * WINDOW:
        raise ValueError(f"keep is first or none, length at least {2 * WINDOW}")
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    spans = repeated_spans(scratch, texts, length, keep == "first")
    joined = texts.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "firsts", "counts")
    return joined.mapInArrow(_removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
