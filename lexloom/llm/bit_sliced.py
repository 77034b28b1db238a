"""Exact top-k by inner product over a bit-sliced index.

A block of rows holds one bitmap for each bit of each quantised attribute. For a query, the bitmaps of every
attribute enter a carry-save addition once for each set bit of the query's value (complemented for negative
ones), which yields the bitmaps of the scores. The top rows are selected from the most significant score
bitmap downward; rows that tie at the boundary are resolved by id, and the selected rows' scores are then
computed exactly. Row blocks meet query blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

ROWS, QUERIES = 8_192, 4_096
#: Components are held in 64 bits; beyond this, a score cannot be a long.
LARGEST = 2.0**62
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, dim, x``: components as floor(scale * x), packed; vectors with null or non-finite ones drop out."""

    def run(batches):
        for batch in batches:
            ids, dims, packed = [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is None or v is None or None in v:
                    continue
                x = np.floor(np.array(v, np.float64) * scale)
                if len(x) and np.isfinite(x).all():
                    most = np.abs(x).max()
                    if most >= LARGEST:
                        raise ValueError(f"vector {i} has a component of 2**62 or more after scaling")
                    ids.append(i)
                    dims.append(len(x))
                    packed.append(x.astype(np.int32 if most < 2**31 else np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "dim", "x"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, x binary")


class BitSlices:
    """Bitmaps of a block of rows, and of their complements, for each attribute and bit."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        self.low = x.min(axis=0)
        y = (x - self.low).astype(np.uint64)
        self.bits = max(1, int(y.max()).bit_length())
        words = -(-self.n // 64)
        planes = np.zeros((x.shape[1], self.bits, words * 8), np.uint8)
        for b in range(self.bits):
            bit = ((y >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T
            packed = np.packbits(bit, axis=1, bitorder="little")
            planes[:, b, : packed.shape[1]] = packed
        planes = planes.view(np.uint64)
        self.valid = np.zeros(words * 8, np.uint8)
        ones = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        self.valid[: len(ones)] = ones
        self.valid = self.valid.view(np.uint64)
        self.planes = np.concatenate([planes, ~planes & self.valid]).reshape(-1, words)

    def scores(self, q: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the scores, least significant first, up to a constant that all rows share."""
        d = len(q)
        size = np.abs(q)
        # Row of the plane table for (attribute, bit 0): positive values use the bitmaps, negative ones the complements.
        first = (np.arange(d) + np.where(q < 0, d, 0)) * self.bits
        at_weight: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max()).bit_length()):
            chosen = first[(size >> j) & 1 == 1]
            for b in range(self.bits) if len(chosen) else ():
                at_weight.setdefault(j + b, []).append(chosen + b)
        out, carried, w = [], [], 0
        last = max(at_weight, default=-1)
        while w <= last or carried:
            rows = [np.concatenate(at_weight[w])] if w in at_weight else []
            stack = np.concatenate([*(self.planes[r] for r in rows), *carried]) if rows or carried else np.zeros((0, len(self.valid)), np.uint64)
            carried = []
            while len(stack) > 2:
                t = len(stack) // 3
                a, b, c = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t]
                x = a ^ b
                carried.append((a & b) | (x & c))
                stack = np.concatenate([x ^ c, stack[3 * t :]]) if len(stack) > 3 * t else x ^ c
            if len(stack) == 2:
                carried.append((stack[:1] & stack[1:]))
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros(len(self.valid), np.uint64))
            w += 1
        return out

    def top(self, q: np.ndarray, k: int, leave_out: np.ndarray) -> np.ndarray:
        """Indices of the k best rows (all, if fewer) but those in ``leave_out``; ties go to smaller indices."""
        open_ = self.valid.copy()
        for i in leave_out:
            open_[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sure, count = np.zeros_like(open_), 0
        for plane in reversed(self.scores(q)):
            high = open_ & plane
            n = count + int(np.bitwise_count(high).sum())
            if n > k:
                open_ = high
            else:
                sure, count = sure | high, n
                open_ = open_ & ~plane
                if n == k:
                    open_[:] = 0
                    break
        at = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        return np.concatenate([at(sure), at(open_)[: k - count]])


def _unpacked(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * dim else np.int64).astype(np.int64)


def _scores(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products of rows and a query; in Python's integers where 64 bits may not hold them."""
    if x.size == 0 or float(np.abs(x).max()) * float(np.abs(q).max()) * len(q) < 2.0**62:
        return (x @ q).tolist()
    found = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    if any(not -(1 << 63) <= s < 1 << 63 for s in found):
        raise ValueError("a score of the result is no long")
    return found


def _block(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, queries = pdf[~pdf["asks"]].sort_values("vec_id"), pdf[pdf["asks"]]
        if rows.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids = rows["vec_id"].to_numpy()
        dim = int(pdf["dim"].iloc[0])
        x = np.stack([_unpacked(raw, dim) for raw in rows["x"]])
        index, out = BitSlices(x), []
        for q_id, raw in zip(queries["vec_id"], queries["x"], strict=True):
            q = _unpacked(raw, dim)
            own = np.arange(np.searchsorted(ids, q_id, "left"), np.searchsorted(ids, q_id, "right"))
            best = index.top(q, k, own)
            out.append(pd.DataFrame({"query_id": q_id, "vec_id": ids[best], "score": _scores(x[best], q)}))
        return pd.concat(out).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of highest integer inner product for each query.

    ``vectors(vec_id, embedding)``; queries are the rows for which ``is_query`` holds. Rows with the query's
    own id are no candidates; only vectors of the query's length are. Ties go to smaller ids; repeated rows
    each take a rank. Null ids, and vectors that are null, empty or hold a component that is null or not finite
    (after scaling, too) take no part; a component of 2**62 or more, or a score of the result beyond 63 bits, is an error. Fewer than k candidates are all returned; an empty table gives
    an empty result. Other columns are ignored.
    """
    packed = quantised(vectors, scale)
    n = vectors.count()
    row_blocks, query_blocks = max(1, -(-n // rows)), max(1, -(-vectors.where(is_query).count() // queries))
    place = lambda blocks, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    held = packed.select("vec_id", "dim", "x", F.lit(False).alias("asks"), place(row_blocks, 1).alias("rb"), each(query_blocks).alias("qb"))
    asked = packed.where(is_query).select("vec_id", "dim", "x", F.lit(True).alias("asks"), place(query_blocks, 2).alias("qb"), each(row_blocks).alias("rb"))
    best = held.unionByName(asked).groupBy("dim", "rb", "qb").applyInPandas(_block(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
