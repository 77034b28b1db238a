"""Adaptive context-mixing range coder for token ids.

A frame of ids begins with its order-0 model: the ids that occur, the most frequent first, and their counts
scaled to a power of two. Inside, ids are ranks in that list. A block is coded on its own: its models start
empty and it carries a checksum. Order 2 predicts the id that last followed the same two ids, order 1 the one
that last followed the same id, each with a confidence that grows with every hit; order 0 is the frame's
model. Which order is right is one event. Two adaptive distributions of it, by the confidences (and whether
the orders agree) and by the two events before, are mixed with a weight that each block learns, and drive the
range coder; an id that no order predicts follows by the frame's counts. The coder has 64 bits of state,
32-bit digits and carries.

Blocks share nothing but the frame's model, so many of them are coded in step, one array operation for all of
them at a time. A distribution is one 64-bit number with both inner bounds of the three events.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1536
#: Blocks that are coded in step, at most.
LANES = 2730
SLOTS1, SLOTS2 = 512, 1024
#: Bits of a distribution's total, of the sum of the two weights, and of both.
TOTAL, WEIGHT = 16, 4
MIXED = TOTAL + WEIGHT
#: Shifts by which the two distributions and the weight learn.
RATES, STEP = (4, 4), 12
#: Of each event: places of its bounds in a distribution (64: none).
LOWER, UPPER = np.array([64, 0, 32], np.uint64), np.array([0, 32, 64], np.uint64)
FIELD = 0xFFFFFFFF
#: Of each total: where the last event ends.
LAST = {b: np.array([0, 0, 1 << b], np.uint64) for b in (TOTAL, MIXED)}
#: Ids after which the distributions learn, and after which a weight does.
LEARNS, EVERY = 2, 8
#: Different ids of a frame, at most: the least width that an event leaves still tells their counts apart.
MOST_IDS = 1 << 19
#: Ids below this are counted and ranked by tables, others by sorting.
DENSE = 1 << 20


def _fields(first: int, second: int) -> int:
    return first | second << 32


#: Of each rate: the mask of what a shift moves into the lower field, and what each event adds to the bounds.
#: A bound moves by its distance over 2**rate; the small steps keep every event possible.
MOVED = [_fields((1 << 32 - r) - 1, (1 << 32 - r) - 1) for r in RATES]
ADDED = [np.array([_fields((1 << TOTAL - r) - 2, (1 << TOTAL - r) - 1), _fields(1, (1 << TOTAL - r) - 1), _fields(1, 2)], np.uint64) for r in RATES]
START = _fields((1 << TOTAL) // 3, 2 * (1 << TOTAL) // 3)
#: Confidence (2 bits) after a hit, by the one before; and, last, after a miss.
SURE = np.array([1, 2, 3, 3, 0], np.uint32)


class _Models:
    """Predictors, distributions and weights of ``n`` blocks. A slot is 0, or rank + 1 and two bits of confidence."""

    def __init__(self, n: int):
        self.order1, self.order2 = np.zeros(n * SLOTS1, np.uint32), np.zeros(n * SLOTS2, np.uint32)
        lane = np.arange(n, dtype=np.int64)
        self.one, self.two = lane * SLOTS1, lane * SLOTS2
        self.by_trust, self.trust = np.full(n * 64, START, np.uint64), lane * 64
        self.by_events, self.events = np.full(n * 16, START, np.uint64), lane * 16
        self.weight, self.steps = np.full(n, 1 << STEP - 1, np.int64), 0
        self.share = (self.weight >> STEP - WEIGHT).astype(np.uint64)
        self.recent = np.full(n, 10, np.int64)
        self.prev1 = self.prev2 = np.zeros(n, np.int64)

    def predict(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of orders 2 and 1 for the first ``m`` blocks, and the mixed bounds of the events."""
        prev1 = self.prev1[:m]
        self.at1 = self.one[:m] + (prev1 & (SLOTS1 - 1))
        self.at2 = self.two[:m] + ((prev1 * 0x9E5 + self.prev2[:m] * 0x3C6F) & (SLOTS2 - 1))
        s1, s2 = self.order1.take(self.at1), self.order2.take(self.at2)
        trust = (s2 & 3) * 4 + (s1 & 3) + ((s2 ^ s1) < 4) * np.uint32(16) + (s2 == 0) * np.uint32(32)
        self.row1, self.row2 = self.trust[:m] + trust, self.events[:m] + self.recent[:m]
        self.c1, self.c2 = self.by_trust.take(self.row1), self.by_events.take(self.row2)
        return s2, s1, (self.c2 << WEIGHT) + (self.c1 - self.c2) * self.share[:m]

    def learn(self, m: int, ranks: np.ndarray, slot: np.ndarray, event: np.ndarray, x2: np.ndarray, x1: np.ndarray) -> None:
        """``slot`` is the slot of ``ranks`` without confidence; ``x2`` and ``x1`` are its bits that differ from the predictions (of a hit: the confidence)."""
        self.steps += 1
        if self.steps % LEARNS == 0:
            self.by_trust[self.row1] = self.c1 - ((self.c1 >> RATES[0]) & MOVED[0]) + ADDED[0].take(event)
            self.by_events[self.row2] = self.c2 - ((self.c2 >> RATES[1]) & MOVED[1]) + ADDED[1].take(event)
        if self.steps % EVERY == 0:
            # The distribution that gave the event more gains weight; neither ever has all or none of it.
            more = (_interval(self.c1, event, TOTAL)[1] > _interval(self.c2, event, TOTAL)[1]).astype(np.int64)
            self.weight = np.clip(self.weight[:m] + (((more << STEP) - self.weight[:m]) >> 5), 1 << STEP - WEIGHT, (1 << STEP) - (1 << STEP - WEIGHT) - 1)
            self.share = (self.weight >> STEP - WEIGHT).astype(np.uint64)
        for table, at, x in ((self.order1, self.at1, x1), (self.order2, self.at2, x2)):
            table[at] = slot + SURE.take(x, mode="clip")
        self.prev2, self.prev1, self.recent = self.prev1, ranks, (self.recent[:m] & 3) * 4 + event


def _interval(bounds: np.ndarray, event: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the events; the total is 2**bits."""
    start = (bounds >> LOWER.take(event)) & FIELD
    return start, ((bounds >> UPPER.take(event)) & FIELD) + LAST[bits].take(event) - start


def order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frame's ids, the most frequent first, and their counts scaled to a sum of a power of two, 1 at least."""
    if ids.max() < DENSE:
        counts = np.bincount(ids)
        found = np.flatnonzero(counts).astype(np.uint32)
        counts = counts[found]
    else:
        found, counts = np.unique(ids, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    found, counts = found[order], counts[order].astype(np.int64)
    bits = max(15, len(found).bit_length() + 1)
    scaled = np.maximum(counts * ((1 << bits) - len(found)) // counts.sum(), 0) + 1
    scaled[0] += (1 << bits) - scaled.sum()
    return found, scaled


class _Order0:
    def __init__(self, counts: np.ndarray):
        self.ends = np.cumsum(np.asarray(counts, np.int64)).astype(np.uint64)
        self.sizes = np.asarray(counts, np.uint64)
        self.starts = self.ends - self.sizes
        self.bits = np.uint64(int(self.ends[-1]).bit_length() - 1)
        self.rank = np.repeat(np.arange(len(self.sizes)), self.sizes.astype(np.int64))  # of each place of the total


def _encode_lanes(rows: np.ndarray, lengths: np.ndarray, model: _Order0) -> list[bytes]:
    """Blocks as rows of ranks, longest first."""
    n, most = rows.shape
    models = _Models(n)
    by_place = np.ascontiguousarray(rows.T)
    low, width = np.zeros(n, np.uint64), np.full(n, 1 << 63, np.uint64)
    room = most * 2 + 4
    out, begin = np.zeros(n * room, np.uint32), np.arange(n) * room
    at = begin.copy()

    def narrow(m, offset, size):
        value = low[:m] + offset
        over = value < offset
        if over.any():
            place = at[:m][over] - 1
            while len(place):
                out[place] += np.uint32(1)
                place = place[out[place] == 0] - 1
        low[:m], width[:m] = value, size
        short = np.flatnonzero(size < 1 << 32)
        if len(short):
            value = low[short]
            out[at[short]] = value >> 32
            at[short] += 1
            low[short] = value << 32
            width[short] = size[short] << 32

    longer = np.searchsorted(-lengths, -np.arange(most), "left")  # number of blocks longer than each place
    for t, m in enumerate(longer.tolist()):
        now = by_place[t, :m]
        s2, s1, bounds = models.predict(m)
        slot = ((now + 1) << 2).astype(np.uint32)
        x2, x1 = s2 ^ slot, s1 ^ slot
        event = np.where(x2 < 4, 0, 2 - (x1 < 4))
        start, size = _interval(bounds, event, MIXED)
        step = width[:m] >> MIXED
        size *= step
        part, drawn = size >> model.bits, event == 2
        narrow(m, step * start + part * (model.starts.take(now) * drawn), np.where(drawn, part * model.sizes.take(now), size))
        models.learn(m, now, slot, event, x2, x1)
    for _ in range(2):
        out[at] = low >> 32
        at += 1
        low <<= np.uint64(32)
    return [out[i:j].astype("<u4").tobytes() for i, j in zip(begin, at, strict=True)]


def _decode_lanes(payloads: list[bytes], lengths: np.ndarray, model: _Order0) -> np.ndarray:
    n, most = len(payloads), int(lengths[0]) if len(lengths) else 0
    room = max(map(len, payloads), default=0) // 4 + 4
    data = np.frombuffer(b"".join(p.ljust(4 * room, b"\0") for p in payloads), "<u4")
    at = np.arange(n) * room
    models = _Models(n)
    code = (data[at].astype(np.uint64) << 32) | data[at + 1]
    at, width = at + 2, np.full(n, 1 << 63, np.uint64)
    out = np.zeros((most, n), np.int64)

    def narrow(m, rest, size):
        code[:m], width[:m] = rest, size
        short = np.flatnonzero(size < 1 << 32)
        if len(short):
            code[short] = (rest[short] << 32) | data.take(at[short], mode="clip")
            at[short] += 1
            width[short] = size[short] << 32

    longer = np.searchsorted(-lengths, -np.arange(most), "left")
    for t, m in enumerate(longer.tolist()):
        s2, s1, bounds = models.predict(m)
        step = width[:m] >> MIXED
        target = np.minimum(code[:m] // step, (1 << MIXED) - 1)
        event = (target >= (bounds & FIELD)).astype(np.int64) + (target >= (bounds >> 32))
        start, size = _interval(bounds, event, MIXED)
        rest = code[:m] - step * start
        size *= step
        part, drawn = size >> model.bits, event == 2
        rank = model.rank.take((rest // part).astype(np.int64), mode="clip")
        now = np.where(drawn, rank, (np.where(event == 0, s2, s1) >> 2).astype(np.int64) - 1)
        narrow(m, rest - part * (model.starts.take(rank) * drawn), np.where(drawn, part * model.sizes.take(rank), size))
        out[t, :m] = now
        slot = ((now + 1) << 2).astype(np.uint32)
        models.learn(m, now, slot, event, s2 ^ slot, s1 ^ slot)
    return out.T


def encode(ids: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids (32 bits) of a frame to its payload, the ends and checksums of its blocks, and its order-0 model (ids, counts)."""
    ids = np.asarray(ids, np.uint32)
    if len(ids) == 0:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    found, counts = order0(ids)
    if len(found) > MOST_IDS:
        raise ValueError(f"a frame has more than {MOST_IDS} different ids")
    if ids.max() < DENSE:
        of_id = np.zeros(int(ids.max()) + 1, np.int64)
        of_id[found] = np.arange(len(found))
        ranks = of_id.take(ids)
    else:
        by_id = np.argsort(found)
        ranks = by_id[np.searchsorted(found[by_id], ids)]
    starts = np.arange(0, len(ids), BLOCK)
    lengths = np.minimum(BLOCK, len(ids) - starts)
    model, payloads = _Order0(counts), []
    for first in range(0, len(starts), LANES):
        part = starts[first : first + LANES]
        rows = np.zeros((len(part), BLOCK), np.int64)
        piece = ranks[part[0] : part[-1] + BLOCK]
        rows.reshape(-1)[: len(piece)] = piece
        own = lengths[first : first + LANES]
        payloads += _encode_lanes(rows[:, : int(own[0])], own, model)
    sums = [zlib.crc32(ids[s : s + n].astype("<u4").tobytes()) for s, n in zip(starts, lengths, strict=True)]
    return b"".join(payloads), np.cumsum([len(p) for p in payloads]), np.array(sums, np.int64), found, counts


def decode(payload: bytes, ends, sums, found, counts, n: int) -> np.ndarray:
    """The ids of a frame of ``n``; raises if a block's checksum differs."""
    if n == 0:
        return np.zeros(0, np.uint32)
    starts = np.concatenate([[0], ends[:-1]]).astype(int) if len(ends) else []
    model, names, out = _Order0(np.asarray(counts)), np.asarray(found, np.uint32), []
    lengths = np.minimum(BLOCK, n - np.arange(0, n, BLOCK))
    for first in range(0, len(lengths), LANES):
        blocks = range(first, min(first + LANES, len(lengths)))
        own = lengths[first : first + LANES]
        rows = _decode_lanes([payload[starts[i] : ends[i]] for i in blocks], own, model)
        for i, row in zip(blocks, rows, strict=True):
            got = names[row[: lengths[i]]]
            if zlib.crc32(got.astype("<u4").tobytes()) != sums[i]:
                raise ValueError(f"block {i} is damaged")
            out.append(got)
    return np.concatenate(out)
