"""Token-id files: whole texts to ids, in ascending doc_id order, in range-coded blocks.

The files are Parquet tables of frames. A frame holds consecutive documents: their ids and lengths, and the
order-0 model, payload, block ends and checksums of ``token_coder``; a document never crosses a frame.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexloom.llm import token_coder

#: Ids after which a frame is closed.
FRAME = token_coder.BLOCK * token_coder.LANES
#: Distinct words whose ids a Python worker keeps before it starts afresh.
KEPT_WORDS = 700_000
#: Bytes of text that are split into words at once, at least one text.
PIECE = 8 << 20
#: Frames whose offsets are broadcast, at most (some 16 bytes each); more of them are joined.
BROADCAST_FRAMES = 1_000_000
FRAMES = "part int, frame int, doc_ids array<long>, lengths array<int>, n_ids long, ids array<long>, counts array<int>, ends array<long>, checksums array<long>, payload binary"
#: Texts that show whether a tokenizer keeps words apart.
PROBES = ("a b", "Abc def", "don't stop", "x1 2y", "a\tb", "a\nb", "a\x0bb\x0cc\rd", " lead", "trail ", "two  gaps", "é ü", "... !?", "a. b", "the the", "<| |>")

#: Words of such letters are in lower case and composed once these are; an apostrophe may bind what follows it.
LATIN = re.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
PLAIN = re.compile(r"[!-&(-@\[-~\u00DF-\u00F6\u00F8-\u00FF]+")
#: Parts of plain words that a tokenizer may keep apart: letters, single digits, other marks.
PART = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")
#: Parts that are encoded in one call.
PARTS_AT_ONCE = 50_000
#: Of these, parts that are joined to one text.
JOINED = 1000
#: Of each byte of UTF-8: white space 0, letter 1 (all that is not ASCII too), digit 2, mark 3; and its lower case.
KIND, LOWER = np.full(256, 3, np.uint8), np.arange(256, dtype=np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
LOWER[65:91] += 32
#: Bytes of which a plain word has none: apostrophe, controls, and what begins a character beyond U+00FF or below U+00C0.
ODD = np.zeros(256, bool)
ODD[[*range(9), *range(14, 32), 39, 127, *range(0xC0, 0xC3), *range(0xC4, 256)]] = True


def _gather(flat: np.ndarray, ends: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` at some places, one after another, and the end of each."""
    begin = ends[place]
    size = ends[place + 1] - begin
    last = np.cumsum(size)
    return flat[np.repeat(begin - last + size, size) + np.arange(int(last[-1]) if len(last) else 0)], last


class WordIds:
    """Ids of texts, from the ids of their words (runs without ASCII white space), each of which is encoded once.

    That holds for tokenizers that drop white space and have no rule that reaches across it, which is tried
    on some texts at the start; with any other tokenizer texts are encoded whole. If the tokenizer also keeps the
    parts of plain words apart, which is tried on every mark, its model encodes each different part once; if it drops the
    case of Latin letters too, texts are split into such parts at once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on every core already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.apart = all(encode(t) == [i for w in t.encode().split() for i in encode(w.decode())] for t in PROBES)
        both = lambda a, b: encode(a) == encode(b)
        self.fold = both("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # it lower-cases
        self.fold_latin = self.fold and all(both(f"{chr(c)}x{chr(c)}", f"{chr(c + 32)}x{chr(c + 32)}") for c in range(0xC0, 0xDF) if c != 0xD7)
        added = [re.escape(t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)")
        self.added_bytes = re.compile("|".join(added).encode() or b"(?!)")
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}  # the other characters of parts stand for themselves
        self.model, self.joined = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.joined.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # Where a mark ends every word of the model, ids tell where parts end.
        mark, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if mark and t.endswith(mark)]] = True
        marks = [c for c in map(chr, [*range(33, 127), *range(0xDF, 0x100)]) if PLAIN.fullmatch(c)]
        probes = [w for a in marks for b in ("a", "1", ",", "\u00e9", "<", a) for w in (a + b, b + a, b + a + b, b + b + a + a)] + ["abc123def", "!?a1!?", "x--y", "\u00e9t\u00e9s,", "n.b."]
        probes = [w for w in probes if not self.added.search(w)]
        self.parts_apart = self.apart and all(e.ids == own for e, own in zip(self.tokenizer.encode_batch_fast(probes, add_special_tokens=False), self._by_parts(probes), strict=True))
        self.split = self.parts_apart and self.fold_latin
        self.start()

    def _encode_parts(self, different: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after another, and the end of each."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        different = [p if p.isascii() else p.translate(self.bytes) for p in different]
        for first in range(0, len(different), PARTS_AT_ONCE):
            some = different[first : first + PARTS_AT_ONCE]
            texts = [" ".join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)]
            found = np.fromiter(chain.from_iterable(e.ids for e in self.joined.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
            ends = np.flatnonzero(self.last[found])
            if len(ends) == len(some) and ends[-1] == len(found) - 1:
                ids.append(found)
                sizes.append(np.diff(ends, prepend=-1))
                continue
            encoded = self.model.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(encoded.ids, np.uint32))
            sizes.append(np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def _parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words from those of their parts, one after another, and the end of each word."""
        found = [PART.findall(w) for w in words]
        numbers: dict[str, int] = {}
        which = np.fromiter((numbers.setdefault(p, len(numbers)) for parts in found for p in parts), np.int64)
        ids, ends = self._encode_parts(list(numbers))
        flat, last = _gather(ids, np.concatenate([[0], ends]), which)
        return flat, last[np.cumsum([len(p) for p in found]) - 1] if found else last

    def _by_parts(self, words: list[str]) -> list[list[int]]:
        try:
            flat, ends = self._parts(words)
        except Exception:  # noqa: BLE001  a model that cannot stand alone
            return [[]] * len(words)
        return [x.tolist() for x in np.split(flat, ends[:-1])]

    def start(self) -> None:
        self.places: dict[str, int] = {}
        self.n = 0
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _key(self, word: str) -> str:
        """A word in lower case where case makes no difference: added tokens are matched, and characters composed, before it is dropped."""
        if not self.fold or not (word.isascii() or self.fold_latin and LATIN.fullmatch(word)):
            return word
        lower = word.lower()
        return word if self.added.search(lower) else lower

    def _plain(self, word: str) -> bool:
        return self.parts_apart and PLAIN.fullmatch(word) is not None and not self.added.search(word)

    def _encode(self, words: list[str], plain: np.ndarray) -> None:
        """Append the ids of new words, some of them plain, to the store."""
        parts, part_ends = (self._encode_parts if self.split else self._parts)([w for w, p in zip(words, plain, strict=True) if p])
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False)]
        whole = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        held = np.concatenate([np.fromiter(chain.from_iterable(found), np.uint32), parts])
        ends = np.concatenate([[0], whole, part_ends + len(held) - len(parts)])
        place = np.empty(len(words), np.int64)
        place[~plain], place[plain] = np.arange(len(found)), np.arange(len(found), len(words))
        flat, stops = _gather(held, ends, place)
        last = self.n + len(words)
        if last >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(last, np.int64)])
        begin = int(self.ends[self.n])
        self.ends[self.n + 1 : last + 1] = begin + stops
        end = int(self.ends[last])
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(end, np.uint32)])
        self.flat[begin:end] = flat
        self.n = last

    def _place(self, words: list[str]) -> np.ndarray:
        """Places of different words in the store; what is new is encoded in one go."""
        places, new, plain = self.places, [], []
        found = np.fromiter(map(places.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(found < 0).tolist():
            w = words[i]
            # Parts are in lower case already; whole words are not taken for parts.
            ready = self.split and PART.fullmatch(w) is not None and self._plain(w)
            key = w if ready else self._key(w)
            at = None if ready else places.get(key)
            if at is None:
                at = places[key] = self.n + len(new)
                new.append(key)
                plain.append(ready if self.split else self._plain(key))
            found[i] = places[w] = at
        if new:
            self._encode(new, np.array(plain))
        return found

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts of the texts' plain words, in lower case, and their other words whole; and how many come before each text and the end."""
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        if not len(raw):
            return pa.array([], pa.string()), np.zeros(len(at), np.int64)
        data, kind, odd = LOWER[raw], KIND[raw], ODD[raw]
        latin = np.flatnonzero(raw[:-1] == 0xC3) + 1
        second = raw[latin]
        odd[latin[(second == 0x97) | (second == 0xB7)]] = True
        data[latin] = np.where(second < 0x9F, second + np.uint8(0x20), second)
        for m in self.added_bytes.finditer(data.tobytes()):
            odd[m.start() : m.end()] = True  # also across two texts, whose words are whole then
        black = kind > 0
        first = np.ones(len(raw), bool)
        first[1:] = ~black[:-1]
        first[at[:-1][at[:-1] < len(raw)]] = True
        first &= black
        begin = np.empty(len(raw), bool)
        begin[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begin[1:])
        begin = (begin | (kind == 2) | first) & black
        # From here on without white space: begins of words and of parts.
        places = np.cumsum(black, dtype=np.int32)
        total = int(places[-1])
        tokens = np.flatnonzero(begin)
        of_word = first[tokens]
        words = places[tokens[of_word]] - 1
        strange = np.zeros(len(words), bool)
        strange[np.searchsorted(words, places[np.flatnonzero(odd & black)] - 1, "right") - 1] = True
        data = data[black]
        if strange.any():
            data = np.where(np.repeat(strange, np.diff(words, append=total)), raw[black], data)
            tokens = tokens[of_word | ~strange[np.cumsum(of_word) - 1]]
        offsets = np.append(places[tokens] - 1, total).astype(np.int32)
        return pa.StringArray.from_buffers(len(tokens), pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(tokens, at)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after another, and the number of each."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.apart:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes
        if self.n > KEPT_WORDS:
            self.start()
        if self.split:
            words, before = self._split(texts)
        else:
            parts = pc.ascii_split_whitespace(texts)
            words, before = parts.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
        words = words.dictionary_encode()
        place = self._place(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy(zero_copy_only=False)]
        flat, ends = _gather(self.flat, self.ends, place)
        of_text = np.concatenate([[0], ends])[before]
        return flat, np.diff(of_text)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE bytes."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(total):
        past = (total[first - 1] if first else 0) + PIECE
        last = max(first + 1, int(np.searchsorted(total, past, "right")))
        yield first, last
        first = last


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """The store of a Python worker, for all its tasks."""
    return WordIds(path)


def _frames(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, frame = word_ids(path), TaskContext.get().partitionId(), 0
        docs: list[int] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            payload, ends, sums, found, counts = token_coder.encode(np.concatenate(held))
            row = {"part": part, "frame": frame, "doc_ids": docs, "lengths": lengths, "n_ids": size, "ids": found.tolist(), "counts": counts.tolist(), "ends": ends.tolist(), "checksums": sums.tolist(), "payload": payload}
            many, few = pa.list_(pa.int64()), pa.list_(pa.int32())
            kinds = [pa.int32(), pa.int32(), many, few, pa.int64(), many, few, many, many, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for first, last in _pieces(texts):
                flat, counts = words.ids(texts[first:last])
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end_id)
                lengths += (counts + 1).tolist()
                docs += ids[first:last]
                held.append(flat)
                size += len(flat)
                if size >= FRAME:
                    yield close()
                    docs, lengths, held, size, frame = [], [], [], 0, frame + 1
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of ``docs(doc_id, text)`` to ``path``, ascending by doc_id, ``end_id`` after each document.

    Null and empty texts are the end id alone. Rows of equal doc_id follow one another in the order of their
    texts; rows with a null doc_id come first. Other columns are ignored; an empty table writes no frame.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_frames(tokenizer, end_id), FRAMES).write.mode("overwrite").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = token_coder.decode(r["payload"], r["ends"], r["checksums"], r["ids"], r["counts"], r["n_ids"])
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(r["lengths"])
            begins = ends - r["lengths"]
            sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
            n = len(sums)
            columns = [pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["frame"], np.int32)), pa.array(r["doc_ids"], pa.int64()), pa.array(begins, pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "frame", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files at ``path``: ``doc_id, start, n_tokens, ids_crc32``, every block decoded and checked."""
    frames = spark.read.schema(FRAMES).parquet(path)
    sizes = frames.select("part", "frame", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each written file; the frames of a file are few and its own.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("frame")) - F.col("n_ids")
    offsets = sizes.select("part", "frame", inside.alias("inside")).join(before, "part").select("part", "frame", (F.col("before") + F.col("inside")).alias("offset"))
    docs = frames.mapInArrow(_documents, "part int, frame int, doc_id long, at long, n_tokens long, ids_crc32 long")
    few = sizes.count() <= BROADCAST_FRAMES
    return docs.join(F.broadcast(offsets) if few else offsets, ["part", "frame"]).select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
