"""Quality classifier: Naive Bayes support vectors.

N-gram indicators are scaled by the log-count ratio of the two classes; a linear hinge-loss model over the
scaled indicators is fitted by dual coordinate descent. The n-grams are single words, word pairs, and pairs
of word shapes marked with whether the two words are equal and with the share of the text they make up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.llm.words import mixed

#: Rows of each class that the model is fitted on, at most: the first by a hash of their id.
SAMPLE = 3000
DIMENSIONS = 1 << 18
KEPT_WORDS = 1 << 19
ALPHA, COST, EPOCHS = 1.0, 1.0, 12
#: An n-gram seen in fewer sample documents carries no weight.
LEAST_DOCS = 3
SHAPE = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^aA0])\1+"), rb"\1+")]


class WordCodes(dict):
    """Word (bytes) to its hash (high 40 bits) and its shape's hash (low 16 bits)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        shape = word
        for pattern, to in SHAPE:
            shape = pattern.sub(to, shape)
        value = self[word] = (xxhash.xxh3_64_intdigest(word) & ((1 << 40) - 1)) << 16 | xxhash.xxh3_64_intdigest(shape[:8]) & 0xFFFF
        return value


def features(text: bytes | None, known: WordCodes) -> np.ndarray:
    """Distinct hashed n-grams of a whole text; empty for no words."""
    words = text.split() if text else []
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(codes) == 0:
        return np.zeros(0, np.int64)
    word, shape = codes >> np.uint64(16), codes & np.uint64(0xFFFF)
    pairs = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]
    same = (word[:-1] == word[1:]).astype(np.uint64)
    shapes = np.concatenate([shape[:1] << np.uint64(40), (shape[:-1] << np.uint64(17)) + (shape[1:] << np.uint64(1)) + same])
    distinct, counts = np.unique(shapes, return_counts=True)
    share = np.minimum(6, -np.log2(counts / len(words))).astype(np.uint64)
    found = np.concatenate([mixed(word + np.uint64(1)), mixed(pairs ^ np.uint64(2 << 60)), mixed(distinct * np.uint64(16) + share + np.uint64(3 << 61)), mixed(distinct + np.uint64(5 << 60))])
    return np.unique((found % np.uint64(DIMENSIONS)).astype(np.int64))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights over the indicators, and the bias. One class alone gives a constant of its sign, no rows 0."""
    if len(rows) == 0 or labels.min() == labels.max():
        return np.zeros(DIMENSIONS, np.float32), 0.0 if len(rows) == 0 else (1.0 if labels[0] else -1.0)
    seen = [np.full(DIMENSIONS, ALPHA), np.full(DIMENSIONS, ALPHA)]
    for x, y in zip(rows, labels, strict=True):
        seen[int(y)][x] += 1
    number = [np.sum(labels == c) + 2 * ALPHA for c in (0, 1)]
    ratio = np.log(seen[1] / number[1]) - np.log(seen[0] / number[0])
    ratio[seen[0] + seen[1] < LEAST_DOCS + 2 * ALPHA] = 0
    sign = np.where(labels > 0, 1.0, -1.0)
    most = {1.0: COST * len(rows) / (2 * np.sum(sign > 0)), -1.0: COST * len(rows) / (2 * np.sum(sign < 0))}
    data = []
    for x in rows:
        v = ratio[x]
        at = x[v != 0]
        v = ratio[at]
        norm = float(np.sqrt(v @ v)) or 1.0
        data.append((at, v / norm))
    w, bias, dual = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, v = data[i]
            gradient = sign[i] * (w[at] @ v + bias) - 1
            new = min(max(dual[i] - gradient / (v @ v + 1.0), 0.0), most[sign[i]])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                w[at] += step * v
                bias += step
                dual[i] = new
    return np.concatenate([(w * ratio).astype(np.float32), ratio.astype(np.float32)]), float(bias)


def margin(x: np.ndarray, weights: np.ndarray, bias: float) -> float:
    """Signed distance of a document: its scaled indicators have length 1, as in the fit."""
    if len(weights) == DIMENSIONS or len(x) == 0:
        return bias
    r = weights[DIMENSIONS + x]
    norm = float(np.sqrt(r @ r)) or 1.0
    return float(weights[x].sum()) / norm + bias


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, ids, rows, labels = WordCodes(), [], [], []
    for batch in batches:
        ids += batch.column("doc_id").to_pylist()
        labels += batch.column("label").to_pylist()
        rows += [np.frombuffer(x, np.int64) for x in batch.column("x").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], labels[i], len(rows[i])))
    weights, bias = fit([rows[i] for i in order], np.array([labels[i] for i in order]))
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordCodes()
    for batch in batches:
        x = [features(t, known).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.binary())], ["doc_id", "label", "x"])


RESULTS = ("score", "held_out", "predicted")


def held_out():
    """Rows that no model is fitted on: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[bytes, float]:
    """Model of ``labels(doc_id, label)``, without held-out rows, on at most ``sample`` documents of each class.

    The sample is the first rows by a hash of the id. An id with several labels counts with the smallest;
    null labels and ids are left out. The model is a fixed number of weights, whatever the input.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    first = lambda c: marked.where(F.col("label") == c).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    chosen = first(0).union(first(1))
    # At most 2 * sample ids: a proven bound for the broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), "label").mapInArrow(_featured, "doc_id long, label int, x binary")
    model = rows.repartition(1).mapInArrow(_fit_rows, "weights binary, bias double").first()
    return (bytes(model["weights"]), model["bias"]) if model else (np.zeros(DIMENSIONS, np.float32).tobytes(), 0.0)


def score(docs: DataFrame, model: tuple[bytes, float], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score`` (0 to 1), from the whole text; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([*keep, "text"]))
    extra = "text" not in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, bias = sent.value
        weights, known = np.frombuffer(raw, np.float32), WordCodes()
        for batch in batches:
            margins = np.array([margin(features(t, known), weights, bias) for t in batch.column("text").cast(pa.binary()).to_pylist()], float)
            scores = pa.array(1 / (1 + np.exp(-4 * np.clip(margins, -50, 50))))
            kept = batch.drop_columns(["text"]) if extra else batch
            yield pa.RecordBatch.from_arrays([*kept.columns, scores], [*kept.schema.names, "score"])

    source = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep)
    return source.mapInArrow(run, f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 if score is at least 0.5).

    Null and empty texts get the score of the bias. Repeated rows each come back; an empty table stays
    empty; without labelled rows every score is 0.5. Only doc_id and text are read as inputs, doc_id just
    for the join with the labels; other columns named in ``keep`` pass through, but for any named score,
    held_out or predicted, which the results replace.
    """
    keep = [c for c in keep or ["doc_id"] if c not in RESULTS]
    source = docs.drop(*RESULTS)
    scored = score(source, train(source, labels, sample=sample), list(dict.fromkeys([*keep, "doc_id"])))
    scored = scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= 0.5).cast("int")})
    return scored.select(*keep, *RESULTS)


def keep_accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs``, all columns as they are, without the rows that the classifier rejects."""
    own = {c: f"_own_{c}" for c in docs.columns if c in RESULTS}
    renamed = docs.withColumnsRenamed(own)
    accepted = classify(renamed, labels, renamed.columns, sample).where("predicted = 1")
    return accepted.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
