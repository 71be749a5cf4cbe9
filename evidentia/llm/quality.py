"""Quality classifier on subword embeddings.

Features of a text are its words, its character n-grams (GRAMS, in code points, white space included) and its words' immediate repeats, hashed into 2^BITS buckets, each with a learned vector of DIM
numbers. A document is the average of its features' vectors; a softmax layer gives the probability of label 1. Vectors and
layer are trained together by stochastic gradient descent in numpy on the driver, from a bounded sample of labelled rows
(SAMPLE rows at most, those with the smallest hashes of their ids). The executors turn the sample's texts into
feature counts, at most 2^BITS a document, so no text reaches the driver.

The model is linear in the averaged vectors, so for scoring each bucket is reduced to one number (its part of the logit); all rows
and whole texts are scored in one pass without a shuffle, and the model's size is fixed.

Held out are rows with crc32(id as text) mod 3 = 1: they are never trained on. Only the text goes into a score.

Defined cases: null and empty texts have no features; their score is the layer's bias. A null id is never held out and never
trained on. A label other than 0 and 1 is no label; of an id with several labels the smallest counts, of one with several texts the text
with the least features (in order of their bytes). Repeated rows have equal scores. A text longer than a block is read in pieces. Without any label, and for an empty table, every score is 0.5. Other columns are left aside by score(), kept by accepted().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh, table
from ._text import BLOCK, U, blocks, column_bytes, pieces, word_hashes

BITS, DIM, GRAMS = 15, 16, (3, 4)
#: Labelled rows that training uses at most; epochs and first step of the descent.
SAMPLE, EPOCHS, STEP = 3000, 8, 1.0
#: Bucket of the feature that a word equals the word before it, whatever the word.
REPEAT = 0
SHIFT = np.uint32(32 - BITS)
SPREAD = np.random.default_rng(7).integers(0, 1 << 32, 16, np.uint32) | np.uint32(1)


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """One number for each character of UTF-8 bytes, and for each byte whether it begins one (None: all do)."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), None
    begins = (data & 0xC0) != 0x80
    at = np.flatnonzero(begins)
    out = data[at].astype(np.uint32)
    inside = np.append(~begins, [False] * 3)
    for k in (1, 2, 3):
        more = np.flatnonzero(inside[at + k])
        at, place = at[more], more if k == 1 else place[more]
        out[place] = out[place] << np.uint32(6) | (data[at + k] & 0x3F)
    return out, begins


def _grams(characters: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n characters from each place on."""
    h = np.full(len(characters) - n + 1, n, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h += characters[k : len(characters) - n + 1 + k]
    h *= SPREAD[n]
    h ^= h >> np.uint32(15)
    h *= SPREAD[n + 1]
    return h >> SHIFT


def features(data: np.ndarray, offsets: np.ndarray):
    """For each kind of feature: the buckets in order, and where each text's begin and end. A text longer than BLOCK comes alone and in pieces."""
    if len(offsets) == 2 and len(data) > BLOCK:
        before = np.zeros(0, U)
        for a, b in pieces(data):
            hashes, _ = word_hashes(data[a:b], np.array([0, b - a]))
            yield (hashes >> U(64 - BITS)).astype(np.uint32), np.array([0]), np.array([len(hashes)])
            joined = np.concatenate([before, hashes])
            again = int((joined[1:] == joined[:-1]).sum())
            yield np.full(again, REPEAT, np.uint32), np.array([0]), np.array([again])
            before = joined[-1:]
            own = len(_characters(data[a:b])[0])
            characters, _ = _characters(data[a : b + 4 * max(GRAMS)])
            for n in GRAMS:
                if len(part := characters[: own + n - 1]) >= n:
                    buckets = _grams(part, n)
                    yield buckets, np.array([0]), np.array([len(buckets)])
        return
    hashes, first = word_hashes(data, offsets)
    yield (hashes >> U(64 - BITS)).astype(np.uint32), first[:-1], first[1:]
    again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1 if len(hashes) else np.zeros(0, np.int64)
    yield np.full(len(again), REPEAT, np.uint32), np.searchsorted(again, np.minimum(first[:-1] + 1, first[1:])), np.searchsorted(again, first[1:])
    characters, begins = _characters(data)
    at = offsets if begins is None else np.concatenate([[0], np.cumsum(begins)])[offsets]
    for n in GRAMS:
        if len(characters) >= n:
            buckets = _grams(characters, n)
            yield buckets, np.minimum(at[:-1], len(buckets)), np.maximum(at[1:] - n + 1, np.minimum(at[:-1], len(buckets)))


def counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and their shares of its features."""
    total = np.zeros(1 << BITS, np.int64)
    data = np.frombuffer(text, np.uint8)
    for buckets, a, b in features(data, np.array([0, len(data)])):
        total += np.bincount(buckets[a[0] : b[0]], minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at.astype(np.uint16), (total[at] / max(1, total.sum())).astype(np.float32)


def _counted(batches):
    for batch in batches:
        at, share = zip(*[counts((t.as_py() or "").encode()) for t in batch.column("text")]) if len(batch) else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([s.tobytes() for s in share], pa.binary())], names=["doc_id", "label", "at", "share"])


@dataclass
class Model:
    """part: what each bucket adds to the logit of label 1 at full share; bias: the logit without features."""

    part: np.ndarray
    bias: float


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], *, dim: int = DIM, epochs: int = EPOCHS, step: float = STEP, seed: int = 1) -> Model:
    """rows: (label, buckets, shares)."""
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer, bias = draw.uniform(-1, 1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    if not rows:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    done, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for k in draw.permutation(len(rows)):
            label, at, share = rows[k]
            rate = step * (1 - done / total)
            done += 1
            own = vectors[at]
            hidden = share @ own
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= np.float32(rate * 0.1) * np.outer(hidden, p)
            bias -= np.float32(rate * 0.01) * p
            # A share is a fraction of 1 / features: scaled by their number, as each feature takes its own step.
            vectors[at] = own - (rate * np.minimum(share * len(share), 1))[:, None] * back[None]
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, **how) -> Model:
    """labels has doc_id and label."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~_held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    drawn = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most sample narrow rows: safe to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = texts.mapInArrow(_counted, f"doc_id {kind}, label int, at binary, share binary")
    # Of an id with several texts the least features, so that reruns agree; combined before the shuffle, however often an id occurs.
    rows = counted.groupBy("doc_id", "label").agg(F.min(F.struct("at", "share")).alias("f")).select("doc_id", "label", "f.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([(r.label, np.frombuffer(r.at, np.uint16), np.frombuffer(r.share, np.float32)) for r in rows], **how)


def _scored(model: Model, texts: str):
    part = model.part.astype(np.float64)

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(texts))
            logits = np.full(len(batch), model.bias)
            for i, j, block, at in blocks(data, offsets):
                total, number = np.zeros(j - i), np.zeros(j - i)
                for buckets, a, b in features(block, at):
                    sums = np.zeros(len(buckets) + 1)
                    np.cumsum(part[buckets], out=sums[1:])
                    total += sums[b] - sums[a]
                    number += b - a
                logits[i:j] += total / np.maximum(number, 1)
            score = np.round(1 / (1 + np.exp(-np.clip(logits, -30, 30))), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(_scored(model, "text"), f"doc_id {kind}, text string, score double")
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with predicted 1, with all their columns."""
    (s,) = fresh(docs, "score")
    renamed = {"score": s}

    def run(batches):
        for batch in _scored(model, "text")(batches):
            yield batch.rename_columns([*batch.schema.names[:-1], renamed["score"]])

    schema = docs.schema.simpleString()[len("struct<") : -1]
    whole = docs.mapInArrow(run, f"{schema},{s}:double" if schema else f"{s}:double")
    return whole.filter(F.col(s) >= 0.5).select(*docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return score(docs, train(docs, labels))
