"""Exact deduplication by content-defined chunk recipes.

A text (white space runs as one space) is cut where a gear hash of the last 16 bytes has its low bits at zero, so
equal texts have equal cuts. Two passes read the texts, and neither moves a whole one:

1. Each text becomes a *recipe*, the ordered list of its chunks' 64-bit identifiers. Recipes are a few dozen bytes.
2. Each distinct chunk moves once (partial aggregation drops repeats before the shuffle) to the task that owns its
   identifier, where the bytes themselves are compared. An identifier that stands for several chunks is split: such
   chunks get a second number, which is added to the recipes concerned.

Then texts are equal exactly if their recipes are, and a group-by on recipes finds the row that stays. Neither
step gathers a group: group-bys combine before they shuffle, and the joins back are sort-merge joins whose skewed
keys Spark splits (adaptive skew join).

Defined cases: null text is the empty text, with the empty recipe. A null id never wins against another id; a group
of null ids only has keep_id null and its rows count as kept only if they are the group's single row. Rows that
repeat an id and a text are all reported, and of these kept is true on each (they can't be told apart). Other
columns are passed by: the result has only the contract's columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written
from ._text import BLOCK, blocks, column_bytes, squeezed

#: Cuts fall every 1,024 bytes on average, never within 128 bytes of the last; a chunk has 16 KiB at most.
CUT_BITS, LEAST, MOST = 10, 128, 1 << 14
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, np.uint32)


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text; they depend on its bytes alone."""
    n = len(data)
    if not n:
        return []
    marks = []
    for a in range(0, n, BLOCK):  # a block at a time, each with the 15 bytes before it
        before = min(a, 15)
        h = GEAR[data[a - before : a + BLOCK]]
        for shift in (1, 2, 4, 8):  # the hash of 16 bytes by doubling
            h[shift:] += h[:-shift] << np.uint32(shift)
        marks.append(np.flatnonzero((h[before:] & np.uint32((1 << CUT_BITS) - 1)) == 0) + (a + 1))
    ends, last = [], 0
    for at in np.concatenate(marks).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(last := at)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunk_id(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    data, offsets = column_bytes(batch.column("text"))
    for i, j, part, at in blocks(data, offsets):
        clean, at = squeezed(part, at)
        for k in range(j - i):
            yield i + k, clean[at[k] : at[k + 1]]


def _recipes(name: Callable[[bytes], int]):
    def run(batches):
        for batch in batches:
            recipes, shas = [], []
            for _, text in _texts(batch):
                raw = text.tobytes()
                shas.append(hashlib.sha256(raw).hexdigest())
                ends = cuts(text)
                recipes.append([name(raw[a:b]) for a, b in zip([0, *ends], ends)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(recipes, pa.list_(pa.int64()))], names=["doc_id", "text_sha256", "recipe"])

    return run


def _chunks(name: Callable[[bytes], int]):
    def run(batches):
        for batch in batches:
            ids, chunks, size = [], [], 0
            for _, text in _texts(batch):
                raw = text.tobytes()
                ends = cuts(text)
                for a, b in zip([0, *ends], ends):
                    chunk = raw[a:b]
                    ids.append(name(chunk))
                    chunks.append(chunk)
                    size += b - a
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chunks, pa.binary())], names=["chunk_id", "chunk"])
                    ids, chunks, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chunks, pa.binary())], names=["chunk_id", "chunk"])

    return run


def _marks(name: Callable[[bytes], int]):
    """(text_sha256, place, chunk_id, chunk) of every chunk; read only if identifiers collide."""

    def run(batches):
        for batch in batches:
            for _, text in _texts(batch):
                raw = text.tobytes()
                ends = cuts(text)
                chunks = [raw[a:b] for a, b in zip([0, *ends], ends)]
                n = len(chunks)
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(raw).hexdigest()] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(map(name, chunks), pa.int64()), pa.array(chunks, pa.binary())], names=["text_sha256", "place", "chunk_id", "chunk"])

    return run


def exact_duplicates(docs: DataFrame, *, name: Callable[[bytes], int] = chunk_id) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256. name gives a chunk its identifier."""
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    recipes = written(docs.mapInArrow(_recipes(name), f"doc_id {id_type}, text_sha256 string, recipe array<bigint>"), "recipes")

    chunks = docs.select("text").mapInArrow(_chunks(name), "chunk_id bigint, chunk binary").distinct()
    shared = written(chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id"), "shared-ids")
    key = ["recipe"]
    if not shared.isEmpty():
        # Which of the chunks with this identifier: their sha2 orders them.
        split = chunks.join(shared, "chunk_id").select("chunk_id", "chunk")
        marks = docs.select("text").distinct().mapInArrow(_marks(name), "text_sha256 string, place int, chunk_id bigint, chunk binary")
        marks = marks.join(split, ["chunk_id", "chunk"]).select("text_sha256", F.struct("place", F.sha2("chunk", 256).alias("which")).alias("mark"))
        marks = marks.distinct().groupBy("text_sha256").agg(F.array_sort(F.collect_list("mark")).alias("marks"))
        recipes = recipes.join(marks, "text_sha256", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<place:int,which:string>>")))
        recipes = written(recipes, "marked-recipes")
        key = ["recipe", "marks"]

    # Written, so that the join's both sides are plain shuffles, whose hot keys Spark can split; single rows stay out.
    groups = recipes.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    joined = recipes.join(written(groups, "recipe-groups"), key, "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    kept = F.when(F.col("group_size").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)))
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, coalesce(t.doc_id = g.keep_id, false) AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
