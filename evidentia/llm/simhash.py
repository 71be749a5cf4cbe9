"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

A bit of a document's 64-bit fingerprint is set if it is set in over half of the hashes of its word shingles, repeats included.
Documents link if their fingerprints differ in at most BITS bits.

1. One pass over the texts makes the fingerprints. Everything after it is on distinct fingerprints, 8 bytes each.
2. Split into BLOCKS blocks, two fingerprints that differ in BITS bits agree in BLOCKS - BITS blocks at least. So each takes one key for
   every choice of BLOCKS - BITS blocks (20 keys of about 32 bits, short enough to be few and long enough that unrelated fingerprints rarely meet), and only those with a
   common key are compared.
3. Fingerprints of a bucket are compared in one task, a shift of the sorted bucket at a time, and only links that join what isn't joined yet come out.
4. Buckets of more than SIDE fingerprints are dense balls around a common text. There comparing would be squared work; instead each of their
   fingerprints names all values within half of BITS of it: two that name one value are linked to the value's least one. That joins a dense ball at 65
   rows for each fingerprint. Where a large bucket is still in several components, its fingerprints name all values within 1 and within 2 bits, and
   who has a value within 2 is linked to the least one that has it within 1: every pair at 3 bits or fewer meets so. Both are exact and linear, and a value is named by a bounded number of fingerprints.
5. Components of the links, and the least doc_id of each, give component_id.

Defined cases: null and empty texts, and texts of white space only, have fingerprint zero and link like any other. Fewer words than a
shingle: the whole sequence is the one shingle. A null id takes its component's least id, null if nobody there has one. Repeated rows and ids are
reported as often as they occur. A text longer than a block is hashed in strips. An empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written
from ._text import LOWER, blocks, column_bytes, squeezed, word_spans
from .components import components

WORDS, SEED, BITS, BLOCKS = 3, 42, 3, 6
#: Fingerprints of a bucket that are compared with each other; rows of small buckets that are handled in one call.
SIDE, CALL = 4096, 5000
#: Shingles whose bits are counted at a time, and named values that are made at a time.
STRIP = 1 << 16


def fingerprint(text: bytes, starts: list[int], ends: list[int], words: int = WORDS) -> int:
    """Of one text, lower case and with single spaces, whose words have these places."""
    if not starts:
        return 0
    if len(starts) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), STRIP):
        hashes = np.array([h(text[a:b], SEED) for a, b in zip(starts[k : k + STRIP], ends[k : k + STRIP])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            out = []
            for i, j, part, at in blocks(data, offsets):
                clean, at = squeezed(LOWER[part], at)
                starts, ends, first = word_spans(clean, at)
                text = clean.tobytes()
                for k in range(j - i):
                    own = slice(first[k], first[k + 1])
                    out.append(fingerprint(text, starts[own].tolist(), ends[own].tolist(), words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.int64())], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """doc_id and print (bigint, the fingerprint as a signed number) for each row of docs."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_prints(words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print bigint")


def block_masks(bits: int = BITS, n: int = BLOCKS) -> list[int]:
    """Masks (signed) of every choice of n - bits of n blocks of the 64 bits, which differ in width by one bit at most."""
    if not 0 <= bits < n <= 64:
        raise ValueError("bits must be less than the number of blocks, and that at most 64")
    edges = [64 * k // n for k in range(n + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(own[k] for k in chosen) for chosen in combinations(range(n), n - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _bucket_links(bits: int):
    """(a, b) of fingerprints of the same buckets that are close; a spanning forest of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "bucket", "print"], ascending=[False, True, True])
        bucket, size = pdf["bucket"].to_numpy(), pdf["size"].to_numpy()
        values, at = np.unique(pdf["print"].to_numpy(), return_inverse=True)
        parent, label, links = list(range(len(values))), np.arange(len(values)), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for d in range(1, int(size[0])):
            end = int(np.searchsorted(-size, -d))  # rows of buckets of more than d, which come first
            i, j = at[: end - d], at[d:end]
            close = (bucket[: end - d] == bucket[d:end]) & (label[i] != label[j])
            close[close] = np.bitwise_count((values[i[close]] ^ values[j[close]]).view(np.uint64)) <= bits
            joined = False
            for a, b in zip(i[close].tolist(), j[close].tolist()):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((values[a], values[b]))
                    joined = True
            if joined:
                label = np.array(parent)
                while (label[label] != label).any():
                    label = label[label]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _flips(most: int) -> np.ndarray:
    """All 64-bit values with at most so many bits."""
    return np.array([sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(64), n)], np.uint64).view(np.int64)


def _named(most: int):
    flips = _flips(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_numpy()
            step = max(1, STRIP // len(flips))
            for k in range(0, len(prints), step):
                part = prints[k : k + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(flips))), pa.array((part[:, None] ^ flips).ravel())], names=["print", "value"])

    return run


def _stars(prints: DataFrame, bits: int, *, whole: bool) -> DataFrame:
    """Links (a, b) between prints that name one value: both within bits // 2 of it, or, if whole, one within that and the other within the rest of bits."""
    near, far = bits // 2, (bits - bits // 2 if whole else bits // 2)
    centre = F.min(F.when(F.bit_count(F.col("print").bitwiseXOR(F.col("value"))) <= near, F.col("print")))
    # A value is named by a bounded number of distinct prints: as many as there are values within `far` bits.
    named = prints.mapInArrow(_named(far), "print bigint, value bigint").groupBy("value").agg(F.collect_list("print").alias("prints"), centre.alias("b"))
    return named.filter("b is not null and size(prints) > 1").select(F.explode("prints").alias("a"), "b").filter("a <> b").distinct()


def linked_components(prints: DataFrame, *, bits: int = BITS, n_blocks: int = BLOCKS, side: int = SIDE) -> DataFrame | None:
    """(node, component) of the distinct prints that have links; None if no two share a key."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("print").bitwiseAND(F.lit(m))) for k, m in enumerate(block_masks(bits, n_blocks))])
    members = prints.select("print", F.explode(keys).alias("bucket"))
    # Two keys whose hashes agree only make more prints meet: each pair is compared on its bits.
    buckets = written(members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = written(members.join(buckets.hint("merge"), "bucket"), "members")
    small = members.filter(F.col("size") <= side)
    calls = small.count() // CALL + 1
    links = small.withColumn("call", F.pmod(F.xxhash64("bucket"), F.lit(calls))).groupBy("call").applyInPandas(_bucket_links(bits), "a bigint, b bigint")
    large = members.filter(F.col("size") > side)
    dense = not large.isEmpty()
    if dense:
        links = links.union(_stars(large.select("print").distinct(), bits, whole=False))
    links = written(links, "links")
    if links.isEmpty() and not dense:
        return None
    found = written(components(links), "components")
    if dense:
        own = large.join(found.withColumnRenamed("node", "print").hint("merge"), "print", "left").withColumn("component", F.coalesce("component", "print"))
        apart = own.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
        rest = written(own.join(written(apart, "apart").hint("merge"), "bucket").select("print").distinct(), "rest")
        if not rest.isEmpty():
            found = written(components(written(links.union(_stars(rest, bits, whole=True)), "links")), "components")
    return found


def near_duplicates(docs: DataFrame, *, words: int = WORDS, bits: int = BITS, n_blocks: int = BLOCKS, side: int = SIDE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs."""
    rows = written(fingerprints(docs, words=words), "prints")
    prints = written(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints")
    found = linked_components(prints.select("print"), bits=bits, n_blocks=n_blocks, side=side)
    named = prints.select("print", F.col("least").alias("component_id"))
    if found is not None:
        linked = written(found.withColumnRenamed("node", "print").join(prints.hint("merge"), "print"), "linked")
        best = written(linked.groupBy("component").agg(F.min("least").alias("best")), "best")
        linked = written(linked.join(best.hint("merge"), "component").select("print", "best"), "linked")
        named = prints.join(linked.hint("merge"), "print", "left").select("print", F.coalesce("best", "least").alias("component_id"))
    # Written, so that the last join's sides are plain shuffles, whose hot prints Spark can split.
    out = rows.join(written(named, "named").hint("merge"), "print")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
