"""Alignment of two tokenizers' tokens by the bytes that they cover.

Both tokenizers read a space and the text, so both token sequences spell the same bytes. Where a token of A and one of B end at the same byte, the
sequences are cut; a group is what lies between two cuts, and the two tokens that end there are a link.

1. One pass over the texts. A block of an Arrow batch is one concatenation of bytes: token lengths, summed, give all ends of A and of B, one
   bincount of each (in strips, for a very long text) gives the bytes where tokens end, and cuts are where both counts are positive. Sums over the concatenation at the
   documents' byte offsets give each document's tokens, groups and links; the canonical text of the groups is written as digits into one buffer. The row keeps its distinct
   id pairs with their numbers, about as many bytes as its text has.
2. The pairs of all documents are counted with partial aggregation, and each B id's highest count is taken (a row for each B id).
3. A second pass over the rows looks the counts up. The most frequent pairs, HEAD at most, are broadcast as sorted arrays; occurrences of other
   pairs, which are rare by definition, go to them in a join and come back as sums by row. Nothing is broadcast that grows with the corpus.

Texts longer than CHUNK characters are tokenized in pieces that end before a space behind another character, where neither tokenizer's tokens can
cross; this is checked on the vocabulary of B and on a probe text, and for A on the form of its file. Otherwise texts are tokenized whole.

Every token covers a byte at least, so each cut has one link: n_links equals n_groups. Defined cases: null and empty texts, and texts that one of the tokenizers doesn't
spell exactly (such as those with U+2581, which B reads as a space), have no tokens: zeros, and '' for the digest. A null id is carried as null. Repeated rows
are each aligned and each counted. An empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written
from .packing import encoder, printable_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Pairs whose counts are broadcast: 17 bytes each.
HEAD = 1 << 19
#: Characters of a piece of a long text, bytes of a block, and bytes whose ends are counted at a time.
CHUNK, BLOCK, STRIP = 1 << 16, 1 << 19, 1 << 22
SPACE = "▁"
PROBE = "It's  naïve—1,234 words\n\n\tthe   end… été 漢字 \U0001f642 <s> <0x0A> <|endoftext|> x "


class Side(NamedTuple):
    """A tokenizer: ids of texts that begin with a space, the bytes of each id, their lengths, and whether texts may be cut before spaces."""

    encode: Callable[[list[str]], list[list[int]]]
    spelled: list[bytes]
    lengths: np.ndarray
    cuts: bool


def _side(encode: Callable[[list[str]], list[list[int]]], spelled: list[bytes], cuts: bool) -> Side:
    probe = [" " + PROBE]
    whole = b"".join(spelled[i] for i in encode(probe)[0])
    parts = b"".join(spelled[i] for ids in encode(cut(probe[0], 8)) for i in ids)
    same = whole == parts == probe[0].encode() and [i for ids in encode(cut(probe[0], 8)) for i in ids] == encode(probe)[0]
    return Side(encode, spelled, np.array([len(s) for s in spelled], np.int64), cuts and same)


@lru_cache
def byte_level(path: str) -> Side:
    """The side of a byte-level BPE file; special tokens' strings are plain text."""
    ids_of, byte = encoder(path, special=False), printable_bytes()
    spec = json.load(open(path, encoding="utf-8"))
    vocab = spec["model"]["vocab"]
    spelled = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        spelled[i] = bytes(byte[c] for c in entry if c in byte)
    return _side(lambda texts: [ids_of(t).tolist() for t in texts], spelled, ids_of.__name__ == "quick")


@lru_cache
def piece_level(path: str) -> Side:
    """The side of a sentence piece model that adds a space in front, so the space is left off."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            spelled.append(bytes([int(piece[3:5], 16)]))
        else:
            spelled.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(SPACE, " ").encode())
    crossing = any(" " in s.lstrip(b" ").decode(errors="replace") for s in spelled)
    return _side(lambda texts: model.encode([t[1:] for t in texts], num_threads=1), spelled, not crossing)


def cut(text: str, size: int = CHUNK) -> list[str]:
    """Pieces of at least size characters (the last may be shorter), each but the first from a space behind another character on."""
    parts, a, at = [], 0, size
    while (at := text.find(" ", at)) >= 0:
        if text[at - 1].isspace():
            at += 1
            continue
        parts.append(text[a:at])
        a, at = at, at + size
    return [*parts, text[a:]]


def tokens(side: Side, texts: list[str]) -> list[list[int]]:
    """Ids of texts, which begin with a space; an empty list where they don't spell the text."""
    parts = [cut(t) if side.cuts and len(t) > CHUNK else [t] for t in texts]
    flat, k, out = side.encode([p for ps in parts for p in ps]), 0, []
    for text, ps in zip(texts, parts):
        ids = flat[k] if len(ps) == 1 else [i for own in flat[k : k + len(ps)] for i in own]
        k += len(ps)
        out.append(ids if b"".join(map(side.spelled.__getitem__, ids)) == text.encode() else [])
    return out


def common_ends(a: np.ndarray, b: np.ndarray, total: int) -> np.ndarray:
    """The byte offsets, in order, where a token of each sequence ends."""
    found = []
    for lo in range(0, total + 1, STRIP):
        size = min(STRIP, total + 1 - lo)
        own = [np.bincount(e[slice(*np.searchsorted(e, (lo, lo + size)))] - lo, minlength=size) for e in (a, b)]
        found.append(np.flatnonzero((own[0] > 0) & (own[1] > 0)) + lo)
    return np.concatenate(found)


def digits(values: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in decimal, each followed by its byte of `after`, as one buffer; and the place of each number in it (n + 1 places)."""
    width = np.ones(len(values), np.int64)
    top = int(values.max()) if len(values) else 0
    for power in range(1, len(str(top))):
        width += values >= 10**power
    at = np.zeros(len(values) + 1, np.int64)
    np.cumsum(width + 1, out=at[1:])
    out = np.empty(at[-1], np.uint8)
    last = at[1:] - 1
    out[last] = after
    rest = values.copy()
    for d in range(len(str(top))):
        some = width > d
        out[last[some] - 1 - d] = 48 + rest[some] % 10
        rest //= 10
    return out, at


class Aligned(NamedTuple):
    """Of each document of a block: tokens of A and B, groups, digest of the groups; and the id pairs of all links with the first link of each document (n + 1 places)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    digests: list[str]
    a: np.ndarray
    b: np.ndarray
    first: np.ndarray


def align(a: list[list[int]], b: list[list[int]], length_a: np.ndarray, length_b: np.ndarray) -> Aligned:
    """Documents given by their ids of A and of B, which spell the same bytes."""
    ids_a, ids_b = (np.array([i for ids in side for i in ids], np.int64) for side in (a, b))
    n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in (a, b))
    first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    end_a, end_b = np.cumsum(length_a[ids_a]), np.cumsum(length_b[ids_b])
    offsets = np.concatenate([[0], end_a])[first_a]  # of the documents, in bytes
    cuts = common_ends(end_a, end_b, int(offsets[-1]))
    first = np.searchsorted(cuts, offsets, side="right")  # groups before each document
    last_a, last_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)  # the tokens that end at each cut
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    # In the canonical text A's tokens of a group come before B's of it.
    place_a = np.arange(len(ids_a)) + np.concatenate([[0], last_b + 1])[group_a]
    place_b = np.arange(len(ids_b)) + last_a[group_b] + 1
    values, after = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    values[place_a], values[place_b] = ids_a, ids_b
    after[place_a[last_a]], after[place_b[last_b]] = ord("|"), ord(";")
    text, at = digits(values, after)
    ends = at[first_a + first_b].tolist()
    digests = [hashlib.sha256(text[s : e - 1].data).hexdigest() if s < e else "" for s, e in zip(ends, ends[1:])]
    return Aligned(n_a, n_b, np.diff(first), digests, ids_a[last_a], ids_b[last_b], first)


ROW = "key bigint, doc_id {}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), piece_level(path_b)
        here = TaskContext.get()
        key, width = (here.partitionId() if here else 0) << 33, len(b.spelled)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            i = 0
            while i < len(texts):
                own, size, start = [], 0, i
                while i < len(texts) and (not own or size < BLOCK):
                    text = texts[i].as_py()
                    own.append(f" {text}" if text else "")
                    size += len(own[-1])
                    i += 1
                some = [k for k, text in enumerate(own) if text]
                in_a, in_b = tokens(a, [own[k] for k in some]), tokens(b, [own[k] for k in some])
                both: tuple[list, list] = ([[] for _ in own], [[] for _ in own])
                for k, x, y in zip(some, in_a, in_b):
                    if x and y:
                        both[0][k], both[1][k] = x, y
                found = align(*both, a.lengths, b.lengths)
                # Distinct pairs of each document.
                doc = np.repeat(np.arange(len(own)), found.n_groups)
                order = np.lexsort((pair := found.a * width + found.b, doc))
                doc, pair = doc[order], pair[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])) if len(doc) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(doc)))
                at = pa.array(np.searchsorted(doc[new], np.arange(len(own) + 1)), pa.int32())
                keys = np.arange(len(own), dtype=np.int64) + key
                key += len(own)
                counts = (pa.array(c) for c in (found.n_a, found.n_b, found.n_groups))
                lists = (pa.ListArray.from_arrays(at, pa.array(v, pa.int64())) for v in (pair[new], times))
                yield pa.RecordBatch.from_arrays([pa.array(keys), ids.slice(start, len(own)), *counts, pa.array(found.digests, pa.string()), *lists], names=["key", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    return run


def _looked_up(head):
    """Sums over the pairs of the head, and the other pairs of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = head.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            at = pairs.offsets.to_numpy() - pairs.offsets[0].as_py() if len(batch) else np.zeros(1, np.int64)
            pair, n = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            place = np.searchsorted(codes, pair)
            known = np.take(codes, np.minimum(place, len(codes) - 1)) == pair if len(codes) else np.zeros(len(pair), bool)
            sums = np.zeros((2, len(pair) + 1), np.int64)
            sums[0, 1:][known] = (n * best[place.clip(max=len(best) - 1)])[known] if len(codes) else 0
            sums[1, 1:][known] = (n * counts[place.clip(max=len(counts) - 1)])[known] if len(codes) else 0
            np.cumsum(sums, axis=1, out=sums)
            n_best, count_sum = (s[at[1:]] - s[at[:-1]] for s in sums)
            left = np.concatenate([[0], np.cumsum(~known)])[at]
            rest = (pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(v[~known])) for v in (pair, n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")), pa.array(n_best), pa.array(count_sum), *rest], names=["key", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum", "pairs", "times"])

    return run


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, count and best (whether no pair of its B id has a higher count). A pair is id of A * width + id of B."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = written(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count")), "pair-counts")
    top = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("top"))  # a row for each id of B: width at most
    return written(counts.join(F.broadcast(top), F.col("pair") % width == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "pairs")


def head_bound(pairs: DataFrame, head: int) -> int:
    """The least power of two (or 1) that so many pairs at most reach with their count."""
    sizes = {r["k"]: r["n"] for r in pairs.groupBy(F.floor(F.log2("count")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    bound, held = max(sizes, default=0) + 1, 0
    while bound > 0 and held + sizes.get(bound - 1, 0) <= head:
        bound -= 1
        held += sizes.get(bound, 0)
    return 1 << bound


def cross_aligned(docs: DataFrame, *, a: str = A, b: str = B, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs. a and b are paths that each executor has."""
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    rows = written(docs.mapInArrow(_aligned(a, b), ROW.format(docs.schema["doc_id"].dataType.simpleString())), "aligned")
    pairs = pair_counts(rows, len(piece_level(b).spelled))
    bound = head_bound(pairs, head)
    often = pairs.filter(F.col("count") >= bound).toArrow().sort_by("pair")
    codes, counts, best = (often.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "count", "best"))
    schema = ROW.format(rows.schema["doc_id"].dataType.simpleString()).replace("pairs array", "n_best bigint, count_sum bigint, pairs array")
    found = rows.mapInArrow(_looked_up(spark.sparkContext.broadcast((codes, counts, best.astype(np.int64)))), schema)
    if bound > 1:
        found = written(found, "looked-up")
        each = found.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
        each = each.join(pairs.filter(F.col("count") < bound).hint("merge"), "pair")
        more = each.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum"))
        found = found.drop("pairs", "times").join(written(more, "rest").hint("merge"), "key", "left")
        found = found.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_aligned(table(spark, sf_dir, "documents"))
