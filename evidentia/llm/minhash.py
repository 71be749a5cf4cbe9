"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct 5-word shingles. Its sketch has M registers; register i holds
floor(1 - log_b(x_i)) for the smallest x_i of the set's elements, where an element's x_i is exponential with rate RATE and
comes from its i-th hash (SetSketch, Ertl 2021). As registers are minima, sketches of parts merge, and registers agree
about as often as the sets' Jaccard similarity J.

1. One pass over the texts gives each document's set size, a 128-bit digest of the set, the registers and BANDS band keys.
   Documents with equal sets form a class; everything below is on classes.
2. Classes that share a band key are candidates. Within a bucket each class is compared with one pivot, so a bucket of g
   classes gives g - 1 pairs. The joint maximum-likelihood estimate of J from both sketches drops hopeless pairs; the
   others are confirmed on the full sets (the shingle sets of classes that share a bucket, made in a second pass, in which
   a Bloom filter of bounded size keeps the texts of all other documents out of the shuffle).
3. Components of the confirmed links follow (large-star, small-star). Buckets whose classes are still in several components
   go the exact way: blocks of a bucket, bounded in classes and in shingles, meet pairwise and count the common shingles of all
   their classes at once (a matrix product over the frequent shingles, sorted runs of the others). Only links that join
   components are emitted, so no step emits the pairs of a bucket, and no task needs more than two blocks at a time.

A pair at the threshold shares no band with a probability below 1e-6 (below 3e-5 for a threshold of 0.8), and the estimate drops it
with a probability below 1e-6; all else is exact.

Defined cases: null and empty texts, and texts of white space only, have the empty set: they link with nothing and each is
its own component. Fewer words than 5: the whole sequence is the one shingle. A null id has a null component and isn't kept;
if a whole class has null ids, it takes no part in links. Ids must be whole numbers (others are an error). Repeated rows form one class, and of an
id with several texts each is in the class of its own set. A text longer than a block is read in pieces. Other columns are left aside.

without_near_duplicates() decides by row: of the rows with one id and one text in a class that stays one row stays, those with a null id stay
(one for each text) only if no row of their class has an id, and rows without words all stay.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh, table, whole_number_ids, written
from ._text import BLOCK, LOWER, U, blocks, column_bytes, mix, word_hashes
from .components import components

WORDS, PERCENT = 5, 85
#: M registers in bands of WIDTH.
M, BANDS, WIDTH = 80, 20, 4
#: Base, rate and largest value of registers: sets of 1 to 10^6 elements stay inside. Registers of unrelated sets agree with a probability of
#: about log(BASE) / 2, so four of them do in 1 of 10^13 pairs; a coarse base would fill the buckets with chance pairs as the corpus grows.
BASE, RATE, TOP = 1.001, 20.0, 65_533
#: A pair whose estimate is this far below the threshold is 5 standard errors away from it.
MARGIN = 0.25
#: Classes and shingles of a block in the exact way; shingles in more sets than COMMON are counted by a matrix product.
SIDE, HELD, COMMON = 4096, 1 << 21, 24
#: Classes whose intersections are counted at a time, and columns of the matrix product.
STRIP = 512
#: Rows of small buckets that are handled in one call.
CALL = 2000

_draw = np.random.default_rng(20210104)
FLIP = _draw.integers(0, 1 << 64, M, U)
FACTOR = _draw.integers(0, 1 << 64, M, U) | U(1)
PLACE = _draw.integers(0, 1 << 64, 2 * WORDS, U) | U(1)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of texts (bytes, offsets), with repeats, and the offsets of each text's in them."""
    hashes, first = word_hashes(data, offsets, LOWER)
    count = np.diff(first)
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    if not at[-1]:
        return np.zeros(0, U), at
    out = np.zeros(at[-1], U)
    if len(n) == 1:  # one text, maybe a very long one: no table of places
        for k in range(words if count[0] >= words else 0):
            out += hashes[k : k + len(out)] * PLACE[k]
    else:
        padded = np.concatenate([hashes, np.zeros(words, U)])
        place = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
        for k in range(words):
            out += padded[place + k] * PLACE[k]
    for d in np.flatnonzero((count > 0) & (count < words)):  # the whole sequence as one
        own = hashes[first[d] : first[d + 1]]
        out[at[d]] = (own * PLACE[words : words + len(own)]).sum(dtype=U) + U(len(own))
    return mix(out), at


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (uint16, one row for each run of hashes that begins at starts). Minima merge, so one long run goes part by part."""
    least = np.full((len(starts), M), ~U(0), U)
    parts = range(0, len(hashes), BLOCK) if len(starts) == 1 else [0]
    for a in parts:
        part = hashes[a : a + BLOCK] if len(starts) == 1 else hashes
        for i in range(M):
            t = part ^ FLIP[i]
            t *= FACTOR[i]
            np.minimum(least[:, i], np.minimum.reduceat(t, starts if len(starts) > 1 else [0]), out=least[:, i])
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """BANDS signed 64-bit keys for each row of registers."""
    bands = regs.reshape(len(regs), BANDS, WIDTH).astype(U)
    z = np.zeros((len(regs), BANDS), U)
    for k in range(WIDTH):
        z = z << U(16) | bands[:, :, k]
    return mix(mix(z) ^ np.arange(1, BANDS + 1, dtype=U)).view(np.int64)


def _runs(batch: pa.RecordBatch):
    """(first document, distinct shingles of each document) block by block."""
    data, offsets = column_bytes(batch.column("text"))
    for i, j, part, at in blocks(data, offsets):
        hashes, runs = shingles(part, at)
        yield i, j, hashes, runs


def _digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed numbers."""
    d = xxhash.xxh3_128_intdigest(own.data)
    return (d & ((1 << 64) - 1)) - (1 << 63), (d >> 64) - (1 << 63)


def _sketch(batches):
    for batch in batches:
        sizes, low, high, regs, keys = [], [], [], [], []
        for i, j, hashes, runs in _runs(batch):
            for a, b in pairwise(runs.tolist()):
                if a == b:
                    sizes.append(0), low.append(0), high.append(0)
                    continue
                own = np.unique(hashes[a:b])
                d = _digest(own)
                sizes.append(len(own)), low.append(d[0]), high.append(d[1])
            some = np.diff(runs) > 0
            r, k = np.zeros((j - i, M), np.uint16), np.zeros((j - i, BANDS), np.int64)
            if some.any():
                r[some] = registers(hashes, runs[:-1][some])
                k[some] = band_keys(r[some])
            regs.append(r), keys.append(k)
        n = len(batch)
        regs = np.concatenate(regs) if regs else np.zeros((0, M), np.uint16)
        keys = np.concatenate(keys) if keys else np.zeros((0, BANDS), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("version"),
                pa.array(sizes, pa.int64()),
                pa.array(low, pa.int64()),
                pa.array(high, pa.int64()),
                pa.array([r.tobytes() for r in regs], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.ravel(), pa.int64())),
            ],
            names=["doc_id", "version", "n_shingles", "low", "high", "regs", "bands"],
        )


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(U) + U(0x632BE59BD9B4E019))
    return np.stack([h >> U(64 - bits), h & U((1 << bits) - 1)])


def _likely(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of a bigint column: bytes and the logarithm of its bits, from 2^20 to 2^26 (8 MB), by the count.

    The executors fold their ids into words of the filter, so the driver gets no ids and at most 2^20 words.
    """
    bits = min(26, max(20, int(ids.count()).bit_length() + 5))

    def words(batches):
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), bits).ravel()
            word, bit = (at >> U(6)).astype(np.int64), at & U(63)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((U(1) << bit).view(np.int64))], names=["word", "bit"])

    rows = ids.mapInArrow(words, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    filled = np.zeros(1 << (bits - 6), np.int64)
    filled[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    return filled, bits


def _sets(filled: np.ndarray, bits: int):
    """The shingle sets of the documents whose ids may be in the filter; the others' texts go no further than the scan."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id").fill_null(0).to_numpy()
            at = _places(ids, bits)
            likely = ((filled.view(U)[at >> U(6)] >> (at & U(63))) & U(1)).all(0)
            batch = batch.filter(pa.array(likely))
            own = [np.unique(hashes[a:b]) for _, _, hashes, runs in _runs(batch) for a, b in pairwise(runs.tolist())]
            low, high = zip(*map(_digest, own)) if own else ((), ())
            flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, own)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "low", "high", "shingles"]
            )

    return run


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log(1 - x * (BASE - 1) / BASE) / np.log(BASE)


GRID = np.linspace(0, 1, 101)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely J, on a grid, of set pairs with the given registers (rows) and sizes."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    most = np.minimum(u / v, v / u)
    j = np.minimum(GRID[None], most)
    more, less = np.maximum(_p(np.maximum(u - v * j, 0)), 1e-9), np.maximum(_p(np.maximum(v - u * j, 0)), 1e-9)
    same = np.maximum(1 - more - less, 1e-9)
    likely = up * np.log(more) + down * np.log(less) + (a.shape[1] - up - down) * np.log(same)
    return np.take_along_axis(j, likely.argmax(1)[:, None], 1)[:, 0]


def _hopeful(percent: int):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            keep = estimate(a, b, na, nb) >= percent / 100 - MARGIN
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return run


def _linked(percent: int):
    common = F.size(F.array_intersect("sa", "sb"))
    return 100 * common >= percent * (F.size("sa") + F.size("sb") - common)


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are links. Sizes and estimates go first, as they move no sets."""
    c = classes.select("class", "n_shingles", "regs")
    # Sort-merge joins on purpose: a pivot may have very many partners, and only these joins have their hot keys split.
    known = pairs.join(c.toDF("a", "na", "ra"), "a").join(c.toDF("b", "nb", "rb"), "b")
    known = known.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    known = known.mapInArrow(_hopeful(percent), known.select("a", "b").schema)
    return known.join(sets.toDF("a", "sa").hint("merge"), "a").join(sets.toDF("b", "sb").hint("merge"), "b").filter(_linked(percent)).select("a", "b")


def common_counts(sets: list[np.ndarray], wanted: np.ndarray):
    """(rows, counts) strip by strip: for some of the wanted sets, the sizes of their intersections with all sets."""
    n = len(sets)
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    size = np.diff(np.append(begin, len(values)))
    often = size > COMMON
    column = np.repeat(np.where(often, np.cumsum(often) - 1, -1), size)
    width, rare = int(often.sum()), np.repeat((size > 1) & ~often, size)
    few_values, few_rows = values[rare], rows[rare].astype(np.int32)
    held = column >= 0
    rows, column = rows[held].astype(np.int32), column[held].astype(np.int32)
    del values, order, begin, rare, held
    place = np.full(n, -1)
    for k in range(0, len(wanted), STRIP):
        strip = wanted[k : k + STRIP]
        place[:] = -1
        place[strip] = np.arange(len(strip))
        out = np.zeros((len(strip), n), np.float32)
        for c in range(0, width, STRIP):
            here = (column >= c) & (column < c + STRIP)
            dense = np.zeros((n, min(STRIP, width - c)), np.float32)
            dense[rows[here], column[here] - c] = 1
            out += dense[strip] @ dense.T
        mine = place[few_rows] >= 0  # pairs of the strip only, so what is held doesn't grow with their number
        for d in range(1, COMMON):  # the d-th next set with the same shingle
            same = few_values[d:] == few_values[:-d]
            if not same.any():
                break
            for i, j, ours in ((few_rows[:-d], few_rows[d:], mine[:-d]), (few_rows[d:], few_rows[:-d], mine[d:])):
                at = np.flatnonzero(same & ours)
                for part in range(0, len(at), BLOCK):
                    some = at[part : part + BLOCK]
                    np.add.at(out.ravel(), place[i[some]] * n + j[some], np.float32(1))
        yield strip, out


def _block_links(percent: int):
    """Links between components in blocks that meet (side 0 with side 1, or a block with itself), for each bucket of the call."""

    def bucket(pdf: pd.DataFrame) -> list[tuple]:
        classes, comp, side = (pdf[c].to_numpy() for c in ("class", "component", "side"))
        size, alone = pdf["n_shingles"].to_numpy().astype(np.float32), pdf["alone"].iloc[0]
        names, at, number = np.unique(comp, return_inverse=True, return_counts=True)
        # Every pair of two components has a class outside the largest one.
        outside = np.flatnonzero(at != number.argmax())
        parent = list(range(len(names)))

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for strip, common in common_counts(list(pdf["shingles"]), outside):
            i, j = np.nonzero(100 * common >= percent * (size[strip][:, None] + size[None] - common))
            keep = (at[strip[i]] != at[j]) & (alone | (side[strip[i]] != side[j]))
            for a, b in zip(strip[i[keep]].tolist(), j[keep].tolist()):
                x, y = root(at[a]), root(at[b])
                if x != y:
                    parent[x] = y
                    links.append((classes[a], classes[b]))
        return links

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "class"], ignore_index=True)
        links = [link for _, part in pdf.groupby("bucket", sort=False) for link in bucket(part)]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept. Links have 100 * common >= percent * union."""
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = _components(docs, percent).select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_duplicates(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component one row, that of the smallest id."""
    i, v, stays = fresh(docs, "key_id", "key_version", "stays")
    own = F.col("doc_id") == F.col("component")
    stay = F.when(F.col("n_shingles") == 0, True).when(F.col("component").isNull(), True).otherwise(F.coalesce(own, F.lit(False)))
    rows = _components(docs, percent).select("doc_id", "version", "group", stay.alias("stay"), (F.col("n_shingles") > 0).alias("some"))
    rows = rows.groupBy("doc_id", "version", "group").agg(F.bool_and("stay").alias("stay"), (F.bool_or("some") & (F.count("*") > 1)).alias("many"))
    # Several texts of the least id in one component: the text with the least hash stays.
    best = rows.filter("stay and group is not null").groupBy("group").agg(F.min("version").alias("best"), F.count("*").alias("c")).filter("c > 1").drop("c")
    best = written(best, "best")
    if not best.isEmpty():
        rows = rows.join(best.hint("merge"), "group", "left").withColumn("stay", F.col("stay") & F.coalesce(F.col("version") == F.col("best"), F.lit(True)))
    marks = written(rows.filter("not stay or many").select(F.col("doc_id").alias(i), F.col("version").alias(v), F.col("stay").alias(stays)), "marks")
    met = docs["doc_id"].cast("bigint").eqNullSafe(marks[i]) & (F.xxhash64(docs["text"]) == marks[v])
    if marks.filter(F.col(stays)).isEmpty():
        return docs.join(marks, met, "left_anti").select(*docs.columns)
    marked = docs.join(marks, met, "left")
    one = marked.filter(F.col(stays)).dropDuplicates([i, v])
    return marked.filter(F.col(v).isNull()).select(*docs.columns).unionAll(one.select(*docs.columns))


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, version (the text's hash), n_shingles, component (its least id) and group (its number) for each row.

    Both are null for the empty set, and if no row of the class has an id.
    """
    docs = docs.select(whole_number_ids(docs), F.xxhash64("text").alias("version"), "text")
    sketches = written(docs.mapInArrow(_sketch, "doc_id bigint, version bigint, n_shingles bigint, low bigint, high bigint, regs binary, bands array<bigint>"), "sketches")
    same = ["n_shingles", "low", "high"]
    classes = sketches.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("regs").alias("regs"), F.first("bands").alias("bands"))
    classes = written(classes.filter(F.col("id").isNotNull()), "classes")
    # The least id names a class. If an id has several texts and names several classes, all but one of these take a number from their digests.
    several = written(classes.groupBy("id").agg(F.count("*").alias("c"), F.min("low").alias("least")).filter("c > 1").drop("c"), "several")
    one_text = several.isEmpty()
    if one_text:
        classes = classes.withColumn("class", F.col("id"))
    else:
        classes = classes.join(several.hint("merge"), "id", "left").withColumn("class", F.when(F.col("low") != F.col("least"), F.col("low")).otherwise(F.col("id")))
        classes = written(classes.drop("least"), "classes")

    members = classes.select("class", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("held"), F.min("class").alias("pivot")).filter("size > 1")
    members = written(members.join(written(buckets, "buckets"), "bucket"), "members")
    pairs = members.filter("class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct()
    wanted = classes.select("class", "id", "low", "high").join(members.select("class").distinct().hint("merge"), "class")
    wanted = written(wanted.toDF("class", "w_id", "w_low", "w_high"), "wanted")
    sets = docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(_sets(*_likely(wanted.select("w_id"))), "id bigint, low bigint, high bigint, shingles array<bigint>")
    # Grouped as it was joined, without another shuffle.
    sets = sets.join(wanted.hint("merge"), (F.col("id") == F.col("w_id")) & (F.col("low") == F.col("w_low")) & (F.col("high") == F.col("w_high")))
    sets = sets.groupBy("w_id", "w_low", "w_high").agg(F.first("class").alias("class"), F.first("shingles").alias("shingles"))
    sets = written(sets.select("class", "shingles"), "sets")
    links = written(_confirmed(pairs, classes, sets, percent), "links")
    found = written(components(links), "components")

    def placed(found: DataFrame) -> DataFrame:
        """Members of buckets that have classes of several components, with these. Of buckets with the same classes one is enough."""
        own = members.filter("size > 2").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        same = [F.bit_xor(F.xxhash64("class")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(3), "class")).alias("x2")]
        apart = own.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), *same).filter("lo < hi")
        apart = apart.groupBy("n", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket")
        return own.join(written(apart, "apart"), "bucket")

    open_members = written(placed(found), "open")
    if rows := open_members.count():
        more = written(_exact_rest(open_members, sets, percent, max(1, rows // CALL)), "links")
        if not more.isEmpty():
            found = written(components(links.union(more)), "components")

    named = classes.select(*same, "id", "class").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = named.withColumn("group", F.col("component"))
    if not one_text:  # then a component's least number need not be its least id
        least = written(named.groupBy("group").agg(F.min("id").alias("least")), "least")
        named = named.join(least.hint("merge"), "group").withColumn("component", F.col("least"))
    return sketches.join(named.select(*same, "component", "group"), same, "left").select("doc_id", "version", "n_shingles", "component", "group")


def _exact_rest(open_members: DataFrame, sets: DataFrame, percent: int, calls: int) -> DataFrame:
    """Links between components inside buckets, by pairs of blocks; buckets of one block share calls."""
    blocks = F.ceil(F.greatest(F.col("size") / SIDE, F.col("held") / HELD)).cast("int")
    m = open_members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    # Block k meets itself and every other block: as side 0 where it comes first, else as side 1.
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select(
        F.when(F.col("blocks") > 1, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(calls))).alias("call"),
        F.least("block", "other").alias("one"),
        F.greatest("block", "other").alias("two"),
        "bucket", "class", "n_shingles", "component",
        (F.col("block") > F.col("other")).cast("int").alias("side"),
        (F.col("block") == F.col("other")).alias("alone"),
    )
    return m.join(sets.hint("merge"), "class").groupBy("call", "one", "two").applyInPandas(_block_links(percent), "a bigint, b bigint")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
