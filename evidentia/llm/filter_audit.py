"""Which document filters do what, in every order: Shapley values and losses from removal polynomials.

A document fails a set of filters, its mask, and filters applied one after the other remove it at the first of them that it fails. So
all that happens to a part of the corpus in any order follows from how many of its documents have each mask: 2^k counts.

1. One pass over the texts gives each document its mask (words, capitals, symbols) and the SHA-256 of its text; a group-by on the
   digests and a join to the groups of several rows add the filter on repeats.
2. A group-by with partial aggregation makes the counts of each part. What is left is at most 2^k rows for each part, whatever its size.
3. For each part the counts give its removal polynomial, the multilinear extension of "documents removed by a set of filters":
   R(x) = N - sum over masks m of n(m) * product over i in m of (1 - x_i), in monomials. Its value at a corner (0/1 for each filter) is
   what a set of filters removes: all columns of an order's steps are differences of such corners. The Shapley value of filter i is the
   integral of dR/dx_i along the diagonal, here a sum of exact rationals; times k! it is a whole number, the removals summed over all orders.

Defined cases: null text is the empty text; a null source is the part ''. A null id is never a repeat (it has no smaller id) and has no label, nor makes
another row a repeat. Rows that repeat an id and a text are not repeats of each other, as neither id is smaller. Several label rows of an id count as
one, marked if any of them is. An empty table gives no rows; other columns are left aside. A text longer than a block is read in pieces; what
stays of it is its distinct words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written
from ._text import column_bytes, pieces

#: The filters' letters; letter i is bit i of a mask.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that begin no code point.
INNER = bytes(range(0x80, 0xC0))
REPEATED = 1 << LETTERS.index("E")


def mask_of(text: bytes) -> int:
    """The filters on the text alone (A to D) that it fails."""
    n, seen = 0, set()
    for a, b in pieces(np.frombuffer(text, np.uint8)):
        words = text[a:b].split()
        n += len(words)
        seen.update(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, INNER))
    failed = n < LEAST_WORDS, 100 * len(seen) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, len(text.translate(None, SYMBOLS)) < len(text)
    return sum(1 << i for i, fails in enumerate(failed) if fails)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        masks, digests = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text = data[a:b].tobytes()
            masks.append(mask_of(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (int) for each row of docs (doc_id, text, source)."""
    docs = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    rows = written(docs.mapInArrow(_masked, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary"), "masks")
    # Written, so that the join's sides are plain shuffles, whose hot digests Spark can split.
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    repeated = F.when(F.col("doc_id") > F.col("first"), REPEATED).otherwise(0)
    return rows.join(first.hint("merge"), "digest", "left").select("doc_id", "part", (F.col("mask") + repeated).alias("mask"))


def polynomial(counts: np.ndarray) -> np.ndarray:
    """Coefficients of the removal polynomial by monomial (bit set of variables), from numbers of documents by mask, along the last axis."""
    c = counts.astype(np.int64).copy()
    places = np.arange(c.shape[-1])
    sign = np.ones(c.shape[-1], np.int64)
    for bit in range(c.shape[-1].bit_length() - 1):
        has = (places >> bit & 1).astype(bool)
        c[..., ~has] += c[..., has]  # sums over supersets
        sign[has] *= -1
    c *= -sign
    c[..., 0] = 0
    return c


def corners(coefficients: np.ndarray) -> np.ndarray:
    """Values of the polynomial at every corner: documents that a set of filters removes."""
    c = coefficients.copy()
    places = np.arange(c.shape[-1])
    for bit in range(c.shape[-1].bit_length() - 1):
        has = (places >> bit & 1).astype(bool)
        c[..., has] += c[..., ~has]  # sums over subsets
    return c


def shapley(coefficients: np.ndarray, k: int) -> list[int]:
    """k! times the integral of each partial derivative along the diagonal: a monomial of s variables gives 1/s of its coefficient to each of them."""
    out = []
    for i in range(k):
        terms = [Fraction(int(c), m.bit_count()) for m, c in enumerate(coefficients.tolist()) if m >> i & 1]
        whole = sum(terms, Fraction(0)) * factorial(k)
        assert whole.denominator == 1
        out.append(int(whole))
    return out


@cache
def _orders(letters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders by name, and for each order and step the filter and the set of those before it."""
    k = len(letters)
    names = sorted("".join(p) for p in permutations(letters))
    filters = np.array([[letters.index(c) for c in name] for name in names])
    before = np.zeros_like(filters)
    for step in range(1, k):
        before[:, step] = before[:, step - 1] | 1 << filters[:, step - 1]
    return names, filters, before


def audited(counts: np.ndarray, letters: str = LETTERS) -> dict[str, np.ndarray]:
    """Columns over all orders and steps of one part. counts: by mask, of documents and then of those with each mark."""
    names, filters, before = _orders(letters)
    k, full = len(letters), (1 << len(letters)) - 1
    coefficients = polynomial(counts)
    removed = corners(coefficients)
    after = before | 1 << filters
    here = removed[:, after] - removed[:, before]
    alone = removed[0, full] - removed[0, [full ^ 1 << i for i in range(k)]]
    return {
        "filter_order": np.repeat(np.array(names), k),
        "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(names)),
        "kept": (counts[0].sum() - removed[0, after]).ravel(),
        "removed": here[0].ravel(),
        "redundant": (removed[0, 1 << filters] - here[0]).ravel(),
        "unique_fails": alone[filters].ravel(),
        **{f"lost_{m}": here[m].ravel() for m in range(1, len(counts))},
        "shapley": np.array(shapley(coefficients[0], k), np.int64)[filters].ravel(),
    }


def audit(masks: DataFrame, *, letters: str = LETTERS, marks: tuple[str, ...] = ()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost for each mark, shapley.

    masks: part, mask (bit i is set if the document fails the filter of letter i) and marks, boolean columns whose losses are counted.
    """
    size, names = 1 << len(letters), ["n", *(f"n_{m}" for m in marks)]
    numbers = [F.count("*").alias("n"), *(F.sum(F.col(m).cast("bigint")).alias(f"n_{m}") for m in marks)]
    by_mask = masks.groupBy("part", "mask").agg(*numbers)
    # At most 2^k entries for each part.
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", *names)).alias("counts"))
    columns = ["kept", "removed", "redundant", "unique_fails", *(f"{m}_lost" for m in marks), "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.zeros((len(names), size), np.int64)
                for row in found:
                    counts[:, row["mask"]] = [row[n] for n in names]
                out = audited(counts, letters)
                order, step, *values = out.values()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(order), pa.string()), pa.array(order.tolist(), pa.string()), pa.array(step), *map(pa.array, values)], names=["part", "filter_order", "step", *columns]
                )

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in columns))


def marked(rows: DataFrame, labels: DataFrame, **marks: Column) -> DataFrame:
    """rows with a boolean column for each mark: whether any label row of the doc_id satisfies the condition."""
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(m) for m, c in marks.items()])
    rows = rows.join(known, "doc_id", "left")
    return rows.withColumns({m: F.coalesce(m, F.lit(False)) for m in marks})


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = failures(table(spark, sf_dir, "documents"))
    masks = marked(masks, table(spark, sf_dir, "labels"), good=F.col("quality") == 1, toxic=F.col("toxic") == 1)
    return audit(masks, marks=("good", "toxic"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, [x FOR x IN string_split_regex(text, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, string_split(concat_ws(' ',
    CASE WHEN len(words) < 50 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' END,
    CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
    CASE WHEN w.doc_id > first_id THEN 'E' END), ' ') AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT [a.c, b.c, c.c, d.c, e.c] AS seq FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT seq, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (
  SELECT part, array_to_string(seq, '') AS filter_order, step, seq[step] AS filter,
    sum(CASE WHEN NOT list_has_any(fails, seq[1:step]) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN list_contains(fails, seq[step]) AND NOT list_has_any(fails, seq[1:step - 1]) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_contains(fails, seq[step]) AND list_has_any(fails, seq[1:step - 1]) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = [seq[step]] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN list_contains(fails, seq[step]) AND NOT list_has_any(fails, seq[1:step - 1]) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN list_contains(fails, seq[step]) AND NOT list_has_any(fails, seq[1:step - 1]) THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, seq, step)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM r
"""
