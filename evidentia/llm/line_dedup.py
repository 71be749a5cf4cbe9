"""Line deduplication with an edit bound, by a deletion-neighbourhood join, in DataFrame operations only.

The edit unit is the word. Two lines are near if one word replaced, added or removed makes them equal. A line goes if an earlier line (by doc_id,
then place in the document) is equal, whatever its length, or near; of a set of equal lines the earliest stays. Lines of fewer than `least` words
are near to none, so near lines have a similarity of 1 - 1 / least or more; with edits=0 only equal lines go.

Every line has n deletion variants, each a line without one word. Two lines of equal length are near exactly if they share a
variant with the same word left out; lines of lengths n and n + 1, exactly if the shorter is a variant of the longer. All
lines with one (variant, place) are near to one another, so the earliest of them stands for all and no pairs are made.

1. Lines become SHA-256 digests of their words joined by single spaces, with 64-bit keys of their halves; equal lines meet in an aggregation
   of narrow rows. Equal digests count as equal lines: no two texts with one SHA-256 digest are known.
2. Lines within one edit share a first or a last half (of either rounding). Only lines that share a half with another line go on.
   This loses nothing and spares nearly all long lines the n variants.
3. Words of the remaining lines get running exclusive-ors of 64-bit hashes of (word, place), from which each variant's 128-bit key follows in
   constant time: the words before the gap at their places, those after it one place lower.
4. The earliest line of each key is found by aggregation, and the pair is confirmed word by word.

Hot lines, halves and variants only meet in aggregations that combine before the shuffle, on fixed-width buffers, so by hashing and not by sorting;
the joins back are sort-merge joins against written tables at every size, so both sides are plain shuffles whose hot keys Spark splits.

Defined cases: null text has no lines and stays null. Lines of white space only are never repeats. Rows with a null id are left as they are and
count as no one's earlier line; ids must be whole numbers (others are an error). Rows that repeat an id and a text are treated alike; at one place of
two texts of an id no line is the earlier one. Words are runs outside white space, compared with case; a kept line stays as it is,
white space included. Documents are never dropped here: without_repeats() gives '' if all lines go; without_emptied() drops such
documents. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import fresh, table, whole_number_ids, written

#: Least number of words of a line that may be near to another, and the edit bound.
LEAST, EDITS = 5, 1
WS = r"[\x20\x09-\x0D]+"
#: A place is doc_id * LINES + the line's number, in order of both.
LINES = 10**10
HALVES = ("h1", "h2", "h3", "h4")


def words(line: Column) -> Column:
    return F.filter(F.split(line, WS), lambda x: x != "")


def _halves(norm: Column, n: Column, least: int) -> list[Column]:
    """Keys of the first and the last m words, for both roundings of n / 2; null for lines that are too short, and where both roundings agree."""
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")

    def key(tag: str, m: Column, end: Column, only: Column) -> Column:
        return F.when(only, F.xxhash64(F.lit(tag), m, F.call_function("substring_index", norm, F.lit(" "), end)))

    long, even = n >= least, (n >= least) & (n % 2 == 0)
    made = (key("first", high, high, long), key("last", high, -high, long), key("first", low, low, even), key("last", low, -low, even))
    return [c.alias(name) for c, name in zip(made, HALVES)]


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, version (the text's hash), line_no, line for every line that is long enough for the least number of words."""
    docs = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("version"), "text")
    lines = docs.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.octet_length("line") >= 2 * least - 1)


def _normal(lines: DataFrame, least: int) -> DataFrame:
    """lines with norm, the words joined by single spaces, and n, their number; those of the least number of words or more."""
    line = F.col("line")
    # The regular expression only where there is other white space than single spaces.
    odd = F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    norm = F.trim(F.when(odd, F.regexp_replace(line, WS, " ")).otherwise(line))
    lines = lines.withColumn("norm", norm)
    n = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    return lines.withColumn("n", F.when(F.col("norm") == "", 0).otherwise(n)).filter(F.col("n") >= least)


def _place() -> Column:
    """As a decimal and not a struct, so that its minimum is found in hash aggregations. Slow to make, so only for the few lines that go on."""
    return (F.col("doc_id").cast("decimal(20,0)") * F.lit(LINES).cast("decimal(11,0)") + F.col("line_no").cast("decimal(11,0)")).cast("decimal(33,0)").alias("place")


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256)).alias("digest")


def _near(first: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """doc_id, version, line_no, many, digest of the distinct lines with an earlier near line.

    first: these (without the digest), mark and halves of each distinct line's first occurrence. mark, a hash of the digest, tells apart the lines of two texts
    of an id.
    """
    own = ["doc_id", "line_no", "mark", "version", "many"]
    halves = first.select(*own, F.explode(F.array_compact(F.array(*HALVES))).alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half")
    going = halves.join(written(shared, "halves").hint("merge"), "half").select(*own).distinct()
    # Written before it is looked at: else the work on words would be pushed below the join, to all lines.
    met = written(texts.select("doc_id", "line_no", "line").join(going, ["doc_id", "line_no"]), "going")
    lines = _normal(met, least).withColumn("digest", _digest(F.col("norm"))).filter(F.xxhash64("digest") == F.col("mark")).dropDuplicates(["doc_id", "line_no", "mark"])
    lines = written(lines.select(_place(), *own, "digest", F.split("norm", " ").alias("w")), "lines")

    def h(family: int, word: Column, at: Column) -> Column:
        return F.xxhash64(F.lit(family), word, at)

    # Dealt by line before the words are taken apart: the windows over a line then need no shuffle of words.
    each = lines.repartition("place", "mark").select("place", "mark", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    by_line = W.partitionBy("place", "mark")
    before = by_line.orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    upto = by_line.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = []
    for k in (1, 2):
        here, lower = h(k, F.col("word"), F.col("i")), h(k, F.col("word"), F.col("i") - 1)
        rest = F.bit_xor(lower).over(by_line).bitwiseXOR(F.bit_xor(lower).over(upto))
        sums.append(F.coalesce(F.bit_xor(here).over(before), F.lit(0).cast("bigint")).bitwiseXOR(rest).alias(f"v{k}"))

    def keyed(rows: DataFrame, size: Column) -> DataFrame:
        return rows.select("place", "mark", "i", F.xxhash64(F.lit(1), "v1", size).alias("x1"), F.xxhash64(F.lit(2), "v2", size).alias("x2"))

    variants = keyed(each.select("place", "mark", "n", "i", *sums), F.col("n") - 1)

    def total(k: int) -> Column:
        return F.aggregate(F.transform("w", lambda x, i: h(k, x, i)), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))

    whole = keyed(lines.select("place", "mark", F.lit(-1).alias("i"), F.size("w").alias("n"), total(1).alias("v1"), total(2).alias("v2")), F.col("n"))
    every = written(variants.union(whole), "variants")
    # Keys alone first: nearly all variants have a key of their own and go no further.
    several = every.groupBy("x1", "x2").agg(F.count("*").alias("c")).filter("c > 1").select("x1", "x2")
    keys = written(every.join(written(several, "several").hint("merge"), ["x1", "x2"]), "shared-variants")

    # Same word left out: one group for (key, place of the gap).
    replaced = keys.filter("i >= 0").groupBy("x1", "x2", "i").agg(F.min("place").alias("earliest"), F.count("*").alias("c")).filter("c > 1").drop("c")
    a = keys.join(written(replaced, "replaced").hint("merge"), ["x1", "x2", "i"]).select("place", "mark", "earliest")
    # A whole line among the variants of longer lines.
    longer = F.when(F.col("i") >= 0, F.col("place"))
    shorter = F.when(F.col("i") < 0, F.col("place"))
    added = keys.groupBy("x1", "x2").agg(F.min(longer).alias("longer"), F.min(shorter).alias("shorter")).filter("longer is not null and shorter is not null")
    b = keys.join(written(added, "added").hint("merge"), ["x1", "x2"]).select("place", "mark", F.when(F.col("i") < 0, F.col("longer")).otherwise(F.col("shorter")).alias("earliest"))
    pairs = written(a.union(b).filter("place > earliest").distinct(), "pairs")

    # Confirmed on the words: the common start and the common end leave one word at most on either side.
    x, y = lines.select("place", "mark", F.col("w").alias("x")), lines.select(F.col("place").alias("earliest"), F.col("w").alias("y"))
    both = pairs.join(x, ["place", "mark"]).join(y, "earliest")
    near = written(both.filter(within_one(F.col("x"), F.col("y"))).select("place", "mark").distinct(), "near")
    return lines.join(near, ["place", "mark"]).select("doc_id", "version", "line_no", "many", "digest")


def within_one(x: Column, y: Column) -> Column:
    """Whether two word arrays are within one replaced, added or removed word of each other."""
    least = F.least(F.size(x), F.size(y))
    differ = F.zip_with(F.slice(x, F.lit(1), least), F.slice(y, F.lit(1), least), lambda a, b: a != b)
    # 1-based first difference; 0 if one is the start of the other
    at = F.array_position(differ, True).cast("int")
    xs, ys = F.size(x), F.size(y)

    def after(w, start, size):
        return F.slice(w, start, F.greatest(size - start + 1, F.lit(0)))

    ends = F.when(at == 0, F.abs(xs - ys) <= 1)
    ends = ends.when(xs == ys, after(x, at + 1, xs) == after(y, at + 1, ys))
    ends = ends.when(xs == ys + 1, after(x, at + 1, xs) == after(y, at, ys))
    return ends.when(ys == xs + 1, after(x, at, xs) == after(y, at + 1, ys)).otherwise(F.lit(False))


def repeated_lines(docs: DataFrame, *, least: int = LEAST, edits: int = EDITS) -> DataFrame:
    """doc_id, version, line_no of every line that goes; version tells apart texts of one doc_id (xxhash64 of the text).

    least: words that a line needs to be near to another; edits: the edit bound, 0 or 1 words. Equal lines go at every length.
    """
    if edits not in (0, 1) or least < 2:
        raise ValueError("edits must be 0 or 1, and least 2 or more")
    docs = docs.select(whole_number_ids(docs), "text")
    norm = F.col("norm")
    halves = _halves(norm, F.col("n"), least) if edits else []
    every = written(_normal(_lines(docs, 1), 1).select("doc_id", "version", "line_no", _digest(norm), *halves), "line-digests")
    # Fixed-width minima only. They are a place for lines that occur once; for the others the line in the first document follows.
    least_of = [F.min(c).alias(c) for c in ("doc_id", "version", "line_no", *HALVES[: len(halves)])]
    first = written(every.groupBy("digest").agg(*least_of, F.count("*").alias("c")), "first-lines")
    met = every.select("doc_id", "version", "line_no", "digest").join(first.filter("c > 1").select("digest", F.col("doc_id").alias("first_id")).hint("merge"), "digest")
    met = written(met, "repeats")
    at = written(met.filter("doc_id = first_id").groupBy("digest").agg(F.min("line_no").alias("first_line")), "first-places")
    gone = met.join(at.hint("merge"), "digest").filter("doc_id > first_id or line_no > first_line").select("doc_id", "version", "line_no")
    if edits:
        once = first.filter("c = 1").withColumn("many", F.lit(False))
        many = first.filter("c > 1").join(at, "digest").withColumn("line_no", F.col("first_line")).withColumn("many", F.lit(True))
        names = ["doc_id", "version", "line_no", "many", F.xxhash64("digest").alias("mark"), *HALVES]
        near = written(_near(once.select(*names).unionAll(many.select(*names)), _lines(docs, least), least), "near-lines")
        gone = gone.unionAll(near.filter("not many").select("doc_id", "version", "line_no"))
        gone = gone.unionAll(met.join(near.filter("many").select("digest").hint("merge"), "digest").select("doc_id", "version", "line_no"))
    return gone.distinct()


def _cleaned(docs: DataFrame, **how) -> tuple[DataFrame, str]:
    """docs with the text that stays, and an array column of the numbers of lines that went (null: none), whose name is given."""
    gone, lines, i, v = fresh(docs, "gone", "lines", "key_id", "key_version")
    drop = repeated_lines(docs, **how).groupBy("doc_id", "version").agg(F.array_sort(F.collect_list("line_no")).alias(gone))
    drop = written(drop, "gone").withColumnsRenamed({"doc_id": i, "version": v})
    met = (docs["doc_id"].cast("bigint") == drop[i]) & (F.xxhash64(docs["text"]) == drop[v])
    # The lines as a column of their own: inside the lambda they would be split again for each line.
    cut = docs.join(drop, met, "left").drop(i, v).withColumn(lines, F.when(F.col(gone).isNotNull(), F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.array_join(F.transform(stay, lambda k: F.get(F.col(lines), k)), "\n")
    cut = cut.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(text))
    return cut.select(*docs.columns, gone), gone


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """docs with the text of the lines that stay; all other columns as they are. how: as in repeated_lines()."""
    return _cleaned(docs, **how)[0].select(*docs.columns)


def without_emptied(docs: DataFrame, **how) -> DataFrame:
    """without_repeats(), less the documents that lost lines and keep none but lines of white space."""
    cleaned, gone = _cleaned(docs, **how)
    return cleaned.filter(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: lines, lines that go, their numbers, and the digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    cleaned, gone = _cleaned(docs.withColumn("n_lines", n_lines.cast("bigint")))
    dropped = F.coalesce(F.size(gone), F.lit(0)).cast("bigint")
    return cleaned.select(
        "doc_id",
        "n_lines",
        dropped.alias("n_dropped"),
        F.coalesce(F.array_join(gone, ","), F.lit("")).alias("dropped"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
o AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d),
l AS (SELECT doc_id, i - 1 AS line_no, list_filter(regexp_split_to_array(ls[i], '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM o),
k AS (SELECT doc_id, line_no, w, array_to_string(w, ' ') AS norm FROM l WHERE len(w) >= 1),
f AS (SELECT norm, any_value(w) AS w, min({'d': doc_id, 'l': line_no}) AS place FROM k GROUP BY norm),
g AS (SELECT norm, w, place, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= 5),
v AS (SELECT norm, place, i, array_to_string(w[:i - 1] || w[i + 1:], ' ') AS variant FROM g),
s AS (SELECT variant, i, min(place) AS earliest FROM v GROUP BY variant, i),
pairs AS (
  SELECT v.norm FROM v JOIN s ON v.variant = s.variant AND v.i = s.i WHERE v.place > s.earliest
  UNION SELECT v.norm FROM v JOIN f ON v.variant = f.norm WHERE len(f.w) >= 5 AND v.place > f.place
  UNION SELECT f.norm FROM v JOIN f ON v.variant = f.norm WHERE len(f.w) >= 5 AND f.place > v.place),
gone AS (
  SELECT k.doc_id, k.line_no FROM k JOIN f ON k.norm = f.norm
  WHERE {'d': k.doc_id, 'l': k.line_no} > f.place OR k.norm IN (SELECT norm FROM pairs)),
a AS (SELECT doc_id, list(line_no ORDER BY line_no) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ls) AS BIGINT) AS n_lines, CAST(coalesce(len(a.gone), 0) AS BIGINT) AS n_dropped,
  coalesce(array_to_string(a.gone, ','), '') AS dropped,
  md5(array_to_string([d.ls[i + 1] for i in range(len(d.ls)) if a.gone IS NULL OR NOT list_contains(a.gone, i)], chr(10))) AS text_md5
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
