"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document's expected copies are its source's target / size, a whole part and a fraction. The fractions of a source are rounded
together: two documents i and j exchange words, p_i + d / size_i and p_j - d / size_j, by a random d of two values chosen
so that one fraction becomes 0 or 1, each keeps its expectation, and the expected words of the pair stay the same. The one
that is still fractional meets the next document. So a source's taken words differ from its target by less than one document.

The order is a reduction tree: documents are dealt by hash into groups of about FAN within a source, each group is folded by itself,
long documents first so that the one left over tends to be short, and hands on one fractional document at most; these
are dealt into groups again, until one group for each source is left. Its last fraction goes to the nearer whole number,
which keeps the source nearest to its target. All draws are hashes of the id, the text and the seed, so reruns agree. A source
with a third of all rows is split over as many groups as its size asks for, and only one narrow row for each group moves up. Rows that agree in
source, id and text would share a draw, so they count as one document with their number: all of them are taken as often as their common
expectation surely says, and one place in the tree decides on one more. Which of them have it goes by their places, counted part by part.

Targets: sources by code point, null last, weigh WEIGHTS in turn and share RATE of all sizes; none goes above MOST times its own
size, and what is above is shared again by weight among the others. As a source is at its bound exactly if the level
(target per weight) reaches its bound per weight, one pass in the order of that ratio finds the level. That pass alone is a single task; it reads one narrow
row for each source.

Defined cases: null and empty texts have size 0 and are taken 0 words; they get no copies. A source of size 0 has target 0. A null
source is a source of its own. Rows with a null id take part. Of rows that agree in source, id and text the takes may swap but not change in
sum. Ids must be whole numbers (others are an error). An empty table gives no rows. copies() keeps all columns, under their own names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import BROADCAST_ROWS, fresh, table, whole_number_ids, written

WEIGHTS, RATE, MOST, SEED = (3, 1, 2), 1.5, 2.0, 17
#: Documents that a group of the tree folds, and parts into which each source's row is copied where sources are too many to broadcast.
FAN, SALTS = 64, 32
#: A fraction this near to 0 or 1 is whole.
TINY = 1e-9


def size_of(text: Column) -> Column:
    """Number of words. Runs of white space become one space first, so that words are one more than the spaces inside."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(flat == "", F.lit(0).cast("bigint")).otherwise((F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("bigint"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows (source, size). The rows that meet in one task are one for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", cycle).withColumn("bound", F.lit(MOST) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = W.partitionBy(F.lit(1))
    per = per.withColumn("total", F.lit(RATE) * F.sum("source_size").over(all_rows))
    # With the k sources of least ratio at their bounds, the level for the others; the first k at which no other is above its bound holds.
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / rest
    per = per.withColumn("level", level)
    held = F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct(F.col("bound") / F.col("weight"), F.col("level")))).over(all_rows)
    per = per.withColumn("held", held["level"])
    target = F.when(F.col("held").isNull(), F.col("bound")).otherwise(F.least("bound", F.col("held") * F.col("weight")))
    return per.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"))


ITEM = "struct<rank:bigint,draw:bigint,doc_id:bigint,size:bigint,p:double,row:bigint>"


def _fold() -> Column:
    """From the sorted array `docs` of ITEMs: the decided ones, and the one still fractional, if any."""
    none, decided = F.lit(None).cast(ITEM), F.array().cast(f"array<{ITEM}>")

    def placed(d: Column, p: Column) -> Column:
        return F.struct(*[p.alias("p") if n == "p" else d[n].alias(n) for n in ("rank", "draw", "doc_id", "size", "p", "row")])

    def step(state: Column, d: Column) -> Column:
        a = state["open"]
        # Words that can move from d to a, and from a to d, until one of the two is whole.
        to_a = F.least((1 - a["p"]) * a["size"], d["p"] * d["size"])
        to_d = F.least(a["p"] * a["size"], (1 - d["p"]) * d["size"])
        u = (F.pmod(F.xxhash64(a["draw"], d["draw"], F.lit(SEED)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        moved = F.when(u * (to_a + to_d) < to_d, to_a).otherwise(-to_d)
        pa, pd = a["p"] + moved / a["size"], d["p"] - moved / d["size"]

        def snap(p):
            return F.when(p < TINY, 0.0).when(p > 1 - TINY, 1.0).otherwise(p)

        na, nd = placed(a, snap(pa)), placed(d, snap(pd))

        def is_open(x):
            return (x["p"] > 0) & (x["p"] < 1)

        whole = F.filter(F.array(na, nd), lambda x: ~is_open(x))
        left = F.get(F.filter(F.array(na, nd), is_open), F.lit(0))
        return F.when(a.isNull(), F.struct(state["done"].alias("done"), d.alias("open"))).otherwise(F.struct(F.concat(state["done"], whole).alias("done"), left.alias("open")))

    return F.aggregate("docs", F.struct(decided.alias("done"), none.alias("open")), step)


def _sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """What the mix reads of a document: id, source, size and the text's hash."""
    return docs.select(*more, whole_number_ids(docs), "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, row for each row of docs. row tells rows apart within one reading."""
    return _taken(written(_sizes(docs), "sizes").withColumn("row", F.monotonically_increasing_id()))


def _per_source(rows: DataFrame, per: DataFrame, spread: Column) -> DataFrame:
    """rows with the columns of per, one row for each key: broadcast up to a counted size, beyond it joined in salted parts."""
    if per.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(per), "key")
    wide = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(wide, ["key", "salt"]).drop("salt")


def _taken(slim: DataFrame) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("key")
    of = written(targets(slim), "targets").select(key, "source_size", "target")
    draw = F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("bigint")), "size", "h", F.lit(SEED))
    joined = _per_source(slim.select("row", "doc_id", key, "size", "h"), of, draw)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(expected + TINY)
    fraction = F.greatest(expected - whole, F.lit(0.0))
    rows = joined.withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(0))
    rows = rows.withColumn("p", F.when((F.col("size") > 0) & (fraction > TINY), fraction).otherwise(0.0))
    rows = written(rows.select("row", "doc_id", "key", "size", "h", "source_size", "target", "whole", "p"), "expected")

    alike = ["key", "doc_id", "size", "h"]
    items = rows.filter("p > 0").groupBy(*alike).agg(F.min("row").alias("row"), F.count("*").alias("c"), F.min("p").alias("p"))
    sure = F.floor(F.col("c") * F.col("p") + TINY)
    items = items.withColumn("sure", sure).withColumn("p", F.greatest(F.col("c") * F.col("p") - F.col("sure"), F.lit(0.0)))
    items = written(items.withColumn("draw", draw), "items")
    rounded = _rounded(items.filter(F.col("p") > TINY))
    ups = items.select("row", *alike, "c", "sure")
    ups = (ups.join(rounded.withColumnRenamed("p", "up"), "row", "left") if rounded else ups.withColumn("up", F.lit(0.0))).withColumn("more", F.col("sure") + F.coalesce("up", F.lit(0.0)).cast("bigint"))
    ups = written(ups.filter("more > 0").select("row", *alike, "c", "more"), "ups")
    each = ups.filter("c = 1").select("row", "more")
    many = ups.filter("c > 1")
    if not many.isEmpty():
        each = each.unionAll(_shared_out(rows, many, alike))
    copies = F.col("whole") + F.coalesce("more", F.lit(0).cast("bigint"))
    out = rows.join(each, "row", "left").withColumn("copies", copies)
    return out.select("row", "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _rounded(live: DataFrame) -> DataFrame | None:
    """row and p, 0 or 1, for each of the fractional items."""
    # Groups of each source at the first level: about one for FAN documents.
    groups = written(live.groupBy("key").agg(F.ceil(F.count("*") / FAN).alias("groups")), "groups")
    most = groups.agg(F.max("groups")).first()[0] or 0
    live = _per_source(live, groups, F.col("draw")).withColumn("group", F.pmod("draw", "groups"))
    done = []
    item = F.struct((-F.col("size")).alias("rank"), "draw", "doc_id", "size", "p", "row")
    while most:
        folded = live.groupBy("key", "group").agg(F.array_sort(F.collect_list(item)).alias("docs")).select("key", "group", _fold().alias("f"))
        folded = written(folded, "folded")
        done.append(folded.select(F.explode("f.done").alias("d")).select("d.row", "d.p"))
        rest = folded.filter("f.open is not null").select("key", "group", "f.open.*")
        if most == 1:
            done.append(rest.select("row", F.round("p").alias("p")))
            break
        most = -(-most // FAN)
        live = rest.withColumn("group", F.floor(F.col("group") / FAN))
    return reduce(DataFrame.unionAll, done) if done else None


def _shared_out(rows: DataFrame, many: DataFrame, alike: list[str]) -> DataFrame:
    """row and more, 1, for the first rows of each set of equal ones, as many as the set takes more.

    The upper bits of row are the part of the table that it was read from: rows are numbered within parts, which are bounded, and parts by the
    counts of those before.
    """
    sets = many.select(F.col("row").alias("set"), "more", *[F.col(c).alias(f"of_{c}") for c in alike]).hint("merge")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in alike])
    met = written(rows.filter("p > 0").join(sets, same).select("row", "set", "more", F.shiftright("row", 33).alias("part")), "alike")
    parts = met.groupBy("set", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("set").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = written(parts.select("set", "part", F.coalesce(before, F.lit(0)).alias("before")), "parts")
    place = F.row_number().over(W.partitionBy("set", "part").orderBy("row"))
    placed = met.withColumn("place", place).join(parts.hint("merge"), ["set", "part"]).filter(F.col("before") + F.col("place") <= F.col("more"))
    return placed.select("row", F.lit(1).cast("bigint").alias("more"))


def copies(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with all its columns.

    Where ids are unique they join a document to its copies; else the rows are numbered in a written table first.
    """
    row, times = fresh(docs, "row_no", "n_times")
    sizes = written(_sizes(docs), "sizes")
    if sizes.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        keyed, sizes = docs.withColumn(row, F.col("doc_id").cast("bigint")), sizes.withColumn("row", F.col("doc_id"))
    else:
        keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        sizes = written(_sizes(keyed, F.col(row).alias("row")), "sizes")
    of = _taken(sizes).filter("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(times))
    return keyed.join(of, row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
