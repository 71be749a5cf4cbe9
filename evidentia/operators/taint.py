"""Taint paths: how data gets from sources to sinks over an edge table, step by step.

For each pair of a sink and a source that reaches it the first paths come out: no node twice, at most `hops` edges, shorter ones first and then by their nodes in order.

1. A search from the sources gives each node the least number of edges after which it is reached. Only such nodes get ways to sinks, and only ways that still fit.
2. Ways grow backwards from the sinks by one edge a layer. Of a node's ways of one length to one sink the first `most` stay: paths that come to the node go on by those, whatever they were
   before. A row holds the ways of a node to at most `SINKS` sinks, so an edge carries them in one row to the node before. Rows are dealt by that node once, and it picks the first.
   Sources pick theirs last, from the ways of all lengths at once. An edge from a source carries only how many ways its target has to which sinks, so what is sorted is small, and
   sources are dealt into runs of a bounded number of edges, so that no more than a run's rows are on disk at once. What is picked is a way's place at the target; the ways are joined last.
3. A way that would come back to the node before is cut. Where the node after had a cut way and left others out, one of those may be needed: the sinks concerned (and no
   others) run again with more ways kept, until none is left. Without cycles that never happens.

Layers are written, so a lost executor costs one layer; edges and what they carry go as soon as no later step reads them. A path has a source other than its sink; edges from a node to itself count for nothing. Nulls among nodes are left out, and repeated edges, sources and sinks count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import dealt, dropped, saved

#: Paths of a sink, and edges of a path.
MOST, HOPS = 3, 6
#: How many times more ways are kept when a sink runs again, sinks of a row, and edges from sources whose offers are sorted at once.
MORE, SINKS, EDGES = 4, 64, 1 << 24


def flow_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, *, most: int = MOST, hops: int = HOPS) -> DataFrame:
    """sink, source, rank (from 1), length (edges), steps (nodes, the source first). edges: source, target; sources and sinks: node."""
    starts = sources.select(F.col("node").alias("source")).filter("source is not null").distinct().withColumn("start", F.lit(True))
    # Dealt by source once, for both the repeats and the mark.
    edges = edges.select("source", "target").filter("source <> target").repartition("source").distinct()
    edges = saved(edges.join(starts, "source", "left"), "flow-edges")
    ends = saved(sinks.select(F.col("node").alias("sink")).filter("sink is not null").distinct().withColumn("no", F.monotonically_increasing_id()), "sinks")
    inner = _reached(edges, hops)
    out, kept = None, most
    while True:
        layers, lost = _layers(inner, ends, kept, hops)
        picks = _chosen(edges, layers, most)
        lost = picks.filter("way < 0").select("no").union(lost)
        ends = saved(ends.join(lost.distinct(), "no", "left_semi").select("sink", "no"), "sinks")
        last = ends.isEmpty()
        picks = picks.filter("way >= 0")
        found = _paths(picks if last else picks.join(ends, "no", "left_anti"), layers)
        out = found if out is None else out.unionByName(found)
        if last:
            dropped(edges)
            dropped(inner)
            return out
        kept *= MORE


def _reached(edges: DataFrame, hops: int) -> DataFrame:
    """source, target, since: edges that a walk from a start can go on by, and the least number of edges (from 1) after which it is at their source. Only what has an edge to it is searched."""
    ended = edges.select(F.col("target").alias("source"))
    able = saved(edges.join(ended.distinct(), "source", "left_semi").select("source", "target"), "flow-able-edges")
    front = saved(edges.filter("start").select(F.col("target").alias("source")).distinct().withColumn("since", F.lit(1)), "flow-front")
    seen = front
    for hop in range(2, hops):
        step = able.join(front, "source", "left_semi").select(F.col("target").alias("source")).distinct()
        front = saved(step.join(seen, "source", "left_anti").withColumn("since", F.lit(hop)), "flow-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    known = saved(able.join(seen, "source"), "flow-known-edges")
    dropped(able)
    return known


def _layers(inner: DataFrame, ends: DataFrame, kept: int, hops: int) -> tuple[DataFrame, DataFrame]:
    """at, length, sinks (structs with no, sink, ways, more): nodes with their ways of each length to sinks; and no of the sinks for which `kept` ways of a node may have been too few.

    A way is its nodes between the two ends. inner: source, target, since.
    """
    way = F.filter(F.array("sink"), lambda _: F.lit(False))
    one = F.struct("no", "sink", F.array(way).alias("ways"), F.lit(False).alias("more"), F.lit(False).alias("lost"))
    layer = ends.select(F.col("sink").alias("at"), F.lit(1).alias("length"), F.array(one).alias("sinks"))
    every, lost = layer, ends.select("no").limit(0)
    for hop in range(1, hops):
        near = inner.filter(F.col("since") + hop <= hops)
        layer = saved(_rows(_picked(_carried(near, layer, hop), kept), hop + 1), "flow-layer")
        if layer.isEmpty():
            break
        lost = lost.union(layer.select(F.explode("sinks").alias("s")).filter("s.lost").select("s.no"))
        every = every.unionByName(layer)
    return every, lost


def _rows(picked: DataFrame, length: int) -> DataFrame:
    """at, length, sinks: the ways of a node to at most `SINKS` sinks."""
    few = picked.withColumn("part", F.floor((F.row_number().over(W.partitionBy("source").orderBy("no")) - 1) / SINKS))
    few = few.groupBy("source", "part").agg(F.collect_list(F.struct("no", "sink", "ways", "more", "lost")).alias("sinks"))
    return few.select(F.col("source").alias("at"), F.lit(length).alias("length"), "sinks")


def _offered(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """source, length, target, and of each sink that the target has ways to: nos, counts (of ways), frees (which of them don't come back to the source; null: all) and cuts (null: none)."""
    ways, has = F.flatten(F.flatten("sinks.ways")), F.col("source")
    thin = layers.withColumns({"nos": F.col("sinks.no"), "counts": F.transform("sinks.ways", F.size), "through": F.array_distinct(F.concat("sinks.sink", ways))})

    def some(s: Column) -> Column:
        free = F.transform(s["ways"], lambda w, i: F.when(~F.array_contains(w, has), i))
        free = F.when(s["sink"] != has, F.filter(free, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))
        return F.struct(s["no"], free.alias("free"), (s["more"] & (s["sink"] != has) & (F.size(free) < F.size(s["ways"]))).alias("cut"))

    # Where the source is on none of the ways, which is all but always, what the layer has goes on as it is.
    here = F.when(F.array_contains("through", has), F.transform("sinks", some))
    found = edges.join(thin, F.col("target") == F.col("at")).select("source", "length", "target", "nos", "counts", here.alias("some"))
    counts = F.coalesce(F.transform("some.free", F.size), "counts")
    return found.select("source", "length", "target", "nos", counts.alias("counts"), F.col("some.free").alias("frees"), F.col("some.cut").alias("cuts"))


def _chosen(edges: DataFrame, layers: DataFrame, most: int) -> DataFrame:
    """source, no, rank, length, target, way: the first ways from each source to each sink, by their places among those of the target; way -1 tells that one left out may belong among them."""
    starts = edges.filter("start")
    runs = max(1, -(-starts.count() // EDGES))
    offers = dealt(_offered(starts, layers).withColumn("run", F.pmod(F.xxhash64("source"), F.lit(runs)).cast("int")), "flow-offers", "run")
    out = None
    for run in range(runs):
        each = offers.filter(F.col("run") == run).drop("run").repartition("source")
        each = each.select("source", "length", "target", "counts", "frees", "cuts", F.posexplode("nos").alias("pos", "no"))
        of = lambda c: F.get(c, F.col("pos"))
        each = each.select("source", "no", "length", "target", of("counts").alias("n"), of("frees").alias("free"), F.coalesce(of("cuts"), F.lit(False)).alias("cut")).filter("n > 0 or cut")
        # Each row has a way or a loss, so those behind the first most + 1 change nothing.
        order = W.partitionBy("source", "no").orderBy("length", "target")
        each = each.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most + 1)
        each = each.withColumn("before", (F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).cast("int")).filter(F.col("before") < most)
        none = F.array().cast("array<int>")
        ways = F.slice(F.when(F.col("n") > 0, F.coalesce("free", F.sequence(F.lit(0), F.col("n") - 1))).otherwise(none), F.lit(1), F.lit(most) - F.col("before"))
        lost = F.when(F.col("cut") & (F.col("before") + F.col("n") < most), F.array(F.lit(-1))).otherwise(none)
        each = each.select("source", "no", "before", "length", "target", F.posexplode(F.concat(ways, lost)).alias("pos", "way"))
        picks = saved(each.select("source", "no", (F.col("before") + F.col("pos") + 1).alias("rank"), "length", "target", "way"), "flow-picks")
        out = picks if out is None else out.unionByName(picks)
    dropped(offers)
    return out


def _paths(picks: DataFrame, layers: DataFrame) -> DataFrame:
    """sink, source, rank, length, steps: the picks with the ways that they name."""
    known = layers.select(F.col("at").alias("target"), "length", F.explode("sinks").alias("s")).select("target", "length", "s.no", "s.sink", "s.ways")
    via = F.slice(F.array("target"), F.lit(1), F.when(F.col("target") == F.col("sink"), 0).otherwise(1))
    steps = F.concat(F.array("source"), via, F.get("ways", F.col("way")), F.array("sink"))
    return picks.join(known, ["target", "length", "no"]).select("sink", "source", "rank", "length", steps.alias("steps"))


def _carried(edges: DataFrame, layer: DataFrame, length: int) -> DataFrame:
    """source, length, target, sinks: what the edges' targets have, less the ways that come back to the source; cut tells where one did and others had been left out."""

    def free(s: Column) -> Column:
        ways = F.filter(s["ways"], lambda w: ~F.array_contains(w, F.col("source")))
        return F.struct(s["no"], s["sink"], ways.alias("ways"), s["more"], (s["more"] & (F.size(ways) < F.size(s["ways"]))).alias("cut"))

    sinks = F.filter(F.transform("sinks", free), lambda s: (s["sink"] != F.col("source")) & ((F.size(s["ways"]) > 0) | s["cut"]))
    carried = edges.join(layer.drop("length"), F.col("target") == F.col("at")).select("source", F.lit(length).alias("length"), "target", sinks.alias("sinks"))
    return carried.filter(F.size("sinks") > 0)


def _picked(carried: DataFrame, kept: int) -> DataFrame:
    """source, no, sink, ways (the first `kept`), more (whether there may be others), lost (whether one that was left out before may belong among them)."""
    each = carried.repartition("source").select("source", "length", "target", F.explode("sinks").alias("s")).select("source", "length", "target", "s.*")
    # Each row has a way or a loss, so those behind the first kept + 1 change nothing.
    order = W.partitionBy("source", "sink").orderBy("length", "target")
    each = each.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= kept + 1)
    rows = each.groupBy("source", "no", "sink").agg(F.array_sort(F.collect_list(F.struct("length", "target", "ways", "more", "cut"))).alias("rows"))

    def ways(r: Column) -> Column:
        via = F.filter(F.array(r["target"]), lambda x: x != F.col("sink"))
        return F.transform(r["ways"], lambda w: F.concat(via, w))

    def walked(s: Column, r: Column) -> Column:
        n = s["n"] + F.size(r["ways"])
        return F.struct(n.alias("n"), (s["lost"] | (r["cut"] & (n < kept))).alias("lost"))

    all_ways = F.flatten(F.transform("rows", ways))
    more = (F.size(all_ways) > kept) | F.exists("rows", lambda r: r["more"])
    lost = F.aggregate("rows", F.struct(F.lit(0).alias("n"), F.lit(False).alias("lost")), walked)["lost"]
    return rows.select("source", "no", "sink", F.slice(all_ways, 1, kept).alias("ways"), more.alias("more"), lost.alias("lost"))


def sink_flows(edges: DataFrame, calls: DataFrame, sinks: DataFrame, origins: DataFrame, *, most: int = MOST, hops: int = HOPS) -> DataFrame:
    """sink_id and paths (schemas.FLOWS): for each sink call its first paths, of all its sources, shortest first.

    edges: source, target, between ids of calls. sinks: id, category, code; origins: id of source calls; calls: id, code, filename, line_number, containing.
    """
    node = lambda df: df.select(F.col("id").alias("node"))
    paths = flow_paths(edges, node(origins), node(sinks), most=most, hops=hops)
    first = W.partitionBy("sink").orderBy("length", "steps")
    paths = paths.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most)
    step = F.struct(F.col("filename").alias("file"), F.col("line_number").cast("int").alias("line_number"), F.col("containing").alias("method"), "code")
    known = calls.select(F.col("id").alias("node"), step.alias("step"))
    each = paths.select("sink", "place", F.posexplode("steps").alias("pos", "node")).join(known, "node")
    # At most hops + 1 steps of a path, and `most` paths of a sink.
    each = each.groupBy("sink", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "step"))), lambda x: x["step"]).alias("steps"))
    named = each.join(sinks.select(F.col("id").alias("sink"), F.concat("category", F.lit(": "), "code").alias("text")), "sink")
    path = F.struct(F.get("steps", F.lit(0))["code"].alias("source"), F.col("text").alias("sink"), "steps")
    return named.groupBy(F.col("sink").alias("sink_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", path.alias("path")))), lambda x: x["path"]).alias("paths"))
