"""Joins over the call graph. calls: containing and callee names; methods: full_name, name, filename and more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def latest_definitions(methods: DataFrame, position: str) -> DataFrame:
    """One row for each full_name: of several definitions the last loaded counts."""
    row = F.struct(*methods.columns)
    return methods.groupBy("full_name").agg(F.max_by(row, F.col(position)).alias("m")).select("m.*")


def callers_of(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(full_name, caller): distinct methods that contain a call of full_name. Unknown callers vanish."""
    edges = calls.select(F.col("callee").alias("full_name"), F.col("containing").alias("caller")).distinct()
    return edges.join(methods.select(F.col("full_name").alias("caller")).distinct(), "caller", "left_semi")


def callees_of(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(full_name, callee): distinct methods that full_name calls. External ones vanish."""
    edges = calls.select(F.col("containing").alias("full_name"), "callee").distinct()
    return edges.join(methods.select(F.col("full_name").alias("callee")).distinct(), "callee", "left_semi")


def at_most(edges: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first neighbours of each key, by name."""
    return edges.withColumn("k_", F.row_number().over(W.partitionBy(key).orderBy(order))).filter(F.col("k_") <= most).drop("k_")


def resolved_handlers(exprs: DataFrame, methods: DataFrame, expr: str = "handler_expr") -> DataFrame:
    """exprs with handler, the method that the expression's last identifier names.

    Of several, modules come last, files named after handlers or routes first, then the file name decides.
    """
    name = F.trim(F.element_at(F.split(F.trim(F.col(expr)), r"[.\s(\[]"), -1))
    named = exprs.withColumn("name_", F.when(name.rlike(r"^[^\W\d]\w*$") & ~name.isin("function", "async"), name))
    plain = ~F.contains("filename", F.lit("handler")) & ~F.contains("filename", F.lit("route"))
    order = W.partitionBy("name").orderBy((F.col("name") == "<module>"), plain, "filename", "full_name")
    best = methods.withColumn("k_", F.row_number().over(order)).filter("k_ = 1")
    best = best.select(F.col("name").alias("name_"), F.struct(*[c for c in methods.columns]).alias("handler"))
    return named.join(best, "name_", "left").drop("name_")


def reachable(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(root, node, hops): nodes within the given number of hops, with the least number. edges: source, target; roots: root.

    Beyond two hops each frontier is cut from its lineage, so that no hop makes those before it again.
    """
    edges = edges.select("source", "target").distinct()
    seen = frontier = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct()
    for hop in range(1, hops + 1):
        step = frontier.join(edges, F.col("node") == F.col("source")).select("root", F.col("target").alias("node")).distinct()
        frontier = step.join(seen, ["root", "node"], "left_anti").withColumn("hops", F.lit(hop))
        if hops > 2:
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen
