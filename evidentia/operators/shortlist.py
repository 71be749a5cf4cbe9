"""Candidates by ordered rules: first match for each call, groups by method, guards, triggers, and what lacks a guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import route_path
from ..functions.rules import Rule, attribute, marked


def ruled(rows: DataFrame, rules: list[Rule], *columns: str, mark: str | None = None) -> DataFrame:
    """Rows that hit a rule, with rule, the ordinal of the first in order that does. mark: a column that has the ordinal already."""
    found = rows.withColumn("rule", F.col(mark)) if mark else marked(rows, {"rule": rules}, *columns)
    return found.filter("rule is not null")


def shortlist(calls: DataFrame, rules: list[Rule], *columns: str, mark: str | None = None) -> DataFrame:
    """Rows that hit a rule, with rule (its ordinal) and its category, cwe and severity. The first rule in order wins."""
    return ruled(calls, rules, *columns, mark=mark).withColumns({a: attribute(rules, F.col("rule"), a) for a in ("category", "cwe", "severity")})


def triggers(calls: DataFrame, rules: list[Rule], *columns: str, mark: str | None = None) -> DataFrame:
    """Rows that hit a trigger, with category, operation and, for routes, route_path."""
    found = ruled(calls, rules, *columns, mark=mark).withColumns({a: attribute(rules, F.col("rule"), a) for a in ("category", "operation")})
    return found.withColumn("route_path", F.when(F.col("operation") == "route", route_path(F.col(columns[0]))).otherwise(""))


def triggers_within(calls: DataFrame, rules: list[Rule], *columns: str) -> DataFrame:
    """Triggers of a handler: the rules for routes don't take part, not even to win."""
    return triggers(calls, [r for r in rules if r.operation != "route"], *columns)


def sources(calls: DataFrame, rules: list[Rule], *columns: str, mark: str | None = None) -> DataFrame:
    return ruled(calls, rules, *columns, mark=mark).select(*calls.columns)


def guards(rows: DataFrame, rules: list[Rule], *columns: str, mark: str | None = None) -> DataFrame:
    """Rows that hit a guard, with its control and category; the first guard in order wins."""
    return ruled(rows, rules, *columns, mark=mark).withColumns({a: attribute(rules, F.col("rule"), a) for a in ("control", "category")})


def guard_lines(texts: DataFrame, rules: list[Rule], *, text: str = "code", first_line: str = "line") -> DataFrame:
    """Guards in texts line by line; line numbers count from the text's first line."""
    keep = [c for c in texts.columns if c not in (text, first_line)]
    each = texts.select(*keep, F.col(first_line).alias("first"), F.posexplode(F.split(text, "\n")).alias("pos", "code"))
    each = each.select(*keep, (F.col("first") + F.col("pos")).alias("line"), "code")
    return guards(each, rules, "code")


def distinct_guards(evidence: DataFrame, key: str, order: str, most: int = 400) -> DataFrame:
    """One row for each control, file, line and stripped code within a key, the first in order; code is cut afterwards."""
    stripped = F.regexp_replace("code", r"^\s+|\s+$", "")
    first = W.partitionBy(key, "control", "file", "line", "code").orderBy(order)
    rows = evidence.withColumn("code", stripped).withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    return rows.withColumn("code", F.substring("code", 1, most))


def grouped(found: DataFrame, method: str, position: str, *columns: str) -> DataFrame:
    """A row for each method: hits in order of position, their number, and the position of the first."""
    item = F.struct(F.col(position).alias("position"), *[F.col(c) for c in columns])
    return found.groupBy(method).agg(F.array_sort(F.collect_list(item)).alias("hits"), F.count("*").alias("n_hits"), F.min(position).alias("first_position"))


def top_candidates(groups: DataFrame, most: int) -> DataFrame:
    """The groups with most hits; ties go to the one seen first."""
    return groups.orderBy(F.desc("n_hits"), "first_position").limit(most) if most else groups


def with_budget(routes: DataFrame, methods: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """Rows of both under one budget: routes come first, methods get what is left, in the given order within each."""
    both = routes.withColumn("kind", F.lit(0)).unionByName(methods.withColumn("kind", F.lit(1)))
    return both.orderBy("kind", *order).limit(most)


def without_guard(candidates: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Candidates for which no evidence of a guard was found: the signal of the absence mode."""
    return candidates.join(evidence.select(key).distinct(), key, "left_anti")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("k_", F.row_number().over(w)).filter("k_ = 1").drop("k_")
