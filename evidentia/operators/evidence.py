"""Guard evidence for methods: calls elsewhere that name the method, its own body, and its callers' bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule
from ..functions.text import line_range, lines
from .graph import at_most, callers_of
from .shortlist import distinct_guards, guard_lines, guards

#: Lines of a body that are scanned, less one, unless the caller asks for more, and callers that are.
BODY, CALLERS = 200, 8


def _bodies(methods: DataFrame, files: DataFrame, most: int | None) -> DataFrame:
    """full_name, file, line, code of each method's first most + 1 lines (None: all)."""
    text = line_range(lines(F.col("text")), F.col("start_line"), F.col("end_line"), most)
    return methods.join(files.select(F.col("file").alias("filename"), "text"), "filename").select("full_name", F.col("filename").alias("file"), F.col("start_line").alias("line"), text.alias("code"))


def body_guards(methods: DataFrame, files: DataFrame, rules: list[Rule], most: int | None = BODY) -> DataFrame:
    """Guards in the first most + 1 lines of each method (None: in all): body (its full name), control, category, code, file, line."""
    return guard_lines(_bodies(methods, files, most), rules).select(F.col("full_name").alias("body"), "control", "category", "code", "file", "line")


def guard_evidence(methods: DataFrame, calls: DataFrame, files: DataFrame, rules: list[Rule], of: DataFrame | None = None, *, mark: str | None = None, lines: DataFrame | None = None, most: int | None = BODY) -> DataFrame:
    """full_name, control, category, code, file, line, node_id, scope, position.

    methods: full_name, name, filename, start_line, end_line. calls: id, name, code, filename, line_number, containing, callee.
    files: file, text. of: the methods asked for (default all). mark: a column of calls with the ordinal of its guard; lines: body_guards, where they are known already;
    else most bounds the lines of a body as there.
    Calls are reduced to guards before their identifiers are looked at, and identifiers to names of wanted methods before they meet the methods.
    """
    wanted = (of if of is not None else methods).select("full_name", "name").distinct()
    found = guards(calls, rules, "code", "name", mark=mark)
    # Identifiers go without their code, of which there would be a copy for each of its words; a digest of the row tells calls of one id apart.
    told = found.withColumn("row_", F.xxhash64("code", "containing", "filename", "line_number"))
    token = told.select("id", "row_", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"(\w+)"), F.lit(1)))).alias("token"))
    names = token.join(wanted.withColumnRenamed("name", "token"), "token").select("id", "row_", "full_name").distinct()
    naming = told.join(names, ["id", "row_"]).filter("containing <> full_name").select(
        "full_name", "control", "category", "code", F.col("filename").alias("file"), F.col("line_number").alias("line"), F.col("id").alias("node_id"),
        F.lit("route-middleware").alias("scope"), F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.col("id").alias("c"), F.lit(0).alias("d")).alias("position"),
    )

    own_calls = found.select(
        F.col("containing").alias("body"), "control", "category", "code", F.col("filename").alias("file"), F.col("line_number").alias("line"), F.col("id").alias("node_id"), F.lit(0).alias("d"),
    )
    own_lines = (lines if lines is not None else body_guards(methods, files, rules, most)).withColumns({"node_id": F.lit(-1).cast("bigint"), "d": F.lit(1)})
    body = own_calls.withColumn("node_id", F.col("node_id").cast("bigint")).unionByName(own_lines)
    callers = at_most(callers_of(calls, methods), "full_name", "caller", CALLERS).join(wanted.select("full_name"), "full_name", "left_semi")
    scopes = wanted.select("full_name", F.col("full_name").alias("body"), F.lit("handler").alias("scope"), F.lit(1).alias("a"))
    scopes = scopes.unionByName(callers.select("full_name", F.col("caller").alias("body"), F.lit("caller").alias("scope"), F.lit(2).alias("a")))
    place = F.struct("a", F.col("body").alias("b"), F.when(F.col("d") == 0, F.col("node_id")).otherwise(F.col("line")).cast("bigint").alias("c"), "d")
    bodies = scopes.join(body, "body").select("full_name", "control", "category", "code", "file", "line", "node_id", "scope", place.alias("position"))
    return distinct_guards(naming.withColumn("position", F.col("position").cast("struct<a:int,b:string,c:bigint,d:int>")).unionByName(bodies), "full_name", "position")
