"""Sources: graph relations, source trees, labels, manifests, evaluation files, another detector's output. All with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.predicates import basename, is_app_file
from . import schemas


def methods(spark: SparkSession, path: str) -> DataFrame:
    """Exported method nodes (JSON lines) that belong to the application; an end line of 0 or less is the start line."""
    raw = spark.read.schema(schemas.GRAPH_METHODS).option("mode", "FAILFAST").json(path).filter(F.col("lineNumber").isNotNull())
    end = F.when(F.coalesce("lineNumberEnd", F.lit(-1)) > 0, F.col("lineNumberEnd")).otherwise(F.col("lineNumber"))
    return raw.filter(is_app_file(F.col("filename"))).select(
        "id", "name", F.col("fullName").alias("full_name"), "filename", F.col("lineNumber").alias("start_line"), end.alias("end_line"),
        F.coalesce("parameters", F.array().cast("array<string>")).alias("parameters"), F.coalesce("returnType", F.lit("")).alias("return_type"),
    )


def calls(spark: SparkSession, path: str) -> DataFrame:
    """Exported call nodes (JSON lines) with a line and an application file."""
    raw = spark.read.schema(schemas.GRAPH_CALLS).option("mode", "FAILFAST").json(path).filter(F.col("lineNumber").isNotNull())
    return raw.filter(is_app_file(F.col("filename"))).select("id", "name", "code", "filename", F.col("lineNumber").alias("line_number"), F.col("calleeFullName").alias("callee"), F.col("containingMethodFullName").alias("containing"))


def flows(spark: SparkSession, path: str, sinks: DataFrame) -> DataFrame:
    """Exported taint paths for each sink call; a line below 0 is null. sinks: id, code, category."""
    raw = spark.read.schema(schemas.GRAPH_FLOWS).json(path).join(sinks.select(F.col("id").alias("sink_id"), F.concat("category", F.lit(": "), "code").alias("sink")), "sink_id")

    def path_of(p: Column) -> Column:
        steps = F.transform(p, lambda s: F.struct(s["filename"].alias("file"), F.when(s["line_number"] >= 0, s["line_number"]).alias("line_number"), s["method"].alias("method"), s["code"].alias("code")))
        return F.struct(F.get(p, F.lit(0))["code"].alias("source"), F.col("sink").alias("sink"), steps.alias("steps"))

    return raw.select("sink_id", F.transform(F.filter("flows", lambda p: F.size(p) > 0), path_of).alias("paths"))


def decoded(raw: Column, schema: str) -> Column:
    """JSON in an interpreter's echo: bare, in quotes or in triple quotes. Null if it is none of these."""
    inner = F.regexp_extract(raw, r'(?s)"""(.*?)"""', 1)
    quoted = F.from_json(F.concat(F.lit('{"v":'), F.regexp_extract(raw, r'(?s)=\s*("(?:\\.|[^"\\])*")\s*$', 1), F.lit("}")), "v string")["v"]
    return F.coalesce(F.from_json(F.nullif(inner, F.lit("")), schema), F.from_json(quoted, schema), F.from_json(raw, schema))


def source_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".js", ".mjs", ".cjs")) -> DataFrame:
    """file (relative to path) and text of a source tree, without skipped folders, tests and bundles."""
    root = path.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    file = F.element_at(F.split("path", f"\\Q{root.removeprefix('file:')}\\E"), -1)
    files = raw.select(file.alias("file"), F.col("content").cast("string").alias("text"))
    skipped = F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, fixed.SKIPPED_DIRS)))
    wanted = F.lower(F.regexp_extract("file", r"(\.[^./]+)$", 1)).isin(*suffixes)
    return files.filter(wanted & ~skipped & ~F.col("file").rlike(fixed.SKIPPED_FILES))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Mutation labels, one JSON object a line; blank lines don't count, anything else that isn't a label fails."""
    return spark.read.schema(schemas.LABELS).option("mode", "FAILFAST").json(path)


def heldout_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of others, from YAML; the app's name defaults to the file's."""
    from pathlib import Path

    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    app = data.get("app") or Path(path).stem
    names = ("challenge", "name", "category", "control_class", "file", "line", "route_path", "note")
    rows = [(app, data.get("commit_sha", ""), *(x.get(n, 0 if n == "line" else "") for n in names)) for x in data.get("labels", [])]
    return spark.createDataFrame(rows, "app string, commit_sha string, challenge string, name string, category string, control_class string, file string, line int, route_path string, note string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).json(path).withColumn("app", F.replace("full_name", F.lit("/"), F.lit("__")))


def evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation files of a folder, with variant ('', -raw or -semgrep, by file name). Aggregates and what isn't an evaluation are left out."""
    raw = spark.read.schema(schemas.EVALUATION).option("multiLine", "true").json(f"{folder}/*.json").withColumn("name", basename(F.input_file_name()))
    variant = F.regexp_extract("name", r"(-raw|-semgrep)\.json$", 1)
    return raw.filter(~F.startswith(F.col("name"), F.lit("_")) & F.col("summary.app").isNotNull()).withColumn("variant", variant)


def heldout_reports(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.HELDOUT).option("multiLine", "true").json(f"{folder}/heldout-*.json").filter("n_labels is not null")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """path and modified of each report.json below a folder, newest first."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "report.json").load(folder)
    return found.select("path", F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")


def repo_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list, without comments and blanks."""
    line = F.trim(F.element_at(F.split("value", "#"), 1))
    return spark.read.text(path).select(line.alias("repo")).filter("repo <> ''")


def detections(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Another rule detector's JSON as findings; its rules say nothing of severity or confidence."""
    raw = spark.read.schema(schemas.DETECTIONS).option("multiLine", "true").json(path).select(F.inline("results"))
    file = F.regexp_replace("path", f"^\\Q{root.rstrip('/')}/\\E", "")
    start = F.coalesce(F.col("start.line"), F.lit(0))
    end = F.coalesce(F.nullif(F.col("end.line"), F.lit(0)), start)
    return raw.select(
        F.concat(F.lit("rule:"), file, F.lit(":"), start.cast("string")).alias("context_id"), file.alias("file"), start.alias("start_line"), end.alias("end_line"), F.lit("").alias("function"),
        F.lit("Missing Access Control").alias("vulnerability_type"), F.coalesce("extra.metadata.cwe", F.lit("CWE-862")).alias("cwe"), F.lit("medium").alias("severity"), F.lit("low").alias("confidence"),
        F.lit("Unprotected route (rule)").alias("title"), F.coalesce("extra.message", F.lit("route registered with no middleware")).alias("description"),
    )


def unprotected_routes(registrations: DataFrame, args: Column) -> DataFrame:
    """The rule-only detector itself: a router call with a literal path and a handler, and nothing between. registrations: code."""
    call = F.col("code").rlike(r"^\s*(?:app|router|api|route|r)\s*\.\s*(?:get|post|put|delete|patch|all)\s*\(")
    return registrations.filter(call & (F.size(args) == 2) & F.trim(F.get(args, F.lit(0))).rlike(r"""^(['"`]).*\1$"""))


def screened(candidates: DataFrame) -> DataFrame:
    """Candidates with a permissive licence, an express dependency and an authentication library.

    candidates: package_json, license_text. The licence is the package's, else named in the licence text's first 400 characters; unknown ones are accepted.
    """
    deps = "map<string,string>"
    p = F.from_json("package_json", f"license string, dependencies {deps}, devDependencies {deps}, peerDependencies {deps}")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    names = F.array_union(F.array_union(F.map_keys(F.coalesce(p["dependencies"], none)), F.map_keys(F.coalesce(p["devDependencies"], none))), F.map_keys(F.coalesce(p["peerDependencies"], none)))
    rows = candidates.withColumn("deps_", names).withColumn("auth_libs", F.filter(F.array(*map(F.lit, fixed.AUTH_LIBRARIES)), lambda x: F.array_contains("deps_", x)))
    own = F.lower(F.trim(F.coalesce(p["license"], F.lit(""))))
    head = F.lower(F.substring(F.coalesce("license_text", F.lit("")), 1, 400))
    told = F.get(F.filter(F.array(*map(F.lit, fixed.LICENSES)), lambda k: F.contains(head, F.element_at(F.split(k, "-"), 1))), F.lit(0))
    licence = F.when(own.isin(*fixed.LICENSES), own).otherwise(F.coalesce(told, F.nullif(own, F.lit("")), F.lit("unknown")))
    rows = rows.withColumn("license_key", licence)
    return rows.filter(F.array_contains("deps_", "express") & (F.size("auth_libs") > 0) & (F.col("license_key").isin(*fixed.LICENSES) | (F.col("license_key") == "unknown"))).drop("deps_")
