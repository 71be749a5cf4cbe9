"""Sinks: labels, reports as JSON, Markdown and SARIF, and the results page.

A report is a folder of files whose texts, in the order of their names, are the document: a head, findings in report order dealt by range, and a foot. Findings are
rendered and sorted where they are; what passes through the driver is the counts of severities and the names of files. The functions that give a report as one row are for
reports of a size that people read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.evaluation import pooled
from ..operators.judge import rank
from ..session import hadoop

TOOL = "evidentia"


@dataclass
class Run:
    """What a report's header tells of a run; what is empty or 0 is left out."""

    repo: str
    commit: str = ""
    model: str = ""
    languages: tuple[str, ...] = ()
    generated: str = ""
    contexts: int = 0
    functions: int = 0
    matches: int = 0
    calls: int = 0
    input_tokens: int = 0
    output_tokens: int = 0
    seconds: float = 0.0
    stages: tuple[tuple[str, float], ...] = ()


@dataclass
class Body:
    """Texts (column text) in the order of the given columns, as a part of a document; between two of them comes `between`."""

    rows: DataFrame
    order: tuple[str, ...]
    between: str = ""


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _ordered(found: DataFrame, *columns: Column) -> Column:
    """Collects rows of findings in report order. A report holds what people read, so it is one row by design."""
    item = F.struct(rank(F.col("severity"), fixed.SEVERITIES).alias("r"), "file", "start_line", "id", F.struct(*columns).alias("x"))
    return F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"])


def write_sections(spark: SparkSession, folder: str, sections: list[str | Body]) -> None:
    """A document as a folder of text files, in the order of their names. It is there as a whole or not at all: files are made beside it and moved at the end."""
    made = f"{folder.rstrip('/')}.{uuid.uuid4().hex}"
    where, files = hadoop(spark, made)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def put(name: str, text: str) -> None:
        out = files.create(path(f"{made}/{name}.txt"))
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    try:
        for k, section in enumerate(sections):
            if isinstance(section, str):
                put(f"{k:03d}", section)
                continue
            sorted_ = section.rows.repartitionByRange(*section.order).sortWithinPartitions(*section.order)
            later = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) > 0  # within its file
            sorted_.select(F.concat(F.when(later, section.between).otherwise(""), "text").alias("text")).write.text(f"{made}/rows")
            parts = sorted(f.getPath().getName() for f in files.listStatus(path(f"{made}/rows")) if f.getLen() and f.getPath().getName().startswith("part-"))
            for i, name in enumerate(parts):
                if i and section.between:
                    put(f"{k:03d}-{i:06d}-0", section.between)
                files.rename(path(f"{made}/rows/{name}"), path(f"{made}/{k:03d}-{i:06d}-1.txt"))
            files.delete(path(f"{made}/rows"), True)
        files.delete(path(folder), True)
        if not files.rename(where, path(folder)):
            raise OSError(f"{made} can't be moved to {folder}")
    except BaseException:
        files.delete(where, True)
        raise


#: Columns that order findings in a report.
ORDER = ("r_", "file", "start_line", "id")


def _in_order(found: DataFrame, text: Column) -> Body:
    return Body(found.select(rank(F.col("severity"), fixed.SEVERITIES).alias("r_"), *ORDER[1:], text.alias("text")), ORDER)


def json_sections(found: DataFrame, run: Run) -> list[str | Body]:
    head = json.dumps({"repo": run.repo, "commit_sha": run.commit, "model": run.model}, ensure_ascii=False, separators=(",", ":"))[:-1]
    body = _in_order(found, F.to_json(F.struct(*found.columns)))
    body.between = ","
    return [head + ',"findings":[', body, "]}"]


def report_json(found: DataFrame, repo: str, commit: str, model: str) -> DataFrame:
    """One row with the whole report as JSON."""
    return found.agg(_ordered(found, *[F.col(c) for c in found.columns]).alias("findings")).select(F.to_json(F.struct(F.lit(repo).alias("repo"), F.lit(commit).alias("commit_sha"), F.lit(model).alias("model"), "findings")).alias("report"))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))


# The wording of the Markdown report, on which results must agree.


def _finding_text() -> Column:
    def optional(title: str, c: str) -> Column:
        return F.when(F.col(c) != "", F.concat(F.lit(f"**{title}:** "), c, F.lit("\n")))

    mark = _lookup(fixed.SEVERITY_MARKS, F.col("severity"))
    return F.concat_ws(
        "\n", F.concat(F.lit("### "), mark, F.lit(" ["), F.upper("severity"), F.lit("] "), "title"), F.lit(""),
        F.concat(F.lit("- **File:** `"), "file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("`")),
        F.concat(F.lit("- **Function:** `"), "function", F.lit("`")),
        F.concat(F.lit("- **Type:** "), "vulnerability_type", F.when(F.col("cwe") != "", F.concat(F.lit(" ("), "cwe", F.lit(")"))).otherwise("")),
        F.concat(F.lit("- **Confidence:** "), "confidence"), F.lit(""), F.concat("description", F.lit("\n")),
        optional("Why context mattered", "context_reasoning"), optional("Data flow", "data_flow_summary"), optional("Suggested fix", "suggested_fix"), F.lit("---\n"),
    )


def header(run: Run) -> str:
    """The head of the Markdown report: what is known of the run."""
    told = {
        "Commit": run.commit and f"`{run.commit}`", "Languages": ", ".join(run.languages), "Model": run.model, "Generated": run.generated,
        "Contexts analyzed": run.contexts and f"{run.contexts} (of {run.functions} functions discovered, {run.matches} sink pattern matches)",
        "LLM calls": run.calls and f"{run.calls} ({run.input_tokens} input / {run.output_tokens} output tokens)", "Duration": run.seconds and f"{run.seconds:.1f}s",
    }
    lines = [f"- **{name}:** {text}" for name, text in told.items() if text]
    stages = ", ".join(f"{name} {seconds:.1f}s" for name, seconds in run.stages if seconds > 0)
    return "\n".join([f"# Vulnerability Report: {run.repo}", "", *lines, *([f"  - stages: {stages}"] if stages else []), ""])


def _summary(counts: dict[str, int]) -> str:
    rows = [f"| {fixed.SEVERITY_MARKS[s]} {s.upper()} | {counts[s]} |" for s in fixed.SEVERITIES if counts.get(s)]
    return "\n".join(["## Summary\n\n| Severity | Count |\n|---|---|", *rows, ""])


def markdown_sections(found: DataFrame, run: Run) -> list[str | Body]:
    counts = {r["severity"]: r["n"] for r in severity_counts(found.filter(F.col("severity").isin(*fixed.SEVERITIES))).collect()}  # a row for each severity
    if not counts and found.isEmpty():
        return [f"{header(run)}\nNo findings. 🎉"]
    return [f"{header(run)}\n{_summary(counts)}\n## Findings\n\n", _in_order(found, _finding_text())]


def report_markdown(found: DataFrame, repo: str, model: str) -> DataFrame:
    """One row with the report as Markdown: counts by severity, then the findings."""
    counts = [F.sum((F.col("severity") == s).cast("int")).alias(s) for s in fixed.SEVERITIES]
    one = found.withColumn("text_", _finding_text()).agg(F.transform(_ordered(found, F.col("text_")), lambda x: x["text_"]).alias("texts"), F.count("*").alias("n"), *counts)
    table = F.concat_ws("\n", F.lit("## Summary\n\n| Severity | Count |\n|---|---|"), *[F.when(F.col(s) > 0, F.concat(F.lit(f"| {fixed.SEVERITY_MARKS[s]} {s.upper()} | "), F.col(s).cast("string"), F.lit(" |"))) for s in fixed.SEVERITIES], F.lit(""))
    head = F.lit(header(Run(repo, model=model)))
    body = F.when(F.col("n") == 0, F.concat(head, F.lit("\nNo findings. 🎉"))).otherwise(F.concat_ws("\n", head, table, F.lit("## Findings\n"), F.array_join("texts", "\n")))
    return one.select(body.alias("report"))


def sarif_rules(found: DataFrame) -> DataFrame:
    """One row for each rule: the first finding in report order names and describes it."""
    rule = F.when(F.col("cwe") != "", F.col("cwe")).otherwise(F.replace("vulnerability_type", F.lit(" "), F.lit("-")))
    order = F.struct(rank(F.col("severity"), fixed.SEVERITIES), "file", "start_line", "id")
    first = found.withColumn("rule_id", rule).groupBy("rule_id").agg(F.min_by(F.struct("vulnerability_type", "description"), order).alias("f"), F.min(order).alias("o"))
    return first.select("rule_id", F.col("f.vulnerability_type").alias("name"), F.substring("f.description", 1, 500).alias("description"), F.col("o").alias("position"))


def sarif_results(found: DataFrame) -> DataFrame:
    rule = F.when(F.col("cwe") != "", F.col("cwe")).otherwise(F.replace("vulnerability_type", F.lit(" "), F.lit("-")))
    return found.select(
        "id", "severity", "file", "start_line", "confidence", "cwe", "context_reasoning", rule.alias("rule_id"), _lookup(fixed.SARIF_LEVELS, F.col("severity")).alias("level"),
        F.concat("title", F.lit(": "), "description").alias("message"), F.greatest(F.lit(1), "start_line").alias("first"), F.greatest(F.lit(1), "end_line").alias("last"),
    )


def _sarif_items(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (position, x) and results (the columns of sarif_results, x) as SARIF has them."""
    text = lambda c: F.struct(F.col(c).alias("text"))
    rules = sarif_rules(found).select("position", F.struct(F.col("rule_id").alias("id"), "name", text("name").alias("shortDescription"), text("description").alias("fullDescription")).alias("x"))
    place = F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("first").alias("startLine"), F.col("last").alias("endLine")).alias("region"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("level"), text("message").alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        F.struct("confidence", "cwe", F.col("context_reasoning").alias("contextReasoning")).alias("properties"),
    )
    return rules, sarif_results(found).withColumn("x", result)


def sarif_sections(found: DataFrame) -> list[str | Body]:
    rules, results = _sarif_items(found)
    rules = Body(rules.select("position", F.to_json("x").alias("text")), ("position",), ",")
    body = _in_order(results, F.to_json("x"))
    body.between = ","
    head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"%s","version":"0.1.0","rules":[' % TOOL
    return [head, rules, ']}},"results":[', body, "]}]}"]


def report_sarif(found: DataFrame) -> DataFrame:
    """One row with the report as SARIF 2.1.0."""
    rules, results = _sarif_items(found)
    rules = rules.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "x"))), lambda r: r["x"]).alias("rules"))
    results = results.agg(_ordered(results, F.col("x")).alias("results")).select(F.transform("results", lambda r: r["x"]).alias("results"))
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit("0.1.0").alias("version"), "rules")
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), "results")
    doc = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return rules.crossJoin(F.broadcast(results)).select(F.to_json(doc).alias("report"))  # one row by one row


def write_report(found: DataFrame, folder: str, repo: str, commit: str, model: str, run: Run | None = None) -> None:
    """The folders report.json, report.md and report.sarif.json, each a document in parts (write_sections)."""
    run = run or Run(repo, commit, model)
    for name, sections in (("report.json", json_sections(found, run)), ("report.md", markdown_sections(found, run)), ("report.sarif.json", sarif_sections(found))):
        write_sections(found.sparkSession, f"{folder}/{name}", sections)


def read_document(spark: SparkSession, folder: str) -> DataFrame:
    """file and line of a document in parts, for reading it with Spark; pos is the line's place in its file."""
    raw = spark.read.option("wholetext", "true").text(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return raw.select("file", F.posexplode(F.split(F.expr("IF(endswith(value, '\\n'), left(value, length(value) - 1), value)"), "\n")).alias("pos", "line"))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """line: the lines of a document in parts without their places, so that a large part is read in splits and never held as one text."""
    return spark.read.text(folder, lineSep="\n").select(F.col("value").alias("line"))


def _cell(c: str, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c).cast("double"))


VARIANTS = {"": "grounded", "-raw": "ungrounded", "-semgrep": "rules only"}


def results_markdown(evaluations: DataFrame) -> DataFrame:
    """One row with the results page: pooled rates of each detector, recall by operator, and the apps."""
    flat = evaluations.select("variant", "summary.*")
    spark = evaluations.sparkSession
    heads, lines = "| detector | apps | mutations | precision | recall | recall_raw | F1 | FP on originals |\n|---|--:|--:|--:|--:|--:|--:|--:|", []
    for k, (suffix, name) in enumerate(VARIANTS.items()):
        p = pooled(flat.filter(F.col("variant") == suffix)).filter("apps > 0")
        line = F.concat_ws(" | ", F.lit(f"| {name}"), F.col("apps").cast("string"), F.col("n_mutations").cast("string"), _cell("precision"), _cell("recall"), _cell("recall_raw"), _cell("f1"), F.concat(F.col("baseline_fp").cast("string"), F.lit(" |")))
        lines.append(p.select(F.lit(0).alias("part"), F.lit(f"{k}").alias("o"), line.alias("line")))
    by = flat.select("variant", F.explode("by_operator").alias("operator", "b")).groupBy("operator", "variant").agg(F.sum("b.tp").alias("tp"), F.sum(F.col("b.tp") + F.col("b.fn")).alias("n"))
    cell = F.concat(F.format_string("%.2f", F.try_divide(F.col("tp"), F.col("n")).cast("double")), F.lit(" ("), F.col("tp").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(")"))
    wide = by.withColumn("cell", cell).groupBy("operator").pivot("variant", list(VARIANTS)).agg(F.first("cell"))
    lines.append(wide.select(F.lit(1).alias("part"), F.col("operator").alias("o"), F.concat(F.lit("| "), F.concat_ws(" | ", "operator", *[F.coalesce(F.col(f"`{v}`"), F.lit("-")) for v in VARIANTS]), F.lit(" |")).alias("line")))
    app = F.concat_ws(" | ", F.concat(F.lit("| "), "app"), F.col("n_mutations").cast("string"), _cell("precision"), _cell("recall"), _cell("recall_raw"), _cell("f1"), F.concat(F.col("baseline_fp").cast("string"), F.lit(" |")))
    lines.append(flat.filter("variant = ''").select(F.lit(2).alias("part"), F.concat(F.lpad((10**6 - F.col("n_mutations")).cast("string"), 8, "0"), "app").alias("o"), app.alias("line")))
    rows = lines[0]
    for more in lines[1:]:
        rows = rows.unionByName(more)
    titles = [(0, "## Overall (pooled across apps)\n\n" + heads), (1, "\n## Recall by operator\n\n| operator | " + " | ".join(VARIANTS.values()) + " |\n|---|--:|--:|--:|"), (2, "\n## Per app (grounded)\n\n| app | mutations | precision | recall | recall_raw | F1 | FP orig |\n|---|--:|--:|--:|--:|--:|--:|")]
    rows = rows.unionByName(spark.createDataFrame([(part, "", line) for part, line in titles], "part int, o string, line string"))
    return rows.agg(F.concat(F.lit("# Evaluation -- results\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "o", "line"))), lambda x: x["line"]), "\n")).alias("page"))
