"""Contexts for a judge: one nested row for each candidate, and its rendering as a prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_public_route, route_verb
from ..functions.rules import Rule
from ..functions.text import WINDOW, flow_text, imports, line_range, lines, numbered_window
from .evidence import guard_evidence
from .graph import at_most, callees_of, callers_of, latest_definitions, resolved_handlers
from .mutation import split_call_args
from .shortlist import distinct_guards, grouped, guards

#: Neighbours of a function context, of an absence context; lines of a neighbour's code; imports that a prompt shows; characters for neighbours.
RELATED, RELATED_ABSENCE, RELATED_LINES, IMPORTS_SHOWN, RELATED_CHARS = 5, 6, 120, 40, 4000
REF = "array<struct<file:string,start_line:int,end_line:int,name:string,code:string>>"


def with_code(methods: DataFrame, files: DataFrame, most: int = 400) -> DataFrame:
    """methods with code, the source of their range ('' without a file)."""
    text = files.select(F.col("file").alias("filename"), lines(F.col("text")).alias("lines_"))
    code = F.coalesce(line_range(F.col("lines_"), F.col("start_line"), F.col("end_line"), most), F.lit(""))
    return methods.join(text, "filename", "left").withColumn("code", code).drop("lines_")


def related(edges: DataFrame, other: str, methods: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """full_name and refs, the code of its first neighbours by name. The code of a neighbour is read once, however many name it."""
    few = at_most(edges, "full_name", other, most)
    used = methods.join(few.select(F.col(other).alias("full_name")).distinct(), "full_name", "left_semi")
    coded = with_code(used, files, RELATED_LINES).select(
        F.col("full_name").alias(other), F.struct(F.col("filename").alias("file"), "start_line", "end_line", F.col("full_name").alias("name"), "code").alias("ref"),
    )
    item = F.struct(F.col(other).alias("k"), "ref")
    return few.join(coded, other).groupBy("full_name").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["ref"]).alias("refs"))


def _with_imports(contexts: DataFrame, files: DataFrame, lang: str) -> DataFrame:
    found = files.select("file", imports(F.col("text"), lang).alias("imports"))
    return contexts.join(found, "file", "left").withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))


def _base(methods: DataFrame, files: DataFrame, lang: str, prefix: str = "") -> DataFrame:
    out = with_code(methods, files).withColumnRenamed("filename", "file")
    key = F.concat(F.lit(prefix), "file", F.lit(":"), "full_name", F.lit(":"), F.col("start_line").cast("string"))
    return _with_imports(out.withColumn("context_id", key).withColumn("language", F.lit(lang)), files, lang)


def function_contexts(candidates: DataFrame, methods: DataFrame, calls: DataFrame, files: DataFrame, lang: str, source_hits: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """candidates: full_name, hits (with category, cwe, call id as position). flows: sink_id, paths. Candidates without a method fall out."""
    known = latest_definitions(methods, "id")
    base = _base(known.join(candidates.select("full_name", "hits"), "full_name"), files, lang)
    for name, edges, other in (("callers", callers_of(calls, known), "caller"), ("callees", callees_of(calls, known), "callee")):
        edges = edges.join(candidates.select("full_name"), "full_name", "left_semi")
        base = base.join(related(edges, other, known, files, RELATED).withColumnRenamed("refs", name), "full_name", "left").withColumn(name, F.coalesce(name, F.array().cast(REF)))
    origin = source_hits.groupBy(F.col("containing").alias("full_name")).agg(F.slice(F.array_sort(F.collect_set("code")), 1, 10).alias("matched_source_patterns"))
    base = base.join(origin, "full_name", "left").withColumn("matched_source_patterns", F.coalesce("matched_source_patterns", F.array().cast("array<string>")))
    label = F.transform("hits", lambda h: F.concat(h["category"], F.lit(" ("), h["cwe"], F.lit(")")))
    base = base.withColumn("matched_sink_patterns", F.array_sort(F.array_distinct(label)))
    if flows is None:
        return base.withColumn("data_flow_paths", F.array().cast("array<string>"))
    paths = base.select("full_name", F.explode("hits").alias("h")).join(flows, F.col("h.position") == F.col("sink_id"))
    paths = paths.groupBy("full_name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sink_id", F.slice("paths", 1, 3).alias("p")))), lambda x: x["p"])).alias("paths"))
    base = base.join(paths, "full_name", "left")
    return base.withColumn("data_flow_paths", F.coalesce(F.transform("paths", flow_text), F.array().cast("array<string>"))).drop("paths")


def absence_contexts(candidates: DataFrame, methods: DataFrame, calls: DataFrame, files: DataFrame, lang: str, guard_rules: list[Rule], *, mark: str | None = None, guard_lines: DataFrame | None = None) -> DataFrame:
    """candidates: full_name, hits (triggers). Each context has the guard evidence of its method; an empty array is the signal."""
    known = latest_definitions(methods, "id")
    wanted = known.join(candidates.select("full_name", "hits"), "full_name")
    base = _base(wanted, files, lang, "absence:").withColumnRenamed("hits", "control_triggers")
    edges = callers_of(calls, known).join(candidates.select("full_name"), "full_name", "left_semi")
    base = base.join(related(edges, "caller", known, files, RELATED_ABSENCE).withColumnRenamed("refs", "callers"), "full_name", "left").withColumn("callers", F.coalesce("callers", F.array().cast(REF)))
    found = guard_evidence(known, calls, files, guard_rules, wanted, mark=mark, lines=guard_lines)
    return _with_guards(base, found, "full_name").withColumn("route_path", F.lit(""))


def _with_guards(contexts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    item = F.struct("position", "control", "category", "code", "file", "line", "node_id", "scope")
    evidence = found.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("guard_evidence"))
    none = F.array().cast(evidence.schema["guard_evidence"].dataType)
    return contexts.join(evidence, key, "left").withColumn("guard_evidence", F.coalesce("guard_evidence", none))


def route_contexts(routes: DataFrame, methods: DataFrame, calls: DataFrame, files: DataFrame, lang: str, guard_rules: list[Rule], *, mark: str | None = None, guard_lines: DataFrame | None = None) -> DataFrame:
    """One context for each route registration. routes: id, code, filename, line_number, containing, category, route_path.

    Guards come from the registration's middleware and from the body of the handler that its last argument names.
    """
    args = split_call_args(F.col("code"))
    r = routes.withColumn("args", args).withColumn("handler_expr", F.when(F.size("args") >= 2, F.element_at("args", -1)).otherwise(""))
    r = resolved_handlers(r, methods)
    middle = F.slice("args", F.lit(2), F.greatest(F.size("args") - 2, F.lit(0)))
    each = r.select("id", "filename", "line_number", F.col("code").alias("call_code"), F.posexplode(middle).alias("pos", "expr"))
    note = F.concat(F.trim("expr"), F.lit("  (middleware on "), F.substring(F.trim("call_code"), 1, 120), F.lit(")"))
    mw = guards(each, guard_rules, "expr").select(
        F.col("id").alias("route_id"), "control", "category", note.alias("code"), F.col("filename").alias("file"), F.col("line_number").alias("line"), F.col("id").cast("bigint").alias("node_id"),
        F.lit("route-middleware").alias("scope"), F.struct(F.lit(0).alias("a"), F.col("pos").cast("bigint").alias("b")).alias("position"),
    )
    named = r.filter("handler is not null").select(F.col("id").alias("route_id"), "handler.*")
    body = guard_evidence(methods, calls, files, guard_rules, named.select("full_name", "name").distinct(), mark=mark, lines=guard_lines).filter("scope <> 'route-middleware'")
    body = named.select("route_id", "full_name").join(body, "full_name").select(
        "route_id", "control", "category", "code", "file", "line", "node_id", "scope", F.struct(F.col("position.a").alias("a"), F.col("position.c").alias("b")).alias("position"),
    )
    inline = guards(r.filter("handler is null").select("id", "filename", "line_number", F.posexplode(F.split("code", "\n")).alias("pos", "code")), guard_rules, "code").select(
        F.col("id").alias("route_id"), "control", "category", "code", F.col("filename").alias("file"), (F.col("line_number") + F.col("pos")).alias("line"),
        F.col("id").cast("bigint").alias("node_id"), F.lit("handler").alias("scope"), F.struct(F.lit(1).alias("a"), F.col("pos").cast("bigint").alias("b")).alias("position"),
    )
    found = distinct_guards(mw.unionByName(body).unionByName(inline), "route_id", "position")

    text = files.select(F.col("file").alias("filename"), lines(F.col("text")).alias("lines_"))
    handler_text = files.select(F.col("file").alias("handler_file"), lines(F.col("text")).alias("handler_lines"))
    r = r.withColumn("handler_file", F.col("handler.filename")).join(text, "filename", "left").join(handler_text, "handler_file", "left")
    here = F.col("line_number")
    place = F.coalesce(F.nullif(F.col("route_path"), F.lit("")), here.cast("string"))
    own = F.coalesce(F.nullif(line_range(F.col("lines_"), here, here, 3), F.lit("")), F.col("code"))
    head = F.concat(F.lit("// "), route_verb(F.col("code")), F.lit(" "), F.coalesce(F.nullif(F.col("route_path"), F.lit("")), F.lit("?")), F.lit("  registered at "), "filename", F.lit(":"), here.cast("string"))
    h = F.col("handler")
    with_handler = F.concat_ws("\n", head, own, F.lit(""), F.concat(F.lit("// handler: "), h["full_name"], F.lit("  ("), h["filename"], F.lit(":"), h["start_line"].cast("string"), F.lit(")")), line_range(F.col("handler_lines"), h["start_line"], h["end_line"], 200))
    without = F.concat_ws("\n", head, own, F.lit(""), F.lit("// inline handler (following lines):"), line_range(F.col("lines_"), here, here + 40, 40))
    out = r.select(
        F.concat(F.lit("absence-route:"), "filename", F.lit(":"), place, F.lit(":"), here.cast("string")).alias("context_id"),
        F.lit(lang).alias("language"), F.col("filename").alias("file"), F.col("id").alias("route_id"), "route_path",
        F.coalesce(h["full_name"], F.concat("containing", F.lit("#"), place)).alias("full_name"),
        F.coalesce(h["name"], F.concat(F.lit("route "), route_verb(F.col("code")), F.lit(" "), "route_path")).alias("method_name"),
        here.alias("start_line"), F.when(h["filename"] == F.col("filename"), h["end_line"]).otherwise(here).alias("end_line"),
        F.when(h.isNotNull(), with_handler).otherwise(without).alias("code"),
        F.array(F.struct(F.lit("route").alias("operation"), "category", "code", F.col("filename").alias("file"), here.alias("line"), F.col("id").alias("node_id"), "route_path")).alias("control_triggers"),
    )
    return _with_guards(out, found, "route_id")


def distinct_routes(routes: DataFrame) -> DataFrame:
    """One row for each file and line, the first by call id."""
    return routes.groupBy("filename", "line_number").agg(F.min_by(F.struct(*routes.columns), "id").alias("r")).select("r.*")


def raw(contexts: DataFrame, files: DataFrame, *arrays: str, most: int | None = WINDOW, cut: Callable[[Column], Column] = lines) -> DataFrame:
    """The ungrounded form: the numbered file in place of the code (of one longer than most characters a window; None: all), and the given arrays empty. cut parts a text into lines."""
    text = files.select("file", "text")
    out = contexts.join(text, "file", "left").withColumn("code", F.coalesce(numbered_window(F.col("text"), F.col("start_line"), most, cut=cut), F.lit(""))).drop("text")
    return out.withColumns({a: F.filter(a, lambda x: F.lit(False)) for a in arrays}).withColumn("grounding", F.lit("raw"))


def budgeted(parts: Column, budget: int, truncated: str) -> Column:
    """The first parts whose lengths add up to the budget at most, and a mark if any is left out."""
    none = F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, part: Column) -> Column:
        left = s["left"] - F.length(part)
        more = F.when(s["left"] < 0, s["kept"]).when(left < 0, F.concat(s["kept"], F.array(F.lit(truncated)))).otherwise(F.concat(s["kept"], F.array(part)))
        return F.struct(F.when(s["left"] < 0, s["left"]).otherwise(left).alias("left"), more.alias("kept"))

    return F.aggregate(parts, none, step, lambda s: s["kept"])


def _head(title: str) -> list[Column]:
    parameters = F.array_join("parameters", ", ")
    return [
        F.concat(F.lit(f"### {title}: "), "full_name"),
        F.concat(F.lit("File: "), "file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")),
        F.concat(F.lit("Parameters: "), F.when(parameters == "", "(none)").otherwise(parameters)),
        F.lit(""), F.concat(F.lit("```"), "language"), F.col("code"), F.lit("```"),
    ]


def _some(column: str, text: Column) -> Column:
    return F.when(F.size(column) > 0, text)


def _refs(column: str, title: str, noun: str) -> Column:
    snippet = F.transform(column, lambda c: F.concat(F.lit("- "), c["name"], F.lit(" ("), c["file"], F.lit(":"), c["start_line"].cast("string"), F.lit(")\n```"), F.col("language"), F.lit("\n"), c["code"], F.lit("\n```")))
    return _some(column, F.concat_ws("\n", F.lit(f"\n### {title}"), F.array_join(budgeted(snippet, RELATED_CHARS, f"- ... additional {noun} truncated ..."), "\n")))


def _imports() -> Column:
    return _some("imports", F.concat(F.lit("\nImports/dependencies visible in this file:\n"), F.array_join(F.slice("imports", 1, IMPORTS_SHOWN), ", ")))


def prompt() -> Column:
    """The prompt of a function context."""
    flows = F.transform("data_flow_paths", lambda p, i: F.concat(F.lit("\nPath "), (i + 1).cast("string"), F.lit(":\n"), p))
    return F.concat_ws(
        "\n", *_head("Target function"), _imports(),
        _some("matched_sink_patterns", F.concat(F.lit("\nStatic sink patterns matched inside this function: "), F.array_join("matched_sink_patterns", ", "))),
        _some("matched_source_patterns", F.concat(F.lit("Static source/taint-origin patterns matched: "), F.array_join("matched_source_patterns", ", "))),
        _refs("callers", "Callers (who invokes this function)", "callers"), _refs("callees", "Callees (what this function calls)", "callees"),
        _some("data_flow_paths", F.concat(F.lit("\n### Data-flow paths found by the CPG dataflow engine\n"), F.array_join(flows, "\n"))),
    )


# The wording of prompts on which results must agree.
PUBLIC_NOTE = (
    "matches a conventional PUBLIC endpoint (authentication flow, health/status probe, or static asset). A missing access control here is almost always "
    "intentional -- do NOT report it unless the handler demonstrably exposes another user's data or performs a privileged state change."
)
NO_GUARD = "(none) -- no authentication, authorization, ownership, session or validation check was detected on this function or any shown caller."


def absence_prompt() -> Column:
    """The prompt of an absence context: operations that need a control, and the guards found."""

    def trigger(t: Column) -> Column:
        route = F.when(t["route_path"] != "", F.concat(F.lit('  route="'), t["route_path"], F.lit('"'))).otherwise("")
        return F.concat(F.lit("- ["), t["operation"], F.lit("] "), t["category"], F.lit(" (CPG node "), t["node_id"].cast("string"), F.lit(", "), t["file"], F.lit(":"), t["line"].cast("string"), F.lit(")"), route, F.lit("\n    "), t["code"])

    def guard(g: Column) -> Column:
        node = F.when(g["node_id"] >= 0, F.concat(F.lit("CPG node "), g["node_id"].cast("string"))).otherwise("source match")
        return F.concat(F.lit("- ["), g["control"], F.lit("] "), g["category"], F.lit(" ("), g["scope"], F.lit(", "), node, F.lit(", "), g["file"], F.lit(":"), g["line"].cast("string"), F.lit(")\n    "), g["code"])

    title = F.lit("\n### Guard evidence found on this function and its callers\n")
    found = F.when(F.size("guard_evidence") > 0, F.concat(title, F.array_join(F.transform("guard_evidence", guard), "\n"))).otherwise(F.concat(title, F.lit(NO_GUARD)))
    note = F.when(is_public_route(F.col("route_path")), F.concat(F.lit("\n### NOTE: `"), "route_path", F.lit("` " + PUBLIC_NOTE)))
    return F.concat_ws(
        "\n", *_head("Candidate function"), note,
        F.lit("\n### Operations found in this function that may require an access control"), F.array_join(F.transform("control_triggers", trigger), "\n"),
        found, _imports(), _refs("callers", "Callers (route registrations / middleware / wrappers)", "callers"),
    )


# Fixed value: the wording of the ungrounded prompt.
RAW_NOTE = (
    "No call graph or guard list has been extracted for you -- read the file to determine what checks are or aren't applied before that operation, "
    "including middleware on the route registration.\nEach line below is prefixed with its file line number followed by `│`; cite those numbers in your findings.\n"
)


def raw_prompt() -> Column:
    """The prompt of an ungrounded context: the numbered file."""
    route = F.when(F.col("route_path") != "", F.concat(F.lit(" (route `"), "route_path", F.lit("`)."))).otherwise(".")
    return F.concat_ws(
        "\n", F.concat(F.lit("### Source file: "), "file"), F.concat(F.lit("The operation to judge is around line "), F.col("start_line").cast("string"), route),
        F.lit(RAW_NOTE), F.concat(F.lit("```"), "language"), F.col("code"), F.lit("```"),
    )


def hit_groups(found: DataFrame, *columns: str) -> DataFrame:
    return grouped(found, "containing", "id", *columns).withColumnRenamed("containing", "full_name")
