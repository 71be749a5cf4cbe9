"""From a program's relations to findings: shortlists, contexts, judge, filters and de-duplication, for each mode and for all.

Calls are scanned once: one pass marks each with the rules that it hits in all modes, and is written, with code where a rule hit: of others only the names are used. So are the contexts, the answers and the findings,
because each is used more than once and because a judge is dear and need not say the same twice: every prompt goes to it once. The figures of a run are observed by the jobs that
write, so that no job runs only to count.

A judge is a function from contexts (context_id, prompt) to answers, as in judge.py; every mode's contexts go to it in one table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule, marked, rule_sets
from ..functions.text import class_key
from ..session import saved
from . import contexts, evidence, judge, shortlist
from .graph import latest_definitions

#: Candidates of a mode that become contexts; 0 for all of them.
MOST = 50
MODES = {"injection": ("injection",), "absence": ("absence",), "hygiene": ("hygiene",), "both": ("injection", "absence"), "all": ("injection", "absence", "hygiene")}
COMMON = ["mode", "context_id", "file", "full_name", "start_line", "end_line", "language", "code", "route_path", "guard_controls", "grounding", "prompt"]
#: The column of a call that has the ordinal of its first rule of a kind.
MARK = "mark_{}".format


@dataclass
class Program:
    """What is known of a program: methods and calls (schemas.METHODS, schemas.CALLS), files (file, text), and flows of sink calls if there are any."""

    methods: DataFrame
    calls: DataFrame
    files: DataFrame
    flows: DataFrame | None = None


@dataclass
class Outcome:
    """All three are written tables. counts: contexts, calls of the judge, failures, tokens, findings; seconds: of each stage."""

    findings: DataFrame
    contexts: DataFrame
    answers: DataFrame
    counts: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)


def _finished(found: DataFrame, mode: str, program: Program, grounding: str) -> DataFrame:
    """The columns that all modes share, with the prompt."""
    if "route_path" not in found.columns:
        found = found.withColumn("route_path", F.lit(""))
    controls = F.transform("guard_evidence", lambda g: g["control"]) if "guard_evidence" in found.columns else F.array().cast("array<string>")
    found = found.withColumn("guard_controls", controls)
    if grounding == "raw":
        shown = [c for c in ("callers", "callees", "data_flow_paths", "guard_evidence", "guard_controls") if c in found.columns]
        found = contexts.raw(found, program.files, *shown).withColumn("prompt", contexts.raw_prompt())
    else:
        made = contexts.absence_prompt() if mode == "absence" else contexts.prompt()
        found = found.withColumn("grounding", F.lit(grounding)).withColumn("prompt", made)
    return found.withColumn("mode", F.lit(mode)).select(*COMMON)


def _functions(program: Program, found: DataFrame, lang: str, sources: DataFrame, most: int, flows: DataFrame | None) -> DataFrame:
    groups = shortlist.top_candidates(contexts.hit_groups(found, "category", "cwe"), most)
    return contexts.function_contexts(groups, program.methods, program.calls, program.files, lang, sources, flows)


def _absence(program: Program, rules: dict[str, list[Rule]], lang: str, most: int, grounding: str) -> DataFrame:
    """Route registrations first, one context each; methods with other triggers get what is left of the budget."""
    hits = shortlist.triggers(program.calls, rules["trigger"], "code", "name", mark=MARK("trigger"))
    routes = contexts.distinct_routes(hits.filter("operation = 'route'"))
    others = hits.filter("operation <> 'route'").select(
        "id", "containing", "category", "operation", "code", F.col("filename").alias("file"), F.col("line_number").alias("line"), F.col("id").alias("node_id"), "route_path",
    )
    groups = contexts.hit_groups(others, "category", "operation", "code", "file", "line", "node_id", "route_path")
    if most:
        taken = routes.select(F.col("id").cast("string").alias("key"), F.lit(0).cast("bigint").alias("n_hits"), F.col("id").alias("first_position"))
        both = shortlist.with_budget(taken, groups.select(F.col("full_name").alias("key"), "n_hits", "first_position"), most, [F.desc("n_hits"), F.col("first_position")])
        both = saved(both.select("kind", "key"), "budget")
        routes = routes.join(both.filter("kind = 0").select(F.col("key").cast("bigint").alias("id")), "id", "left_semi")
        groups = groups.join(both.filter("kind = 1").select(F.col("key").alias("full_name")), "full_name", "left_semi")
    known = latest_definitions(program.methods, "id")
    lines = saved(evidence.body_guards(known, program.files, rules["guard"]), "body-guards")
    shared = {"mark": MARK("guard"), "guard_lines": lines}
    by_route = contexts.route_contexts(routes, known, program.calls, program.files, lang, rules["guard"], **shared)
    none = F.array().cast("array<string>")
    by_route = by_route.withColumns({"parameters": none, "imports": none, "callers": F.array().cast(contexts.REF)})
    by_method = contexts.absence_contexts(groups, program.methods, program.calls, program.files, lang, rules["guard"], **shared)
    return _finished(by_route, "absence", program, grounding).unionByName(_finished(by_method, "absence", program, grounding))


def extracted(program: Program, *, mode: str, lang: str, rulesets: dict[str, list[Rule]] | None = None, most: int = MOST, grounding: str = "cpg") -> DataFrame:
    """The contexts of a mode, or of several: COMMON columns. rulesets: rules by kind, the default ones where a kind is missing."""
    parts, rules = [], {kind: given for one in MODES[mode] for kind, given in rule_sets(one, lang).items()} | (rulesets or {})
    kinds = {k: rules[k] for one in MODES[mode] for k in rule_sets(one, lang)}
    calls = marked(program.calls, {MARK(k): given for k, given in kinds.items()}, "code", "name")
    hit = F.coalesce(*[F.col(MARK(k)) for k in kinds]).isNotNull()
    calls = saved(calls.withColumn("code", F.when(hit, F.col("code"))), "marked-calls")
    program = Program(program.methods, calls, program.files, program.flows)
    for one in MODES[mode]:
        if one == "absence":
            parts.append(_absence(program, rules, lang, most, grounding))
            continue
        kind = "sink" if one == "injection" else "check"
        found = shortlist.shortlist(calls, rules[kind], "code", "name", mark=MARK(kind))
        origins = shortlist.sources(calls, rules["source"], "code", "name", mark=MARK("source")) if one == "injection" else calls.limit(0)
        flows = program.flows if one == "injection" else None
        parts.append(_finished(_functions(program, found, lang, origins, most, flows), one, program, grounding))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def keyed(found: DataFrame) -> DataFrame:
    """Contexts under a name of their own among all modes: a context's id is unique within its mode."""
    return found.withColumn("context_id", F.concat_ws("|", "mode", "context_id"))


def judged(found: DataFrame, answers: DataFrame, model: str = "replay") -> DataFrame:
    """Findings of contexts (as extracted) from their answers, each under the filters of its mode, in one pass. answers name contexts as keyed() does."""
    return judge.findings(judge.kept(judge.parsed(answers), keyed(found)), model, "mode")


def analyze(program: Program, answer: Callable[[DataFrame], DataFrame], *, mode: str = "both", lang: str = "javascript", rulesets: dict[str, list[Rule]] | None = None,
            most: int = MOST, grounding: str = "cpg", model: str = "replay", progress: Callable[[str, int], None] | None = None) -> Outcome:
    """Contexts, the judge's answers, and de-duplicated findings. progress is told the number of contexts, and of findings, when they are written."""
    counts: dict[str, int] = {}
    seconds: dict[str, float] = {}

    def stage(name: str, df: DataFrame, figures: dict) -> DataFrame:
        out, seen = saved(df, name, figures)
        counts.update(seen)
        seconds[name] = round(time.perf_counter() - began - sum(seconds.values()), 3)
        if progress and name in seen:
            progress(name, seen[name])
        return out

    began = time.perf_counter()
    found = stage("contexts", extracted(program, mode=mode, lang=lang, rulesets=rulesets, most=most, grounding=grounding), {"contexts": F.count("*")})
    answers = stage("answers", judge.whole(answer(keyed(found).select("context_id", "prompt"))), judge.usage_figures())
    kept = stage("findings", judge.deduplicated(judged(found, answers, model)), {"findings": F.count("*")})
    return Outcome(kept, found, answers, counts, seconds)


def report_order(findings: DataFrame) -> DataFrame:
    """Findings with their class, worst first."""
    rank = judge.rank(F.col("severity"), judge.fixed.SEVERITIES)
    return findings.withColumn("class_key", class_key(F.col("cwe"), F.col("vulnerability_type"))).orderBy(rank, "file", "start_line", "id")
