import json
import os
import random

from pyspark.sql import functions as F

from evidentia.functions.rules import rules
from evidentia.operators import analysis, contexts, evaluation, evidence, graph, judge, metrics, mutation, shortlist

ROUTER = """const express = require('express');
app.get('/admin', requireAdmin, showAdmin);
app.get('/profile', showProfile);
function showAdmin(req, res) { res.send(1); }
function showProfile(req, res) {
  User.update({ a: 1 });
  if (req.user.id !== doc.ownerId) {
    return res.status(403).end();
  }
}
"""
METHODS = "id bigint, name string, full_name string, filename string, start_line int, end_line int, parameters array<string>, return_type string"
CALLS = "id bigint, name string, code string, filename string, line_number int, callee string, containing string"


def relations(spark):
    methods = spark.createDataFrame([(1, "showAdmin", "r:showAdmin", "r.js", 4, 4, ["req"], ""), (2, "showProfile", "r:showProfile", "r.js", 5, 10, ["req"], ""), (3, ":program", "r:program", "r.js", 1, 3, [], "")], METHODS)
    calls = spark.createDataFrame(
        [(10, "get", "app.get('/admin', requireAdmin, showAdmin)", "r.js", 2, "get", "r:program"), (11, "get", "app.get('/profile', showProfile)", "r.js", 3, "get", "r:program"),
         (12, "update", "User.update({ a: 1 })", "r.js", 6, "update", "r:showProfile"), (13, "showAdmin", "showAdmin()", "r.js", 8, "r:showAdmin", "r:showProfile")], CALLS)
    return methods, calls, spark.createDataFrame([("r.js", ROUTER)], "file string, text string")


def test_route_contexts_and_absence_signal(spark):
    methods, calls, files = relations(spark)
    guards = rules("absence", "javascript", "guard")
    routes = shortlist.triggers(calls, rules("absence", "javascript", "trigger"), "code", "name").filter("operation = 'route'")
    found = {r.route_path: r for r in contexts.route_contexts(contexts.distinct_routes(routes), methods, calls, files, "javascript", guards).collect()}
    assert [g.control for g in found["/admin"].guard_evidence][:1] == ["authorization"] and found["/admin"].full_name == "r:showAdmin"
    assert [(g.control, g.line) for g in found["/profile"].guard_evidence] == [] or {g.scope for g in found["/profile"].guard_evidence} <= {"handler", "caller"}
    assert found["/admin"].code.startswith("// GET /admin  registered at r.js:2\napp.get('/admin'")


def test_contexts_and_prompts(spark):
    methods, calls, files = relations(spark)
    hits = shortlist.triggers(calls, rules("absence", "javascript", "trigger"), "code", "name").filter("operation <> 'route'")
    hits = hits.select("id", "containing", "category", "operation", "code", F.col("filename").alias("file"), F.col("line_number").alias("line"), F.col("id").alias("node_id"), "route_path")
    groups = contexts.hit_groups(hits, "category", "operation", "code", "file", "line", "node_id", "route_path")
    rows = contexts.absence_contexts(groups, methods, calls, files, "javascript", rules("absence", "javascript", "guard"))
    (row,) = rows.withColumn("prompt", contexts.absence_prompt()).collect()
    assert row.context_id == "absence:r.js:r:showProfile:5" and "[db_write] Database write" in row.prompt and row.prompt.startswith("### Candidate function: r:showProfile")
    assert "ownership" in {g.control for g in row.guard_evidence}
    sinks = calls.filter("name = 'update'").select("id", "containing", F.lit("C").alias("category"), F.lit("CWE-1").alias("cwe"))
    made = contexts.function_contexts(contexts.hit_groups(sinks, "category", "cwe"), methods, calls, files, "javascript", calls.filter("id = 12"))
    (row,) = made.withColumn("prompt", contexts.prompt()).collect()
    assert row.matched_sink_patterns == ["C (CWE-1)"] and [c.name for c in row.callees] == ["r:showAdmin"] and row.imports == ["const express = require('express')"]
    assert "### Callees (what this function calls)\n- r:showAdmin (r.js:4)" in row.prompt
    (raw,) = contexts.raw(made, files, "callers", "callees").withColumn("route_path", F.lit("")).withColumn("p", contexts.raw_prompt()).collect()
    assert raw.callees == [] and raw.grounding == "raw" and "     1│const express" in raw.p


def test_guard_evidence_scopes(spark):
    methods, calls, files = relations(spark)
    found = evidence.guard_evidence(methods, calls, files, rules("absence", "javascript", "guard"))
    got = {(r.full_name, r.control, r.scope) for r in found.collect()}
    assert ("r:showAdmin", "authorization", "route-middleware") in got and ("r:showProfile", "ownership", "handler") in got and ("r:showAdmin", "ownership", "caller") in got


def test_graph(spark):
    methods, calls, _ = relations(spark)
    assert [tuple(r) for r in graph.callers_of(calls, methods).select("full_name", "caller").filter("full_name like 'r:%'").collect()] == [("r:showAdmin", "r:showProfile")]
    twice = methods.union(methods.withColumn("id", F.lit(9).cast("bigint")).withColumn("start_line", F.lit(7)))
    assert {r.start_line for r in graph.latest_definitions(twice, "id").collect()} == {7}
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    got = graph.reachable(e, spark.createDataFrame([("a",)], "root string"), 2).collect()
    assert {(r.node, r.hops) for r in got} == {("a", 0), ("b", 1), ("c", 2)}


def sequential(rows):
    kept = []
    for r in sorted(rows):
        if not any(k[3] == r[3] and r[1] <= k[2] and k[1] <= r[2] for k in kept):
            kept.append(r)
    return {r[4] for r in kept}


def test_greedy_intervals_equal_a_sequential_pass(spark):
    random.seed(5)
    rows = [(random.randint(0, 3), s := random.randint(0, 60), s + random.randint(0, 8), random.randint(0, 4), i) for i in range(400)]
    df = spark.createDataFrame(rows, "rank int, s int, e int, k int, id int")
    got = judge.greedy_intervals(df, ["k"], [F.col("rank"), F.col("s"), F.col("e"), F.col("id")], "s", "e", "id")
    assert {r.id for r in got.collect()} == sequential([(r[0], r[1], r[2], r[3], r[4]) for r in rows])


CONTEXT = "context_id string, file string, full_name string, start_line int, end_line int, route_path string, guard_controls array<string>"


def item(**more):
    return {"vulnerability_type": "sql_injection", "cwe": "CWE-89", "severity": "high", "confidence": "high", "title": "t", "description": "d", **more}


def kept_in_turn(rows):
    """rows: key, start, end, id, in order of preference."""
    kept = []
    for key, s, e, i in rows:
        if not any(k == key and s <= b and a <= e for k, a, b, _ in kept):
            kept.append((key, s, e, i))
    return {i for *_, i in kept}


def test_greedy_intervals_of_a_hot_key(spark, monkeypatch):
    """One key over many ranges, with gaps, with one interval over all ranges, and pieces folded both ways."""
    rng = random.Random(8)
    for reach, long in ((4, 500), (60, 20), (60, 500)):
        monkeypatch.setattr(judge, "LONG", long)
        rows = [("hot" if rng.random() < 0.8 else rng.choice(["b", None, "c"]), s := rng.randrange(4000), s + rng.randrange(reach), k) for k in range(1500)]
        rows += [("hot", 500, 3500, 2000)] if reach == 60 else []
        rows.sort(key=lambda r: (r[3] * 7919) % 2003)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "key string, a bigint, b bigint, id int, place int")
            got = judge.greedy_intervals(df, ["key"], [F.col("place")], "a", "b", "id").collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(got) == len({r.id for r in got}) and {r.id for r in got} == kept_in_turn(rows)


def test_medians_by_counting(spark, monkeypatch):
    from statistics import median

    from evidentia.operators import selection

    rng = random.Random(4)
    rows = [(rng.randrange(50), rng.choice([1.5, -2.25, 1e-9, 3e12]) * rng.random(), None if k % 3 else k, 7, None) for k in range(501)]
    monkeypatch.setattr(selection, "BINS", 8)
    for n in (501, 500, 2, 1):
        got = selection.medians(spark.createDataFrame(rows[:n], "a int, b double, c int, d int, e int"), "a", "b", "c", "d", "e")
        for k, c in enumerate("abcde"):
            values = [r[k] for r in rows[:n] if r[k] is not None]
            assert got[c] == (median(values) if values else None)


def test_judge_parsing_filters_and_defaults(spark):
    texts = {
        "a": json.dumps({"findings": [item(start_line=0)]}), "b": "```json\n" + json.dumps({"findings": [item(data_flow_summary="There are no data flow paths here"), item(title="")]}) + "\n```",
        "c": "{broken", "d": json.dumps({"findings": []}), "e": json.dumps({"findings": [item(), item(severity="awful")]}), "f": json.dumps({"findings": [item()]}),
    }
    answers = spark.createDataFrame([(k, v, k == "f", 3, 4) for k, v in texts.items()], judge.ANSWER)
    ctx = spark.createDataFrame([(k, "f.js", "m", 7, 9, "", []) for k in texts], CONTEXT)
    got = {r.id: r for r in judge.findings(judge.kept(judge.parsed(answers), ctx, "injection")).collect()}
    assert set(got) == {"a#0", "b#1"} and (got["a#0"].start_line, got["a#0"].vulnerability_type, got["b#1"].title) == (7, "Sql Injection", "Sql Injection")
    assert judge.usage(answers).first().input_tokens == 18
    assert judge.replayed(ctx.limit(1), answers).count() == 1
    out = judge.judged_by(ctx.select("context_id", F.lit("p").alias("prompt")), lambda p: ("{}", False, 1, 1) if p else None)
    assert out.count() == 6


def test_absence_filters(spark):
    rows = {
        "ok": ({}, "/admin", []), "present": ({"missing_control_reasoning": "the route is properly protected"}, "/admin", []), "none": ({"required_control": "None needed"}, "/x", []),
        "public": ({"missing_control_reasoning": "no check"}, "/login", []), "sensitive": ({"missing_control_reasoning": "reveals another user's data"}, "/login", []),
        "escalated": ({"required_control": "ownership"}, "/x", ["authentication"]), "concrete": ({"required_control": "ownership", "missing_control_reasoning": "IDOR"}, "/x", ["authentication"]),
    }
    answers = spark.createDataFrame([(k, json.dumps({"findings": [item(**v[0])]}), False, 0, 0) for k, v in rows.items()], judge.ANSWER)
    ctx = spark.createDataFrame([(k, "f", "m", 1, 2, v[1], v[2]) for k, v in rows.items()], CONTEXT)
    assert {r.context_id for r in judge.kept(judge.parsed(answers), ctx, "absence").collect()} == {"ok", "sensitive", "concrete"}
    hyg = spark.createDataFrame([("p", json.dumps({"findings": [item(description="a placeholder")]}), False, 0, 0)], judge.ANSWER)
    assert judge.kept(judge.parsed(hyg), ctx.withColumn("context_id", F.lit("p")).limit(1), "hygiene").count() == 0


def test_deduplicated(spark):
    names = "id string, file string, cwe string, vulnerability_type string, severity string, confidence string, start_line int, end_line int"
    rows = [("1", "a", "CWE-94", "x", "medium", "high", 5, 9), ("2", "a", "cwe-94", "y", "high", "low", 8, 12), ("3", "a", "CWE-95", "x", "low", "low", 5, 9), ("4", "b", "CWE-94", "x", "low", "low", 5, 9), ("5", "a", "CWE-94", "x", "low", "low", 13, 14)]
    assert {r.id for r in judge.deduplicated(spark.createDataFrame(rows, names)).collect()} == {"2", "3", "4", "5"}


FOUND = "run_id string, position int, file string, start_line int, end_line int, vulnerability_type string, cwe string, title string, description string, data_flow_summary string"


def test_score_mutations(spark):
    def f(run, pos, file, line, kind="Missing Authentication"):
        return (run, pos, file, line, line, kind, "", f"t{pos}", "", "")

    labels = spark.createDataFrame([(r, "app", "M1", "authentication" if r != "class" else "session", "src/index.js", 45, 45) for r in ("hit", "far", "file", "base", "class", "none")], "run_id string, app string, operator string, control_class string, file string, start_line int, end_line int")
    found = spark.createDataFrame([f("hit", 0, "index.js", 48), f("far", 0, "index.js", 200), f("file", 0, "other.js", 48), f("base", 0, "x/index.js", 47), f("class", 0, "index.js", 48, "Missing Authorization")], FOUND)
    # the baseline has a finding in line 47
    got = {r.run_id: r for r in evaluation.score_mutations(labels, found, spark.createDataFrame([("app", "index.js", 47)], "app string, file string, start_line int")).collect()}
    assert [(k, got[k].detected, got[k].detected_raw, got[k].matched_control_ok, got[k].n_findings) for k in ("hit", "far", "file", "base", "class", "none")] == [
        ("hit", True, True, True, 1), ("far", False, False, False, 1), ("file", False, False, False, 1), ("base", False, True, True, 1), ("class", True, True, False, 1), ("none", False, False, False, 0),
    ]
    (s,) = evaluation.summary(spark.createDataFrame(list(got.values())), spark.createDataFrame([("app", 2)], "app string, baseline_fp int")).collect()
    assert (s.n_mutations, s.tp, s.fn, s.fp, s.recall) == (6, 2, 4, 5, 0.333)


def test_interval_matches_equal_all_pairs(spark):
    random.seed(8)
    labels = [(i, random.randint(0, 1), s := random.randint(0, 300), s + random.randint(0, 30)) for i in range(60)]
    found = [(i, random.randint(0, 1), s := random.randint(0, 300), s + random.randint(0, 90)) for i in range(80)]
    a, b = spark.createDataFrame(labels, "l int, k int, label_start int, label_end int"), spark.createDataFrame(found, "f int, k int, start_line int, end_line int")
    got = [(r.l, r.f) for r in evaluation.interval_matches(a, b, ["k"], 7).collect()]
    want = {(x[0], y[0]) for x in labels for y in found if x[1] == y[1] and any(x[2] - 7 <= p <= x[3] + 7 for p in y[2:])}
    assert len(got) == len(set(got)) and set(got) == want


def test_pick_follows_the_positional_rule(spark):
    random.seed(2)
    rows = [(k, p, random.random() < 0.5, random.random() < 0.4) for k in range(200) for p in range(random.randint(1, 5))]
    got = {r.label: (r.position, r.detected) for r in evaluation.scored(spark.createDataFrame(rows, "label int, position int, novel boolean, class_ok boolean"), "label", "position").collect()}
    for k in range(200):
        pick, detected, ok = None, False, False
        for _, p, novel, good in (r for r in rows if r[0] == k):
            detected |= novel
            if novel or pick is None:
                pick, ok = p, good
            if detected and ok:
                break
        assert got[k] == (pick, detected)


# Published counts of thirteen programs under two detectors (mutations, findings on originals, tp, fp, fn, raw recall).
GROUNDED = [(3, 5, 2, 20, 1, 0.667), (3, 3, 1, 12, 2, 0.667), (3, 3, 0, 12, 3, 0.333), (3, 6, 1, 24, 2, 0.333), (3, 4, 0, 15, 3, 1.0), (3, 1, 0, 5, 3, 0.0), (3, 5, 1, 21, 2, 0.333), (3, 5, 0, 20, 3, 0.0), (3, 2, 0, 7, 3, 0.0), (3, 5, 0, 17, 3, 0.0), (3, 1, 2, 4, 1, 0.667), (3, 1, 0, 4, 3, 1.0), (3, 6, 0, 24, 3, 0.0)]
UNGROUNDED = [(3, 5, 2, 17, 1, 0.667), (3, 3, 1, 10, 2, 0.333), (3, 1, 0, 4, 3, 0.0), (3, 2, 1, 9, 2, 0.333), (3, 2, 3, 8, 0, 1.0), (3, 2, 0, 8, 3, 0.0), (3, 4, 0, 8, 3, 0.0), (3, 4, 0, 16, 3, 0.0), (3, 1, 1, 7, 2, 0.333), (3, 1, 0, 3, 3, 0.0), (3, 2, 2, 9, 1, 0.667), (3, 4, 0, 16, 3, 0.0), (3, 3, 0, 12, 3, 0.0)]


def test_pooled_counts(spark):
    def pool(rows):
        return evaluation.pooled(spark.createDataFrame(rows, "n_mutations int, baseline_fp int, tp int, fp int, fn int, recall_raw double")).first()

    g, u = pool(GROUNDED), pool(UNGROUNDED)
    assert (g.tp, g.fp, g.fn, g.baseline_fp, g.precision, g.recall, g.f1, g.recall_raw) == (7, 185, 32, 47, 0.036, 0.179, 0.06, 0.385)
    assert (u.tp, u.fp, u.fn, u.baseline_fp, u.precision, u.recall, u.f1, u.recall_raw) == (10, 127, 29, 34, 0.073, 0.256, 0.114, 0.256)


def test_metrics(spark):
    files = spark.createDataFrame([("f", "x\n" * 100), ("empty", "")], "file string, text string")
    ctx = spark.createDataFrame([("f", "a\n" * 10)], "file string, code string")
    m = metrics.compression(ctx, files).first()
    assert (m.slice_loc_median, m.file_loc_median, m.slice_over_file_mean) == (10, 100, 0.1)
    c = spark.createDataFrame([("c", "cpg", 10, 25, "")], "context_id string, grounding string, start_line int, end_line int, code string")
    f = spark.createDataFrame([("c", 12, 14), ("c", 200, 204), ("other", 1, 1)], "context_id string, start_line int, end_line int")
    assert tuple(metrics.grounded(f, c).first()) == (2, 1, 0.5) and metrics.grounded(f.limit(0), c).first().ratio is None


JS = """const r = require('x');
router.post('/a', requireAuth, isAdmin, (req, res) => {
  if (req.user.id !== doc.ownerId) {
    return res.status(403).end();
  }
  if (!req.session.user) return res.redirect('/login');
  req.checkBody('n').notEmpty();
  if (!user.isAdmin) { throw new Error('no'); }
  const errors = validationResult(req);
  if (!errors.isEmpty()) {
    return res.status(400).end();
  }
  Thing.create({});
});
"""


def test_mutations(spark):
    files = spark.createDataFrame([("app", "a.js", JS), ("app", "b.js", None)], "app string, file string, text string")
    rows = mutation.mutated(files).collect()
    assert {r.operator for r in rows} == {"M1", "M2", "M3", "M4", "M5"}
    assert {(r.control_class, r.route_path) for r in rows if r.operator == "M1"} == {("authentication", "/a"), ("authorization", "/a")}
    for r in rows:
        assert r.original_text.count("\n") == r.mutated_text.count("\n") and r.original_text == "\n".join(JS.split("\n")[r.start_line - 1 : r.end_line])
    df = spark.createDataFrame(rows).crossJoin(spark.createDataFrame([(JS,)], "text string"))
    made = df.select("*", mutation.applied(F.col("text"), F.col("start_line"), F.col("end_line"), F.col("original_text"), F.col("mutated_text")).alias("mutant"), mutation.applied(F.col("text"), F.col("start_line"), F.col("end_line"), F.lit("stale"), F.lit("")).alias("stale"))
    made = made.withColumn("fine", mutation.balanced(F.col("mutant"))).collect()
    assert all(len(r.mutant.split("\n")) == len(JS.split("\n")) and r.stale is None and r.fine for r in made)


def test_call_arguments():
    assert mutation.call_args("app.get('/x', a, f(1, 2), function (r) { return [1, 2]; })") == ["'/x'", " a", " f(1, 2)", " function (r) { return [1, 2]; }"]
    assert mutation.call_args("x") == [] and mutation.call_args("f()") == [""] and mutation.call_args("f(a, 'b, c") == ["a", " 'b, c"]


def test_validation_needs_a_write_below(spark):
    g = spark.createDataFrame([("f", 1), ("f", 100), ("g", 5)], "file string, line int")
    w = spark.createDataFrame([("f", 61), ("f", 100)], "file string, line int")
    assert {(r.file, r.line) for r in mutation.validations_before_writes(g, w, ["file"], "line").collect()} == {("f", 1)}


FLOW = "sink_id bigint, paths array<struct<source: string, sink: string, steps: array<struct<file: string, line_number: int, method: string, code: string>>>>"


def program(spark):
    methods, calls, files = relations(spark)
    more = spark.createDataFrame([(14, "query", "db.query('x' + req.body.n)", "r.js", 6, "query", "r:showProfile"), (15, "body", "req.body.n", "r.js", 6, "body", "r:showProfile"), (16, "query", "db.query(q)", "r.js", 1, "query", "nobody")], CALLS)
    flows = spark.createDataFrame([(14, [("a", "b", [("r.js", 6, "m", "c")])])], FLOW)
    return analysis.Program(methods, calls.union(more), files, flows)


def asking(folder, fails=()):
    """A judge that reports every context once, and the absence of a guard twice in overlapping lines; a file of the folder for each call. It stands alone, as workers don't have this module."""

    def answer(prompt):
        import json
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if any(word in prompt for word in fails):
            raise TimeoutError("no answer")
        base = {"vulnerability_type": "sql_injection", "cwe": "CWE-89", "severity": "high", "confidence": "high", "title": "t", "description": "d"}
        found = []
        if prompt.startswith("### Candidate function"):
            found = [base | {"vulnerability_type": "missing_access_control", "cwe": "CWE-862", "required_control": "auth", "missing_control_reasoning": "deletes any user's data"}] * 2
        elif "Static sink patterns matched" in prompt:
            assert "Path 1:" in prompt and "Static source/taint-origin patterns matched: " in prompt
            found = [base, base | {"data_flow_summary": "There are no data flow paths"}]
        return json.dumps({"findings": found}), False, 2, 1

    return answer


def test_analysis_from_relations_to_findings(spark, tmp_path):
    answer = asking(str(tmp_path))
    told, p = [], program(spark)
    out = analysis.analyze(p, lambda c: judge.judged_by(c, answer), mode="all", progress=lambda *a: told.append(a))
    ctx = {(r.mode, r.context_id): r for r in out.contexts.collect()}
    assert {k[0] for k in ctx} >= {"injection", "absence"} and ("injection", "r.js:r:showProfile:5") in ctx and sum(k[1].startswith("absence-route:") for k in ctx) == 2
    assert "authorization" in ctx["absence", "absence-route:r.js:/admin:2"].guard_controls
    found = analysis.report_order(out.findings).collect()
    assert [f.severity for f in found] == ["high"] * len(found) and {f.mode for f in found} == {"injection", "absence"} and told == [("contexts", len(ctx)), ("findings", len(found))]
    assert len({f.context_id for f in found if f.mode == "absence"}) == len([f for f in found if f.mode == "absence"]) and [f.vulnerability_type for f in found if f.mode == "injection"] == ["Sql Injection"]
    # Every context is asked about once, however often answers and findings are read.
    assert len(os.listdir(tmp_path)) == len(ctx) == out.counts["calls"] and out.counts == {"contexts": len(ctx), "calls": len(ctx), "failures": 0, "input_tokens": 2 * len(ctx), "output_tokens": len(ctx), "findings": len(found)}
    assert out.answers.count() == len(ctx) and set(out.seconds) == {"contexts", "answers", "findings"}
    # One budget: a single context is the first route; ungrounded contexts show the file and no guards.
    few = analysis.extracted(p, mode="absence", lang="javascript", most=1, grounding="raw").collect()
    assert [r.context_id for r in few] == ["absence-route:r.js:/admin:2"] and few[0].guard_controls == [] and "     1│const express" in few[0].prompt and few[0].grounding == "raw"


def test_code_goes_no_further_than_its_hits(spark, monkeypatch):
    """Marked calls are written with code where a rule hits only; identifiers of guards are dealt out without it."""
    kept, write = {}, analysis.saved
    monkeypatch.setattr(analysis, "saved", lambda df, name, *a: kept.setdefault(name, write(df, name, *a)))
    p = program(spark)
    analysis.extracted(p, mode="all", lang="javascript")
    marks = [c for c in kept["marked-calls"].columns if c.startswith(analysis.MARK(""))]
    calls = kept["marked-calls"].collect()
    assert len(calls) == p.calls.count() and {any(r[m] is not None for m in marks) for r in calls} == {True, False}
    assert all((r.code is not None) == any(r[m] is not None for m in marks) for r in calls)
    found = evidence.guard_evidence(p.methods, kept["marked-calls"], p.files, [], mark=analysis.MARK("guard"))
    exploded = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "explode(array_distinct(" in line]
    assert exploded and all("code#" not in line.split("), ", 1)[1].split("false", 1)[0].rsplit("[", 1)[-1] for line in exploded)


def test_answers_are_kept_and_failures_asked_again(spark, tmp_path):
    calls, store = tmp_path / "calls", tmp_path / "store"
    calls.mkdir()
    asked = spark.createDataFrame([(f"c{k}", f"prompt {k % 7}") for k in range(40)], "context_id string, prompt string")

    def run(fails, **more):
        own = asking(str(calls), fails)
        out = {r.context_id: r for r in judge.remembered(lambda c: judge.judged_by(c, own, 2), str(store), **more)(asked).collect()}
        return out, len(os.listdir(calls))

    out, n = run(("prompt 3", "prompt 5"), slices=3)
    assert n == 7 and len(out) == 40 and {k for k, r in out.items() if r.failure} == {f"c{k}" for k in range(40) if k % 7 in (3, 5)} and out["c3"].failure == "TimeoutError: no answer"
    assert judge.parsed(spark.createDataFrame([tuple(out["c3"])], judge.ASKED)).count() == 0
    out, n = run(("prompt 5",))  # only what failed is asked
    assert n == 9 and {k for k, r in out.items() if r.failure} == {f"c{k}" for k in range(40) if k % 7 == 5}
    out, n = run(())
    assert n == 10 and not any(r.failure for r in out.values())
    out, n = run(("prompt",))  # nothing left to ask
    assert n == 10 and len(out) == 40
    out, n = run((), model="another")
    assert n == 17


def test_evaluate_in_one_call(spark):
    labels = spark.createDataFrame([(f"{a}{k}", a, o, c, "src/i.js", 10 * k, 10 * k) for a, k, o, c in [("x", 1, "M1", "authentication"), ("x", 30, "M2", "ownership"), ("y", 1, "M1", "authentication")]], "run_id string, app string, operator string, control_class string, file string, start_line int, end_line int")
    found = spark.createDataFrame([("x1", 0, "i.js", 11, 11, "Missing Authentication", "", "t", "", ""), ("x1", 1, "i.js", 500, 500, "z", "", "t", "", "")], FOUND)
    results, total = evaluation.evaluate(labels, found, spark.createDataFrame([("x", "i.js", 77), ("x", "j.js", 5)], "app string, file string, start_line int"))
    assert results.count() == 3
    got = {r.app: r for r in total.collect()}
    assert (got["x"].tp, got["x"].fn, got["x"].fp, got["x"].baseline_fp, got["x"].recall) == (1, 1, 3, 2, 0.5) and got["y"].recall == 0
    assert got["x"].by_operator["M1"].recall == 1.0 and got["x"].by_operator["M2"].fn == 1 and set(got["x"].by_control_class) == {"authentication", "ownership"}


def test_heldout_in_one_call(spark):
    labels = spark.createDataFrame([("a", "l1", "routes/x.js", 10, 12, "authorization"), ("a", "l2", "y.js", 10, 10, "session"), ("b", "l3", "x.js", 1, 1, "session")], "app string, label_id string, file string, start_line int, end_line int, control_class string")
    found = spark.createDataFrame([("a", 0, "x.js", 30, 31, "Weak Session", "", "t0", "", ""), ("a", 1, "lib/x.js", 12, 12, "Missing Role Check", "", "t1", "", ""), ("a", 2, "x.js", 33, 90, "z", "", "t2", "", ""), ("a", 3, "y.js", 31, 31, "session", "", "t3", "", "")], "app string, position int, file string, start_line int, end_line int, vulnerability_type string, cwe string, title string, description string, data_flow_summary string")
    results, total = evaluation.score_heldout(labels, found)
    by = {r.label_id: r for r in results.collect()}
    assert (by["l1"].matched_title, by["l1"].class_ok, by["l2"].detected, by["l3"].detected) == ("t1", True, False, False)
    got = {r.app: r for r in total.collect()}
    assert (got["a"].n_labels, got["a"].n_detected, got["a"].recall, got["a"].class_ok_rate, got["a"].n_findings, got["a"].n_findings_unmatched) == (2, 1, 0.5, 1.0, 4, 2)
    assert got["a"].by_control_class["session"].fn == 1 and (got["b"].n_findings, got["b"].n_findings_unmatched) == (0, 0)


def test_unmatched_equals_all_pairs(spark):
    random.seed(9)
    labels = [(random.randint(0, 1), s := random.randint(0, 300), s + random.randint(0, 60)) for _ in range(12)]
    found = [(i, random.randint(0, 1), random.randint(0, 400)) for i in range(200)]
    a, b = spark.createDataFrame(found, "f int, k int, start_line int"), spark.createDataFrame(labels, "k int, label_line int, label_last int")
    got = {r.f for r in evaluation.unmatched(a, b, ["k"], 7).collect()}
    assert got == {f[0] for f in found if not any(k == f[1] and lo - 7 <= f[2] <= hi + 7 for k, lo, hi in labels)}


def test_required_literals():
    from evidentia.functions.rule_table import RULES
    from evidentia.functions.rules import required_literal

    assert [required_literal(p) for p in (r"[a-z]+@[a-z]+\.com", "a|b", "(?i)abc-d", r"x*yy(z)", r"\bexec\(")] == [".com", "", "-", "yy", "exec("]
    import re

    for rule in RULES:
        literal = required_literal(rule[3])
        for text in ("os.system(x)", "res.redirect(u)", "app.get('/x', isAdmin, h)", "db.query('a' + b)", literal):
            assert not re.search(rule[3], text) or literal in text


def test_reachable_far(spark):
    e = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(9)], "source string, target string")
    got = {(r.node, r.hops) for r in graph.reachable(e, spark.createDataFrame([("n0",)], "root string"), 20).collect()}
    assert got == {(f"n{k}", k) for k in range(10)}
