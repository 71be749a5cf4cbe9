import json

from pyspark.sql import functions as F

from evidentia.operators.mutation import split_call_args
from evidentia.sources import readers, schemas, writers
from evidentia.streaming import jobs

FOUND = [
    ("1", "c1", "b.js", 3, 5, "fn", "SQL Injection", "CWE-89", "high", "low", "Title one", "Text one", "why", "flow", "fix", "m"),
    ("2", "c2", "a.js", 0, 0, "fn", "Weak Thing", "", "critical", "high", "Title two", "Text two", "", "", "", "m"),
    ("3", "c3", "c.js", 9, 9, "fn", "SQL Injection", "CWE-89", "info", "low", "Title three", "Text three", "", "", "", "m"),
]
NAMES = "id string, context_id string, file string, start_line int, end_line int, function string, vulnerability_type string, cwe string, severity string, confidence string, title string, description string, context_reasoning string, data_flow_summary string, suggested_fix string, model string"


def test_reports(spark, tmp_path):
    found = spark.createDataFrame(FOUND, NAMES)
    text = writers.report_markdown(found, "repo", "m").first().report
    assert text.startswith("# Vulnerability Report: repo") and text.index("Title two") < text.index("Title one") < text.index("Title three") and "| 🟣 CRITICAL | 1 |" in text and "MEDIUM" not in text
    assert "No findings" in writers.report_markdown(found.limit(0), "repo", "m").first().report
    sarif = json.loads(writers.report_sarif(found).first().report)
    run = sarif["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["Weak-Thing", "CWE-89"] and [r["level"] for r in run["results"]] == ["error", "error", "note"]
    assert run["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "endLine": 1}
    assert len(json.loads(writers.report_json(found, "r", "c", "m").first().report)["findings"]) == 3
    writers.write_report(found, str(tmp_path), "r", "c", "m")
    assert spark.read.text(f"{tmp_path}/report.md").count() > 5


def test_reports_in_parts(spark, tmp_path):
    """The parts make the same documents as the single rows, in order, whatever the number of files; a failure leaves what was there."""
    rows = [(str(k), "c", f"f{k % 7}.js", k % 5, 9, "fn", f"Type {k % 3}", f"CWE-{k % 3}" if k % 2 else "", ["critical", "low", "info"][k % 3], "low", f"T{k}", f"x \"{k}\"\né", "", "", "", "m") for k in range(300)]
    found = spark.createDataFrame(rows, NAMES).repartition(5)
    run = writers.Run("r", "c", "m", ("javascript",), "now", 3, 9, 12, 4, 5, 6, 7.25, (("contexts", 1.0), ("none", 0.0)))

    def document(name):
        parts = sorted((tmp_path / name).glob("*.txt"))
        return "".join(p.read_text() for p in parts), len(parts)

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _ in range(2):  # once more over what is there
            writers.write_report(found, str(tmp_path), "r", "c", "m")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text, n = document("report.md")
    assert text.rstrip("\n") == writers.report_markdown(found, "r", "m").first().report.replace("- **Model:**", "- **Commit:** `c`\n- **Model:**").rstrip("\n") and n > 3
    assert json.loads(document("report.json")[0]) == json.loads(writers.report_json(found, "r", "c", "m").first().report)
    assert json.loads(document("report.sarif.json")[0]) == json.loads(writers.report_sarif(found).first().report)
    writers.write_report(found.limit(0), str(tmp_path / "none"), "r", "c", "m")
    assert "No findings" in document("none/report.md")[0] and json.loads(document("none/report.json")[0])["findings"] == [] and json.loads(document("none/report.sarif.json")[0])["runs"][0]["results"] == []
    head = writers.header(run)
    assert "- **Languages:** javascript\n" in head and "- **Contexts analyzed:** 3 (of 9 functions discovered, 12 sink pattern matches)\n- **LLM calls:** 4 (5 input / 6 output tokens)\n- **Duration:** 7.2s\n  - stages: contexts 1.0s\n" in head
    broken = found.withColumn("title", F.raise_error(F.lit("broken")).cast("string"))
    try:
        writers.write_report(broken, str(tmp_path), "r", "c", "m")
        raise AssertionError("no failure")
    except Exception as e:  # noqa: BLE001
        assert "broken" in str(e)
    assert document("report.json")[0].count("ruleId") == 0 and len(json.loads(document("report.json")[0])["findings"]) == 300
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none", "report.json", "report.md", "report.sarif.json"]


def test_graph_relations(spark, tmp_path):
    (tmp_path / "m.json").write_text("\n".join(json.dumps(x) for x in [{"id": 1, "name": "f", "fullName": "a:f", "filename": "a.py", "lineNumber": 2, "lineNumberEnd": -1}, {"id": 2, "name": "g", "fullName": "t:g", "filename": "tests/t.py", "lineNumber": 1}]))
    (tmp_path / "c.json").write_text(json.dumps({"id": 5, "name": "system", "code": "os.system(x)", "filename": "a.py", "lineNumber": 3, "calleeFullName": "os.system", "containingMethodFullName": "a:f"}))
    (tmp_path / "f.json").write_text(json.dumps({"sink_id": 5, "flows": [[{"code": "x", "line_number": -1, "filename": "a.py", "method": "f"}, {"code": "y", "line_number": 3, "filename": "a.py", "method": "f"}], []]}))
    (m,) = readers.methods(spark, str(tmp_path / "m.json")).collect()
    assert (m.full_name, m.start_line, m.end_line, m.parameters) == ("a:f", 2, 2, [])
    calls = readers.calls(spark, str(tmp_path / "c.json"))
    (f,) = readers.flows(spark, str(tmp_path / "f.json"), calls.withColumn("category", F.lit("Cmd"))).collect()
    assert len(f.paths) == 1 and f.paths[0].source == "x" and f.paths[0].sink == "Cmd: os.system(x)" and f.paths[0].steps[0].line_number is None


def test_decoded(spark):
    rows = [('{"a": 1}',), ('res0: String = """{"a": 2}"""',), ('val res1: String = "{\\"a\\": 3}"',), ("nothing",)]
    got = spark.createDataFrame(rows, "x string").coalesce(1).select(readers.decoded(F.col("x"), "a int")["a"].alias("a")).collect()
    assert [r.a for r in got] == [1, 2, 3, None]


def test_labels_trees_lists(spark, tmp_path):
    label = dict(zip([c.split()[0] for c in schemas.LABELS.split(", ")], ["i", "app", "r", "c", "M1", "session", "f.js", 1, 2, "/", "o", "m", "n"]))
    writers.write_json_lines(spark.createDataFrame([tuple(label.values())], schemas.LABELS), str(tmp_path / "l"))
    assert readers.labels(spark, str(tmp_path / "l")).first().asDict() == label
    for p in ("src/a.js", "node_modules/x/b.js", "src/c.test.js", "src/d.py"):
        (tmp_path / "t" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p).write_text("x")
    assert [r.file for r in readers.source_files(spark, str(tmp_path / "t")).collect()] == ["src/a.js"]
    (tmp_path / "list.txt").write_text("a/b # note\n\n# none\nhttps://x/y\n")
    assert [r.repo for r in readers.repo_list(spark, str(tmp_path / "list.txt")).collect()] == ["a/b", "https://x/y"]
    (tmp_path / "shop.yaml").write_text("commit_sha: abc\nlabels:\n  - {challenge: c, name: n, category: x, control_class: session, file: f.ts, line: 4}\n")
    h = readers.heldout_labels(spark, str(tmp_path / "shop.yaml")).first()
    assert (h.app, h.commit_sha, h.line, h.note) == ("shop", "abc", 4, "")


def evaluation(app, tp, fn, fp):
    s = {"app": app, "commit_sha": "", "n_mutations": tp + fn, "baseline_fp": 1, "tp": tp, "fp": fp, "fn": fn, "recall": 0.5, "recall_raw": 0.5, "precision": 0.1, "f1": 0.1, "by_operator": {"M1": {"tp": tp, "fn": fn, "recall": 0.5}}, "by_control_class": {}}
    return json.dumps({"generated_at": "", "model": "m", "mode": "absence", "grounding": "cpg", "match_window": 20, "summary": s}, indent=1)


def test_evaluation_files_and_results_page(spark, tmp_path):
    for name, text in {"a.json": evaluation("a", 2, 2, 3), "b.json": evaluation("b", 1, 5, 1), "a-raw.json": evaluation("a", 3, 1, 0), "_aggregate.json": evaluation("x", 9, 9, 9), "heldout-h.json": json.dumps({"app": "h", "grounding": "cpg", "n_labels": 8, "n_detected": 2, "recall": 0.25})}.items():
        (tmp_path / name).write_text(text)
    rows = readers.evaluations(spark, str(tmp_path))
    assert {(r.variant, r.app) for r in rows.select("variant", "summary.app").collect()} == {("", "a"), ("", "b"), ("-raw", "a")}
    assert readers.heldout_reports(spark, str(tmp_path)).first().n_detected == 2
    page = writers.results_markdown(rows).first().page
    assert "| grounded | 2 | 10 | 0.43 | 0.30 |" in page and "| M1 | 0.30 (3/10) | 0.75 (3/4) | - |" in page and page.index("| b | 6") < page.index("| a | 4")


def test_rule_detector_and_screening(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"results": [{"path": "/r/a.js", "start": {"line": 3}, "extra": {}}]}))
    d = readers.detections(spark, str(tmp_path / "d.json"), "/r").first()
    assert (d.file, d.start_line, d.end_line, d.cwe, d.severity) == ("a.js", 3, 3, "CWE-862", "medium")
    reg = spark.createDataFrame([("app.get('/x', f)",), ("app.get('/x', auth, f)",), ("db.get('/x', f)",), ("router.post(path, f)",)], "code string")
    assert [r.code for r in readers.unprotected_routes(reg, split_call_args(F.col("code"))).collect()] == ["app.get('/x', f)"]
    c = spark.createDataFrame([("1", json.dumps({"license": "MIT", "dependencies": {"express": "1", "passport": "1"}}), None), ("2", json.dumps({"license": "GPL-3.0", "dependencies": {"express": "1", "passport": "1"}}), None), ("3", json.dumps({"dependencies": {"express": "1"}}), None), ("4", json.dumps({"dependencies": {"express": "1"}, "devDependencies": {"jsonwebtoken": "1"}}), "The MIT License"), ("5", "{", None)], "id string, package_json string, license_text string")
    assert {r.id: r.license_key for r in readers.screened(c).collect()} == {"1": "mit", "4": "mit"}


def test_log_stream_and_resume(spark, tmp_path):
    log, got = tmp_path / "log", []
    log.mkdir()
    (log / "1.json").write_text('{"job": "j", "line_no": 0, "line": "a", "status": "running"}\n')
    run = lambda: jobs.follow(jobs.tail(spark, str(log)), str(tmp_path / "cp"), lambda df, _: got.extend(r.line for r in df.collect())).awaitTermination()
    run()
    (log / "2.json").write_text('{"job": "j", "line_no": 1, "line": "b", "status": "done"}\n')
    run()
    assert got == ["a", "b"]
    assert tuple(jobs.status(spark.read.schema(jobs.LOG).json(str(log))).first()) == ("j", 2, "done")
    work = spark.createDataFrame([("a",), ("b",)], "app string")
    assert [r.app for r in jobs.unfinished(work, work.filter("app = 'a'"), "app").collect()] == ["b"]
