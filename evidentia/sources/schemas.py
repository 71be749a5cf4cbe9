"""Schemas of the relations that come from outside: code graph, labels, judge answers, reports."""

METHODS = "id bigint, name string, full_name string, filename string, start_line int, end_line int, parameters array<string>, return_type string"
CALLS = "id bigint, name string, code string, filename string, line_number int, callee string, containing string"
FLOWS = "sink_id bigint, paths array<struct<source: string, sink: string, steps: array<struct<file: string, line_number: int, method: string, code: string>>>>"
GRAPH_METHODS = "id bigint, name string, fullName string, filename string, lineNumber int, lineNumberEnd int, parameters array<string>, returnType string"
GRAPH_CALLS = "id bigint, name string, code string, filename string, lineNumber int, calleeFullName string, containingMethodFullName string"
GRAPH_FLOWS = "sink_id bigint, flows array<array<struct<code: string, line_number: int, filename: string, method: string>>>"
LABELS = (
    "id string, app string, repo string, commit_sha string, operator string, control_class string, file string, start_line int, end_line int, "
    "route_path string, original_text string, mutated_text string, note string"
)
MANIFEST = (
    "full_name string, clone_url string, default_branch string, stars int, pushed_at string, license_key string, auth_libs array<string>, "
    "local_path string, commit_sha string"
)
BUCKETS = "map<string, struct<tp: int, fn: int, recall: double>>"
SUMMARY = (
    f"struct<app: string, commit_sha: string, n_mutations: int, baseline_fp: int, tp: int, fp: int, fn: int, recall: double, recall_raw: double, precision: double, f1: double, "
    f"by_operator: {BUCKETS}, by_control_class: {BUCKETS}, compression: struct<slice_over_file_mean: double>, grounded_findings: struct<ratio: double>>"
)
EVALUATION = f"generated_at string, model string, mode string, grounding string, match_window int, summary {SUMMARY}"
HELDOUT = (
    f"app string, grounding string, n_labels int, n_detected int, recall double, class_ok_rate double, n_findings int, n_findings_unmatched int, by_control_class {BUCKETS}"
)
DETECTIONS = (
    "results array<struct<path: string, start: struct<line: int>, end: struct<line: int>, extra: struct<message: string, metadata: struct<cwe: string>>>>"
)
