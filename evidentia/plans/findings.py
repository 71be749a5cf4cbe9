"""Queries on the call graph, on findings with intervals, and on ground truth."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import class_key, clean_type, rate
from ..operators import evaluation, graph, judge, metrics, shortlist, taint
from ..session import saved, shared_dir
from ..sources import writers
from . import common as c
from .common import any_sql, first_sql, quote, rate_sql

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("callers_1hop", f"WITH {c.GRAPH} SELECT DISTINCT callee AS full_name, containing AS caller FROM C WHERE containing IN (SELECT full_name FROM M)")
def callers_1hop(spark, d):
    """J1."""
    return graph.callers_of(*c.graph(spark, d)).select("full_name", "caller")


@query("callees_1hop", f"WITH {c.GRAPH} SELECT DISTINCT containing AS full_name, callee FROM C WHERE callee IN (SELECT full_name FROM M)")
def callees_1hop(spark, d):
    """External callees vanish."""
    return graph.callees_of(*c.graph(spark, d)).select("full_name", "callee")


@query("caller_cap", f"""
WITH {c.GRAPH}, E AS (SELECT DISTINCT callee AS full_name, containing AS caller FROM C WHERE containing IN (SELECT full_name FROM M)),
R AS (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY caller) AS k FROM E) SELECT full_name, caller FROM R WHERE k <= 5""")
def caller_cap(spark, d):
    """The first callers by name."""
    return graph.at_most(graph.callers_of(*c.graph(spark, d)), "full_name", "caller", 5).select("full_name", "caller")


@query("handler_resolve", """
WITH M AS (SELECT 'p' || p_partkey AS full_name, replace(p_brand, '#', '') AS name, lower(p_type) || '/' || p_name || '.js' AS filename FROM part),
R AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY name = '<module>', NOT contains(filename, 'handler') AND NOT contains(filename, 'route'), filename, full_name) AS k FROM M)
SELECT s_suppkey, R.full_name AS handler FROM supplier LEFT JOIN R ON 'Brand' || s_nationkey = R.name AND k = 1""")
def handler_resolve(spark, d):
    """The method that the last identifier of an expression names."""
    m = c.table(spark, d, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("full_name"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("name"),
        F.concat(F.lower("p_type"), F.lit("/"), "p_name", F.lit(".js")).alias("filename"),
    )
    e = c.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit(" ctrl.Brand"), F.col("s_nationkey").cast("string")).alias("handler_expr"))
    return graph.resolved_handlers(e, m).select("s_suppkey", F.col("handler.full_name").alias("handler"))


@query("latest_def_lookup", """
SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id, event_type""")
def latest_def_lookup(spark, d):
    """Of several rows of a key the last loaded."""
    e = c.table(spark, d, "events").select(F.concat_ws("/", "user_id", "event_type").alias("full_name"), "user_id", "event_type", "value", "event_id")
    return graph.latest_definitions(e, "event_id").select("user_id", "event_type", "value", "event_id")


@query("reachability", f"""
WITH {c.GRAPH}, E AS (SELECT DISTINCT containing AS s, callee AS t FROM C WHERE callee IN (SELECT full_name FROM M)),
H0 AS (SELECT full_name AS root, full_name AS node, 0 AS hops FROM M),
H1 AS (SELECT root, t AS node, 1 AS hops FROM H0 JOIN E ON node = s), H2 AS (SELECT DISTINCT root, t AS node, 2 AS hops FROM H1 JOIN E ON node = s)
SELECT root, node, min(hops)::INTEGER AS hops FROM (SELECT * FROM H0 UNION ALL SELECT * FROM H1 UNION ALL SELECT * FROM H2) GROUP BY root, node""")
def reachability(spark, d):
    """S3: nodes within two hops."""
    calls, methods = c.graph(spark, d)
    edges = graph.callees_of(calls, methods).select(F.col("full_name").alias("source"), F.col("callee").alias("target"))
    return graph.reachable(edges, methods.select(F.col("full_name").alias("root")), 2).select("root", "node", "hops")


_FLOWS = """E AS (SELECT DISTINCT 'c' || o_custkey AS source, 'p' || l_partkey AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT 'c' || o_custkey, 's' || l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'A'
UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


@query("taint_paths", f"""
WITH RECURSIVE {_FLOWS}, W AS (SELECT 'c' || c_custkey AS source, ['c' || c_custkey] AS steps FROM customer
UNION ALL SELECT W.source, list_append(steps, E.target) FROM W JOIN E ON steps[-1] = E.source WHERE len(steps) <= 4 AND NOT list_contains(steps, E.target)),
R AS (SELECT 'n' || n_nationkey AS sink, source, steps, row_number() OVER (PARTITION BY n_nationkey, source ORDER BY len(steps), steps) AS k FROM W JOIN nation ON steps[-1] = 'n' || n_nationkey)
SELECT sink, source, k::INTEGER AS rank, (len(steps) - 1)::INTEGER AS length, array_to_string(steps, ' > ') AS steps FROM R WHERE k <= 3""")
def taint_paths(spark, d):
    """S3: the first paths from each customer to each nation: by the parts that the customer ordered and the suppliers that ever got them back, or straight by a supplier."""
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    items = c.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    bought = items.join(c.table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    customer, part, supplier = node("c", "o_custkey"), node("p", "l_partkey"), node("s", "l_suppkey")
    edge = lambda source, target: F.struct(source.alias("source"), target.alias("target"))
    flag = F.col("l_returnflag")
    edges = bought.select(F.explode(F.array(edge(customer, part), F.when(flag == "R", edge(part, supplier)), F.when(flag == "A", edge(customer, supplier)))).alias("e")).select("e.*")
    edges = edges.union(c.table(spark, d, "supplier").select(node("s", "s_suppkey"), node("n", "s_nationkey")))
    sources, sinks = c.table(spark, d, "customer").select(node("c", "c_custkey").alias("node")), c.table(spark, d, "nation").select(node("n", "n_nationkey").alias("node"))
    found = taint.flow_paths(edges, sources, sinks, most=3, hops=4)
    return found.select("sink", "source", "rank", "length", F.array_join("steps", " > ").alias("steps"))


@query("route_dedupe", f"""WITH {c.PATHS}, R AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page_id) AS k FROM P) SELECT path, page_id FROM R WHERE k = 1""")
def route_dedupe(spark, d):
    """A4: the first page of each path."""
    return shortlist.first_by(c.page_paths(spark, d), ["path"], [F.col("page_id")]).select("path", "page_id")


@query("type_clean", r"""
WITH K AS (SELECT p_partkey, p_name, p_type, p_size, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN p_name WHEN 3 THEN p_type ELSE array_to_string([upper(x[1]) || x[2:] for x in string_split(p_name, ' ')], ' ') END AS cleaned,
  CASE k WHEN 0 THEN 'CWE-' || p_size WHEN 1 THEN lower(replace(p_name, ' ', '_')) WHEN 2 THEN 'CWE-' || p_size ELSE lower(p_type) END AS class_key FROM K""")
def type_clean(spark, d):
    """Types with a CWE, in snake and kebab case, and as they are."""
    name, cwe = F.col("p_name"), F.concat(F.lit("cwe-"), F.col("p_size").cast("string"), F.lit(")"))
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, F.concat(name, F.lit(" ("), cwe)).when(k == 1, F.replace(name, F.lit(" "), F.lit("_"))).when(k == 2, F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit(" ("), cwe, F.lit(" "))).otherwise(F.col("p_type"))
    rows = c.table(spark, d, "part").select("p_partkey", kind.alias("kind"))
    return rows.select("p_partkey", clean_type(F.col("kind")).alias("cleaned"), class_key(F.col("kind"), F.col("kind")).alias("class_key"))


@query("json_parse_findings", """
WITH J AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, coalesce(nullif(k % 7, 0), 99)::INTEGER AS start_line, k::INTEGER AS k FROM J WHERE k IS NOT NULL""")
def json_parse_findings(spark, d):
    """a field of JSON, with a default for 0."""
    e = c.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).filter("k is not null")
    return e.select("event_id", F.coalesce(F.nullif(F.col("k") % 7, F.lit(0)), F.lit(99)).alias("start_line"), "k")


@query("judge_findings", """
WITH J AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS s FROM events)
SELECT 'c' || event_id || '#0' AS id, 'u' || user_id AS file, upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Flaw' AS vulnerability_type,
  CASE WHEN value >= 20 THEN 'high' ELSE 'low' END AS severity, (s % 100000)::INTEGER AS start_line FROM J WHERE event_type <> 'view'""")
def judge_findings(spark, d):
    """Fenced answers parsed, contradictions and invalid contexts dropped."""
    second = (c.seconds(F.col("ts")) % 100000).cast("int")
    e = c.table(spark, d, "events").select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("context_id"), "user_id", "event_type", "value", second.alias("s"))
    why = F.when(F.col("event_type") == "view", "There are no data flow paths here").otherwise("the input reaches the call")
    item = F.struct(F.concat("event_type", F.lit("_flaw")).alias("vulnerability_type"), F.when(F.col("value") >= 20, "high").otherwise("low").alias("severity"), F.lit("medium").alias("confidence"), why.alias("data_flow_summary"), F.lit(0).alias("start_line"))
    text = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(item).alias("findings"))), F.lit("\n```"))
    answers = e.select("context_id", text.alias("response_text"), F.lit(False).alias("refused"))
    contexts = e.select("context_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.lit("f").alias("full_name"), F.col("s").alias("start_line"), F.col("s").alias("end_line"), F.lit("").alias("route_path"), F.array().cast("array<string>").alias("guard_controls"))
    return judge.findings(judge.kept(judge.parsed(answers), contexts, "injection")).select("id", "file", "vulnerability_type", "severity", "start_line")


_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(fixed.SEVERITIES)) + " END"


@query("greedy_dedupe", f"""
WITH RECURSIVE {c.EVENTS}, O AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {_RANK}, start_line, end_line, event_id) AS k FROM F),
G AS (SELECT user_id, event_type, list({{'s': start_line, 'e': end_line, 'id': event_id}} ORDER BY k) AS items FROM O GROUP BY user_id, event_type),
A AS (SELECT user_id, event_type, list_reduce([[x] for x in items], lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s <= x[1].e AND x[1].s <= y.e)) > 0 THEN acc ELSE acc || x END) AS kept FROM G)
SELECT user_id, event_type, unnest(kept).id AS event_id FROM A""")
def greedy_dedupe(spark, d):
    """Of overlapping findings of one file and class the best stays; overlap isn't passed on."""
    f = c.event_intervals(spark, d)
    order = [judge.rank(F.col("severity"), fixed.SEVERITIES), F.col("start_line"), F.col("end_line"), F.col("event_id")]
    return judge.greedy_intervals(f, ["user_id", "event_type"], order, "start_line", "end_line", "event_id").select("user_id", "event_type", "event_id")


_LABELS = "B AS (SELECT event_id AS label_id, user_id, start_line AS label_start, start_line + 60 AS label_end FROM F WHERE event_type = 'error')"


def _labels(f):
    return f.filter("event_type = 'error'").select(F.col("event_id").alias("label_id"), "user_id", F.col("start_line").alias("label_start"), (F.col("start_line") + 60).alias("label_end"))


@query("interval_match", f"""
WITH {c.EVENTS}, {_LABELS} SELECT label_id, F.event_id FROM B JOIN F ON B.user_id = F.user_id AND F.event_type = 'click'
AND (F.start_line BETWEEN label_start - 1800 AND label_end + 1800 OR F.end_line BETWEEN label_start - 1800 AND label_end + 1800)""")
def interval_match(spark, d):
    """Clicks whose start or end lies in the window of an error of the same user."""
    f = c.event_intervals(spark, d)
    return evaluation.interval_matches(_labels(f), f.filter("event_type = 'click'"), ["user_id"], 1800).select("label_id", "event_id")


@query("novelty_mark", """
SELECT event_id, NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND b.user_id = e.user_id AND floor(b.value) = floor(e.value)) AS novel FROM events e WHERE event_type = 'click'""")
def novelty_mark(spark, d):
    """A mark for what the baseline doesn't have."""
    e = c.table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor("value").alias("v"))
    return evaluation.with_novelty(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id", "v"]).select("event_id", "novel")


_MATCHES = f"""{c.EVENTS}, {_LABELS}, X AS (SELECT label_id, F.event_id, value >= 20 AS class_ok, F.user_id, floor(value) AS v FROM B JOIN F ON B.user_id = F.user_id AND F.event_type = 'click'
AND (F.start_line BETWEEN label_start - 7200 AND label_end + 7200 OR F.end_line BETWEEN label_start - 7200 AND label_end + 7200)),
N AS (SELECT X.*, NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND b.user_id = X.user_id AND floor(b.value) = X.v) AS novel FROM X)"""


def _matches(spark, d):
    f = c.event_intervals(spark, d)
    m = evaluation.interval_matches(_labels(f), f.filter("event_type = 'click'").withColumn("v", F.floor("value")), ["user_id"], 7200)
    seen = f.filter("event_type = 'view'").select("user_id", F.floor("value").alias("v"))
    return evaluation.with_novelty(m, seen, ["user_id", "v"]).withColumn("class_ok", F.col("value") >= 20)


@query("score_pick", f"""
WITH {_MATCHES}, R AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY novel DESC, CASE WHEN novel AND class_ok THEN 0 ELSE 1 END, CASE WHEN novel AND NOT class_ok THEN -event_id ELSE event_id END) AS k,
max(novel) OVER (PARTITION BY label_id) AS detected FROM N)
SELECT label_id, event_id, detected, class_ok FROM R WHERE k = 1""")
def score_pick(spark, d):
    """One match stands for each label."""
    return evaluation.scored(_matches(spark, d), "label_id", "event_id").select("label_id", "event_id", "detected", "class_ok")


@query("heldout_pick", f"WITH {_MATCHES}, R AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY class_ok DESC, event_id) AS k FROM N) SELECT label_id, event_id, class_ok FROM R WHERE k = 1")
def heldout_pick(spark, d):
    """The first match of the right class, else the first."""
    return evaluation.heldout_pick(_matches(spark, d), "label_id", "event_id").select("label_id", "event_id", "class_ok")


@query("heldout_summary", f"""
WITH {_MATCHES}, R AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY class_ok DESC, event_id) AS k FROM N), Q AS (SELECT label_id, class_ok FROM R WHERE k = 1),
S AS (SELECT B.label_id, Q.label_id IS NOT NULL AS detected, coalesce(class_ok, false) AS class_ok FROM B LEFT JOIN Q ON B.label_id = Q.label_id)
SELECT count(*) AS n_labels, sum(detected::INT)::BIGINT AS n_detected, {rate_sql("sum(detected::INT)", "count(*)")} AS recall, {rate_sql("sum((detected AND class_ok)::INT)", "sum(detected::INT)")} AS class_ok_rate FROM S""")
def heldout_summary(spark, d):
    """A11."""
    picked = evaluation.heldout_pick(_matches(spark, d), "label_id", "event_id").select("label_id", "class_ok", F.lit(True).alias("detected"))
    rows = _labels(c.event_intervals(spark, d)).join(picked, "label_id", "left")
    return evaluation.heldout_summary(rows.withColumns({x: F.coalesce(x, F.lit(False)) for x in ("detected", "class_ok")}))


@query("unmatched_anti", f"""
WITH {c.EVENTS}, {_LABELS} SELECT event_id FROM F WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM B WHERE B.user_id = F.user_id AND F.start_line BETWEEN label_start - 1800 AND label_start + 1800)""")
def unmatched_anti(spark, d):
    """Findings near no label."""
    f = c.event_intervals(spark, d)
    labels = _labels(f).select("user_id", F.col("label_start").alias("label_line"))
    return evaluation.unmatched(f.filter("event_type = 'click'"), labels, ["user_id"], 1800).select("event_id")


_HITS = f"""{c.LINES}, H AS (SELECT DISTINCT doc_id FROM L WHERE {any_sql(c.LINE_RULES, "code")}),
J AS (SELECT source, lang, quality = 0 AS bad, H.doc_id IS NOT NULL AS hit FROM labels JOIN documents USING (doc_id) LEFT JOIN H USING (doc_id))"""


def _hits(spark, d):
    hits = shortlist.shortlist(c.line_view(spark, d), c.LINE_RULES, "code").select("doc_id").distinct().withColumn("hit", F.lit(True))
    docs = c.table(spark, d, "documents").select("doc_id", "source", "lang")
    rows = c.table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("bad")).join(docs, "doc_id").join(hits, "doc_id", "left")
    return rows.withColumn("hit", F.coalesce("hit", F.lit(False)))


def _counts(rows):
    count = lambda cond: F.sum(cond.cast("int")).alias
    bad, hit = F.col("bad"), F.col("hit")
    return rows.agg(count(bad & hit)("tp"), count(~bad & hit)("fp"), count(bad & ~hit)("fn"))


_TP, _FP, _FN = "sum((bad AND hit)::INT)::BIGINT", "sum((NOT bad AND hit)::INT)::BIGINT", "sum((bad AND NOT hit)::INT)::BIGINT"
_PRF = f"""tp, fp, fn, {rate_sql("tp", "tp + fp")} AS precision, {rate_sql("tp", "tp + fn")} AS recall,
round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 3) AS f1"""


_POOLED = f"""tp, fp, fn, {rate_sql("tp", "tp + fp")} AS precision, {rate_sql("tp", "tp + fn")} AS recall,
round(coalesce(2 * {rate_sql("tp", "tp + fp")} * {rate_sql("tp", "tp + fn")} / nullif({rate_sql("tp", "tp + fp")} + {rate_sql("tp", "tp + fn")}, 0), 0), 3) AS f1"""


@query("prf_overall", f"WITH {_HITS}, T AS (SELECT {_TP} AS tp, {_FP} AS fp, {_FN} AS fn FROM J) SELECT {_PRF} FROM T")
def prf_overall(spark, d):
    """The line rules as a detector of bad documents."""
    t = _counts(_hits(spark, d).groupBy())
    return t.withColumns(evaluation.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))


@query("recall_by_bucket", f"""
WITH {_HITS}, R AS (SELECT CASE WHEN grouping(source) = 0 THEN 'source' ELSE 'lang' END AS bucket, coalesce(source, lang) AS value, sum(hit::INT)::BIGINT AS tp, count(*) AS n
FROM J WHERE bad GROUP BY GROUPING SETS ((source), (lang)))
SELECT bucket, value, tp, n - tp AS fn, {rate_sql("tp", "n")} AS recall FROM R""")
def recall_by_bucket(spark, d):
    """By source and by language in one pass."""
    rows = _hits(spark, d).filter("bad").withColumn("detected", F.col("hit"))
    return evaluation.recall_by(rows, "source", "lang")


@query("pooled_micro_avg", f"""
WITH {_HITS}, A AS (SELECT source, {_TP} AS tp, {_FP} AS fp, {_FN} AS fn FROM J GROUP BY source),
B AS (SELECT *, tp + fn AS n_mutations, 0 AS baseline_fp, {rate_sql("tp", "tp + fn")} AS recall_raw, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS ratio FROM A),
T AS (SELECT count(*) AS apps, sum(n_mutations)::BIGINT AS n_mutations, sum(baseline_fp)::BIGINT AS baseline_fp, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(round(recall_raw * n_mutations)) AS raw, round(avg(ratio), 2) AS ratio FROM B)
SELECT apps, n_mutations, baseline_fp, ratio, {rate_sql("raw", "n_mutations")} AS recall_raw, {_POOLED} FROM T""")
def pooled_micro_avg(spark, d):
    """A10: rates over summed counts, and a mean of ratios that leaves out missing ones."""
    per = _counts(_hits(spark, d).groupBy("source"))
    per = per.withColumns({"n_mutations": F.col("tp") + F.col("fn"), "baseline_fp": F.lit(0), "recall_raw": rate(F.col("tp"), F.col("tp") + F.col("fn")), "ratio": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))})
    return evaluation.pooled(per, "ratio")


@query("benchmark_pivot", f"""
WITH {c.LINES}, H AS (SELECT doc_id, {first_sql(c.LINE_RULES, "code", "severity")} AS s FROM L), Y AS (SELECT DISTINCT doc_id, s FROM H WHERE s IS NOT NULL),
B AS (SELECT doc_id, lang FROM labels JOIN documents USING (doc_id) WHERE quality = 0)
SELECT lang, {", ".join(f"round(sum((EXISTS (SELECT 1 FROM Y WHERE Y.doc_id = B.doc_id AND s = '{s}'))::INT) / count(*), 3) AS {s}" for s in ("high", "medium", "low"))} FROM B GROUP BY lang""")
def benchmark_pivot(spark, d):
    """Recall of each detector (here each severity's rules) by language, wide."""
    hits = shortlist.shortlist(c.line_view(spark, d), c.LINE_RULES, "code").select("doc_id", F.col("severity").alias("detector")).distinct()
    names = ["high", "medium", "low"]
    bad = c.table(spark, d, "labels").filter("quality = 0").select("doc_id").join(c.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    each = bad.withColumn("detector", F.explode(F.array(*map(F.lit, names)))).join(hits.withColumn("hit", F.lit(1)), ["doc_id", "detector"], "left")
    rows = each.groupBy("lang", "detector").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("tp"), F.count("*").alias("n")).withColumn("fn", F.col("n") - F.col("tp"))
    return evaluation.benchmark(rows, "lang", "detector", names)


@query("grounded_ratio", f"""
WITH {c.EVENTS}, X AS (SELECT user_id AS context_id, min(start_line) + 400000 AS lo, min(start_line) + 1200000 AS hi FROM F GROUP BY user_id),
R AS (SELECT (F.start_line <= hi + 3 AND F.end_line >= greatest(1, lo - 3))::INT AS g FROM F JOIN X ON F.user_id = X.context_id WHERE event_type = 'error')
SELECT count(*) AS findings_checked, sum(g)::BIGINT AS grounded, round(sum(g) / count(*), 3) AS ratio FROM R""")
def grounded_ratio(spark, d):
    """Findings that cite what was shown."""
    f = c.event_intervals(spark, d)
    contexts = f.groupBy(F.col("user_id").alias("context_id")).agg((F.min("start_line") + 400000).alias("start_line"), (F.min("start_line") + 1200000).alias("end_line"))
    contexts = contexts.withColumns({"grounding": F.lit("cpg"), "code": F.lit("")})
    return metrics.grounded(f.filter("event_type = 'error'").withColumnRenamed("user_id", "context_id"), contexts)


@query("corpus_summary", """
SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'quality' END AS bucket, coalesce(source, lang, quality::VARCHAR) AS value, count(*) AS n
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source), (lang), (quality))""")
def corpus_summary(spark, d):
    """Counts by three keys in one pass."""
    rows = c.table(spark, d, "documents").select("doc_id", "source", "lang").join(c.table(spark, d, "labels").select("doc_id", "quality"), "doc_id").withColumn("detected", F.lit(True))
    return evaluation.recall_by(rows, "source", "lang", "quality").select("bucket", "value", F.col("tp").cast("bigint").alias("n"))


def _document_findings(spark, d):
    """Hits of the line rules as findings. Written where a query reads them more than once, as a report does: for its counts, for the bounds of its parts and for the parts."""
    hits = shortlist.shortlist(c.line_view(spark, d), c.LINE_RULES, "code")
    return hits.select(
        F.concat_ws(":", "doc_id", "line").alias("id"), "cwe", F.col("category").alias("vulnerability_type"), "severity", F.lit("medium").alias("confidence"), F.col("source").alias("file"),
        F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit("").alias("function"), F.concat("category", F.lit(" in document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("code").alias("description"), F.lit("").alias("context_reasoning"), F.lit("").alias("data_flow_summary"), F.lit("").alias("suggested_fix"),
    )


@query("sarif_rules", f"""
WITH {c.LINES}, H AS (SELECT doc_id || ':' || line AS id, source, line, code, {first_sql(c.LINE_RULES, "code", "cwe")} AS rule_id, {first_sql(c.LINE_RULES, "code", "category")} AS name, {first_sql(c.LINE_RULES, "code", "severity")} AS severity FROM L),
R AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY {_RANK}, source, line, id) AS k FROM H WHERE rule_id IS NOT NULL)
SELECT rule_id, name, substr(code, 1, 500) AS description, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level FROM R WHERE k = 1""")
def sarif_rules(spark, d):
    """K5: the first finding of each rule describes it."""
    found = saved(_document_findings(spark, d), "findings")
    levels = writers.sarif_results(found).select("rule_id", "level").distinct()
    return writers.sarif_rules(found).join(levels, "rule_id").select("rule_id", "name", "description", "level")


@query("severity_counts", f"WITH {c.LINES}, H AS (SELECT {first_sql(c.LINE_RULES, 'code', 'severity')} AS severity FROM L) SELECT severity, count(*) AS n FROM H WHERE severity IS NOT NULL GROUP BY severity")
def severity_counts(spark, d):
    """A13."""
    return writers.severity_counts(_document_findings(spark, d))


_HITS_SQL = f"""{c.LINES}, H AS (SELECT doc_id, source, line, code, {first_sql(c.LINE_RULES, "code", "category")} AS category, {first_sql(c.LINE_RULES, "code", "cwe")} AS cwe, {first_sql(c.LINE_RULES, "code", "severity")} AS severity FROM L),
X AS (SELECT *, category || ' in document ' || doc_id AS title FROM H WHERE category IS NOT NULL)"""
_MARK = "CASE severity " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in fixed.SEVERITY_MARKS.items()) + " END"


@query("report_markdown", f"""
WITH {_HITS_SQL}, T AS (SELECT concat_ws(chr(10), '### ' || {_MARK} || ' [' || upper(severity) || '] ' || title, '', '- **File:** `' || source || ':' || line || '-' || line || '`', '- **Function:** ``', '- **Type:** ' || category || ' (' || cwe || ')', '- **Confidence:** medium', '', code || chr(10), '---' || chr(10)) AS text FROM X
UNION ALL SELECT {quote(writers.header(writers.Run("documents", model="rules")))} UNION ALL SELECT '## Summary' || chr(10) || chr(10) || '| Severity | Count |' || chr(10) || '|---|---|' UNION ALL SELECT '| ' || {_MARK} || ' ' || upper(severity) || ' | ' || count(*) || ' |' FROM X GROUP BY severity
UNION ALL SELECT chr(10) || '## Findings' || chr(10))
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM T) GROUP BY line""")
def report_markdown(spark, d):
    """K4, K6: the report as a document in parts, read back: its lines and how often each occurs."""
    folder = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    writers.write_sections(spark, folder, writers.markdown_sections(saved(_document_findings(spark, d), "findings"), writers.Run("documents", model="rules")))
    return writers.read_lines(spark, folder).groupBy("line").agg(F.count("*").alias("n"))


@query("report_sarif", f"""
WITH {_HITS_SQL} SELECT cwe AS rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, title || ': ' || code AS message, source AS uri, line::INTEGER AS start_line FROM X""")
def report_sarif(spark, d):
    """K5, K6: the results of a SARIF document in parts, read back; each is a line."""
    folder = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    writers.write_sections(spark, folder, writers.sarif_sections(saved(_document_findings(spark, d), "findings")))
    place = "array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>"
    result = F.from_json(F.regexp_replace("line", "^,", ""), f"ruleId string, level string, message struct<text: string>, locations {place}")
    rows = writers.read_lines(spark, folder).select(result.alias("r")).filter("r.ruleId is not null")
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    return rows.select(F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"), at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("start_line"))


#: A file with a mutation of each kind, below the comment that holds a document; and what comes of it: kind, control, first and last line, path, note.
GUARDED = """app.get('/SOURCE', requireAuth, isAdmin, (req, res) => { res.send(1); });
if (req.user.id !== doc.ownerId) {
  return res.status(403).end();
}
if (!req.user.isAdmin) throw new Error('x');
if (!req.session.user) return res.redirect('/login');
const errors = validationResult(req);
if (!errors.isEmpty()) {
  return res.status(400).end();
}
User.save();
"""
MADE = (
    ("M1", "authentication", 1, 1, "dropped route middleware: requireAuth"), ("M1", "authorization", 1, 1, "dropped route middleware: isAdmin"),
    ("M2", "ownership", 2, 4, "removed ownership check: if (req.user.id !== doc.ownerId)"), ("M3", "authorization", 5, 5, "removed authorization check: if (!req.user.isAdmin)"),
    ("M4", "session", 6, 6, "removed session check: if (!req.session.user)"), ("M5", "validation", 8, 10, "removed validation-error guard before a write"),
    ("M5", "validation", 7, 7, "removed validator call before a write"),
)
_MADE = ", ".join(f"({', '.join(quote(x) if isinstance(x, str) else str(x) for x in m)})" for m in MADE)


@query("mutation_generate", f"""
WITH D AS (SELECT doc_id, source, len(string_split(text, chr(10))) + 2 AS above, string_split(replace({quote(GUARDED)}, 'SOURCE', source), chr(10)) AS code FROM documents),
V(operator, control_class, a, b, note) AS (VALUES {_MADE})
SELECT source AS app, 'd' || doc_id || '.js' AS file, operator, control_class, (above + a)::INTEGER AS start_line, (above + b)::INTEGER AS end_line, CASE operator WHEN 'M1' THEN '/' || source ELSE '' END AS route_path,
  array_to_string(code[a:b], chr(10)) AS original_text,
  CASE note WHEN 'dropped route middleware: requireAuth' THEN replace(code[1], 'requireAuth, ', '') WHEN 'dropped route middleware: isAdmin' THEN replace(code[1], 'isAdmin, ', '') ELSE repeat(chr(10), b - a) END AS mutated_text, note FROM D, V""")
def mutation_generate(spark, d):
    """Mutations of a file for each document, which holds it as a comment above the guards."""
    from ..operators.mutation import mutated

    code = F.concat(F.lit("/*\n"), "text", F.lit("\n*/\n"), F.replace(F.lit(GUARDED), F.lit("SOURCE"), F.col("source")))
    files = c.table(spark, d, "documents").select(F.col("source").alias("app"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".js")).alias("file"), code.alias("text"))
    return mutated(files).drop("id")


@query("call_arguments", """SELECT p_partkey, unnest([p_name, ' g(1, 2)', ' ' || chr(39) || p_brand || ', x' || chr(39), ' [a, b]']) AS argument FROM part""")
def call_arguments(spark, d):
    """P10: top-level arguments of calls."""
    from ..operators.mutation import split_call_args

    code = F.concat(F.lit("f("), "p_name", F.lit(", g(1, 2), '"), "p_brand", F.lit(", x', [a, b])"))
    return c.table(spark, d, "part").select("p_partkey", F.explode(split_call_args(code)).alias("argument"))
