"""Queries that write the tables as files of the forms that come from outside, in the shared folder, and read them back through the sources; and column forms of predicates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, predicates, text
from ..operators import corpus
from ..operators.mutation import split_call_args
from ..session import hadoop, shared_dir
from ..sources import readers, writers
from ..streaming import jobs
from . import common as c
from .common import quote

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, files = hadoop(spark, path)
    files.deleteOnExit(where)
    return path


def _json(df: DataFrame, name: str, **options) -> str:
    path = _folder(df.sparkSession, name)
    df.write.options(**options).json(path)
    return path


def _of(words: tuple[str, ...], key: str, by: int = 1):
    return F.get(F.array(*map(F.lit, words)), ((F.col(key) * by) % len(words)).cast("int"))


def _of_sql(words: tuple[str, ...], key: str, by: int = 1) -> str:
    return f"([{', '.join(map(quote, words))}])[({key} * {by}) % {len(words)} + 1]"


FILES = ("src/app.js", "node_modules/x/a.js", "lib\\b.js", "tests/t.js", "a.spec.js", "routes/users.js", "", "<empty>", "dist/m.js", "web/site.min.js", "latest/contest.js")
APP = ("src/app.js", "lib\\b.js", "routes/users.js", "latest/contest.js")
_APP = f"filename IN ({', '.join(map(quote, APP))})"


@query("method_scan", f"""
WITH G AS (SELECT p_partkey, p_name, {_of_sql(FILES, "p_partkey")} AS filename, CASE WHEN p_size % 10 <> 0 THEN p_size END AS a, CASE WHEN p_size % 4 <> 0 THEN p_size + p_size % 4 - 3 END AS b FROM part)
SELECT p_partkey AS id, p_name AS name, 'm' || p_partkey AS full_name, filename, a::INTEGER AS start_line, (CASE WHEN coalesce(b, -1) > 0 THEN b ELSE a END)::INTEGER AS end_line, CASE WHEN p_partkey % 3 = 0 THEN 'a,b' ELSE '' END AS parameters, CASE WHEN p_partkey % 2 = 0 THEN 'int' ELSE '' END AS return_type
FROM G WHERE a IS NOT NULL AND {_APP}""")
def method_scan(spark, d):
    """Exported method nodes, with an end where they have none, of application files."""
    size = F.col("p_size").cast("int")
    nodes = c.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("fullName"), _of(FILES, "p_partkey").alias("filename"), F.when(size % 10 != 0, size).alias("lineNumber"),
        F.when(size % 4 != 0, size + size % 4 - 3).alias("lineNumberEnd"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("parameters"), F.when(F.col("p_partkey") % 2 == 0, "int").alias("returnType"),
    )
    return readers.methods(spark, _json(nodes, "methods")).withColumn("parameters", F.array_join("parameters", ","))


@query("call_scan", f"""
WITH G AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_returnflag AS name, {_of_sql(FILES, "l_partkey")} AS filename, l_linenumber, l_suppkey, l_partkey FROM lineitem)
SELECT id, name, 'f(' || l_partkey || ')' AS code, filename, l_linenumber::INTEGER AS line_number, 'm' || l_partkey AS callee, 'm' || l_suppkey AS containing FROM G WHERE l_linenumber <> 3 AND {_APP}""")
def call_scan(spark, d):
    """Exported call nodes with a line, of application files."""
    name = lambda letter, k: F.concat(F.lit(letter), F.col(k).cast("string"))
    nodes = c.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("name"), F.concat(name("f(", "l_partkey"), F.lit(")")).alias("code"), _of(FILES, "l_partkey").alias("filename"),
        F.when(F.col("l_linenumber") != 3, F.col("l_linenumber").cast("int")).alias("lineNumber"), name("m", "l_partkey").alias("calleeFullName"), name("m", "l_suppkey").alias("containingMethodFullName"),
    )
    return readers.calls(spark, _json(nodes, "calls"))


@query("flow_scan", """
WITH T AS (SELECT conv_id, turn, role, text FROM conversations), P AS (SELECT conv_id, string_agg('  ' || (turn + 1) || '. [' || role || CASE WHEN turn > 0 THEN ':' || turn ELSE '' END || '] (m) ' || text, chr(10) ORDER BY turn) AS steps, arg_min(text, turn) AS source FROM T GROUP BY conv_id)
SELECT conv_id AS sink_id, 'Source: ' || source || chr(10) || 'Sink: Flow: c' || conv_id || chr(10) || steps AS shown FROM P WHERE conv_id % 2 = 0""")
def flow_scan(spark, d):
    """S3 as exported, F5, dataflow fetch: paths of known sinks as text with numbered steps; a path without elements doesn't count."""
    turn = F.when(F.col("turn") > 0, F.col("turn")).otherwise(-1).cast("int")
    step = F.struct("turn", F.struct(F.col("text").alias("code"), turn.alias("line_number"), F.col("role").alias("filename"), F.lit("m").alias("method")).alias("s"))
    t = c.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["s"]).alias("path"))
    out = t.select(F.col("conv_id").alias("sink_id"), F.array("path", F.filter("path", lambda x: F.lit(False))).alias("flows"))
    sinks = t.filter("conv_id % 2 = 0").select(F.col("conv_id").alias("id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("code"), F.lit("Flow").alias("category"))
    return readers.flows(spark, _json(out, "flows"), sinks).select("sink_id", F.explode("paths").alias("p")).select("sink_id", text.flow_text(F.col("p")).alias("shown"))


@query("echo_decode", """
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events""")
def echo_decode(spark, d):
    """JSON bare, in quotes and in triple quotes of an interpreter's echo, and something that is none of these."""
    props, kind = F.col("props"), F.col("event_id") % 4
    quoted = F.concat(F.lit('val res1: String = "'), corpus.escaped(props), F.lit('"'))
    echo = F.when(kind == 0, props).when(kind == 1, quoted).when(kind == 2, F.concat(F.lit('res0: String = \"\"\"'), props, F.lit('\"\"\"'))).otherwise("error: not found")
    path = _folder(spark, "echo")
    c.table(spark, d, "events").select("event_id", echo.alias("raw")).write.parquet(path)
    return spark.read.parquet(path).select("event_id", readers.decoded(F.col("raw"), "k int")["k"].alias("k"))


@query("label_scan", """
SELECT c_mktsegment AS app, 'M' || (c_custkey % 5 + 1) AS operator, count(*) AS n, sum(c_nationkey)::BIGINT AS lines, count(DISTINCT c_name) AS ids FROM customer GROUP BY ALL""")
def label_scan(spark, d):
    """Labels written as JSON lines and read back under their schema."""
    none, line = F.lit(""), F.col("c_nationkey").cast("int")
    rows = c.table(spark, d, "customer").select(
        F.col("c_name").alias("id"), F.col("c_mktsegment").alias("app"), none.alias("repo"), none.alias("commit_sha"), F.concat(F.lit("M"), (F.col("c_custkey") % 5 + 1).cast("string")).alias("operator"), none.alias("control_class"), F.lit("a.js").alias("file"),
        line.alias("start_line"), line.alias("end_line"), none.alias("route_path"), F.lit('x "quoted"\n').alias("original_text"), none.alias("mutated_text"), none.alias("note"),
    )
    path = _folder(spark, "labels")
    writers.write_json_lines(rows, path)
    found = readers.labels(spark, path).filter(F.col("original_text") == 'x "quoted"\n')
    return found.groupBy("app", "operator").agg(F.count("*").alias("n"), F.sum("start_line").alias("lines"), F.count_distinct("id").alias("ids"))


@query("manifest_scan", """
SELECT 'o' || c_nationkey || '__' || replace(c_name, '#', '-') AS app, (c_custkey % 900)::INTEGER AS stars, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n_libs FROM customer""")
def manifest_scan(spark, d):
    """A manifest written and read back, with the name that a program goes by."""
    name = F.concat(F.lit("o"), F.col("c_nationkey").cast("string"), F.lit("/"), F.replace("c_name", F.lit("#"), F.lit("-")))
    libs = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("passport"), F.lit("jwt"))).otherwise(F.array(F.lit("passport")))
    rows = c.table(spark, d, "customer").select(name.alias("full_name"), F.lit("u").alias("clone_url"), F.lit("main").alias("default_branch"), (F.col("c_custkey") % 900).cast("int").alias("stars"), F.lit("").alias("pushed_at"), F.lit("mit").alias("license_key"), libs.alias("auth_libs"))
    path = _folder(spark, "manifest")
    writers.write_json_lines(rows, path)
    return readers.manifest(spark, path).select("app", "stars", F.size("auth_libs").alias("n_libs"))


@query("source_tree", """
SELECT lang || '.' || source AS file, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines FROM documents WHERE lang <> 'de' GROUP BY ALL""")
def source_tree(spark, d):
    """A tree of text files, read with its folders; one of its folders is skipped by name."""
    path = _folder(spark, "tree")
    docs = c.table(spark, d, "documents").withColumn("folder", F.when(F.col("lang") == "de", "node_modules").otherwise(F.concat_ws(".", "lang", "source")))
    docs.select(F.regexp_replace("folder", "[^A-Za-z0-9._-]", "-").alias("folder"), F.concat_ws("|", "folder", F.replace("text", F.lit("\n"), F.lit("\n|"))).alias("text")).write.partitionBy("folder").option("compression", "none").text(path)
    files = readers.source_files(spark, path, (".txt",)).filter(~F.contains("file", F.lit("=node_modules/")))
    lines = files.select(F.explode(F.split("text", "\n")).alias("line"), "text", "file").filter("line <> ''")
    # The first line of each document names its folder; the others begin with the mark.
    named = F.when(F.startswith("line", F.lit("|")), F.lit(None)).otherwise(F.element_at(F.split("line", "\\|"), 1))
    first = lines.select(F.regexp_extract("file", "folder=([^/]*)/", 1).alias("part"), named.alias("file"))
    counted = first.groupBy("part").agg(F.max("file").alias("file"), F.count("*").alias("n_lines"))
    return counted.select("file", "n_lines")


@query("base64_text", "SELECT doc_id, md5(text) AS digest FROM documents")
def base64_text(spark, d):
    """Texts as an API gives them, in base64 with line breaks."""
    coded = F.regexp_replace(F.base64(F.encode("text", "utf-8")), "(.{60})", "$1\n")
    path = _folder(spark, "coded")
    c.table(spark, d, "documents").select("doc_id", coded.alias("content")).write.parquet(path)
    return spark.read.parquet(path).select("doc_id", F.md5(corpus.decoded_text(F.col("content")).cast("binary")).alias("digest"))


@query("repo_list", "SELECT 'o/' || c_custkey AS repo FROM customer WHERE c_custkey % 3 <> 2")
def repo_list(spark, d):
    """A list with comments and blank lines."""
    key = F.concat(F.lit("o/"), F.col("c_custkey").cast("string"))
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), key, F.lit("  # a comment"))).when(F.col("c_custkey") % 3 == 1, key).when(F.col("c_custkey") % 2 == 0, "# nothing else").otherwise("   ")
    path = _folder(spark, "repos")
    c.table(spark, d, "customer").select(line.alias("value")).write.text(path)
    return readers.repo_list(spark, path)


@query("detections", """
SELECT 'rule:r/d' || doc_id || '.js:' || (doc_id % 50) AS context_id, 'r/d' || doc_id || '.js' AS file, (doc_id % 50)::INTEGER AS start_line, (CASE WHEN doc_id % 2 = 0 THEN doc_id % 50 + 3 ELSE doc_id % 50 END)::INTEGER AS end_line,
  CASE WHEN doc_id % 3 = 0 THEN 'CWE-' || doc_id ELSE 'CWE-862' END AS cwe, CASE WHEN doc_id % 5 = 0 THEN 'route registered with no middleware' ELSE source END AS description FROM documents""")
def detections(spark, d):
    """What another detector found, a document for each part of the corpus, as findings with defaults."""
    key = F.col("doc_id")
    line = (key % 50).cast("int")
    meta = F.struct(F.when(key % 3 == 0, F.concat(F.lit("CWE-"), key.cast("string"))).alias("cwe"))
    item = F.struct(
        F.concat(F.lit("/work/r/d"), key.cast("string"), F.lit(".js")).alias("path"), F.struct(line.alias("line")).alias("start"), F.struct(F.when(key % 2 == 0, line + 3).alias("line")).alias("end"),
        F.struct(F.when(key % 5 != 0, F.col("source")).alias("message"), meta.alias("metadata")).alias("extra"),
    )
    parts = c.table(spark, d, "documents").withColumn("part", F.floor(key / 500)).groupBy("part").agg(F.collect_list(item).alias("results")).select("results")
    found = readers.detections(spark, _json(parts, "detections", maxRecordsPerFile=1), "/work/")
    return found.select("context_id", "file", "start_line", "end_line", "cwe", "description")


@query("evaluation_files", """
SELECT source AS app, count(*)::INTEGER AS n_mutations, (sum(doc_id % 3) % 100)::INTEGER AS tp, '' AS variant FROM documents GROUP BY source""")
def evaluation_files(spark, d):
    """An evaluation file for each program, read as a folder; what isn't an evaluation is left out."""
    per = c.table(spark, d, "documents").groupBy(F.col("source").alias("app")).agg(F.count("*").cast("int").alias("n_mutations"), (F.sum(F.col("doc_id") % 3) % 100).cast("int").alias("tp"))
    rows = per.select(F.lit("now").alias("generated_at"), F.lit("cpg").alias("grounding"), F.struct("app", "n_mutations", "tp").alias("summary"))
    rows = rows.unionByName(per.select(F.lit("now").alias("generated_at"), F.lit("cpg").alias("grounding"), F.lit(None).cast(rows.schema["summary"].dataType).alias("summary")))
    found = readers.evaluations(spark, _json(rows, "evaluations", maxRecordsPerFile=1))
    return found.select("summary.app", "summary.n_mutations", "summary.tp", "variant")


REGISTRATIONS = ("app.get('/PATH', list)", "router.post(\"/PATH\", requireAuth, save)", "api.delete(`/PATH`, function (req, res) { f(1, 2); })", "server.get('/PATH', list)", "app.use('/PATH', list)", "r.all(path, list)", " route . put ( '/PATH' , x )", "app.get('/PATH')")
VERBS = ("GET", "POST", "?", "?", "?", "?", "?", "GET")


@query("unprotected_routes", f"""
SELECT p_partkey, {_of_sql(VERBS, "p_partkey")} AS verb, p_partkey % 8 IN (0, 2, 6) AS unprotected FROM part""")
def unprotected_routes(spark, d):
    """Registrations with a literal path and a handler and nothing between; and their verbs."""
    code = F.replace(_of(REGISTRATIONS, "p_partkey"), F.lit("PATH"), F.replace("p_name", F.lit(" "), F.lit("-")))
    rows = c.table(spark, d, "part").select("p_partkey", code.alias("code"))
    hit = readers.unprotected_routes(rows, split_call_args(F.col("code"))).select("p_partkey", F.lit(True).alias("hit"))
    return rows.join(hit, "p_partkey", "left").select("p_partkey", predicates.route_verb(F.col("code")).alias("verb"), F.coalesce("hit", F.lit(False)).alias("unprotected"))


MIDDLEWARE = {"passport.authenticate('jwt')": "M1 authentication", " requireAuth": "M1 authentication", "auth.isAdmin": "M1 authorization", "validateBody": "M5 validation", "(req, res) => f()": "", "users.list": "", "mw.validate(schema)": "M5 validation", "checkPermission('x')": "M1 authorization", "async function h() {}": "", "": ""}
CONDITIONS = {"req.user.id !== doc.ownerId": "ownership", "!req.user.isAdmin": "authorization", "!req.session.user": "session", "a > b": "", "user.role !== 'x'": "authorization", "!req.isAuthenticated()": "session"}
BODIES = {"return res.status(403).end();": True, "throw new Error('x')": True, "return next();": False, "return true;": False, "x = 1;": False, "res.redirect('/login')": True, "next(new AuthError())": True, "return Promise.resolve()": False, "return": True}


@query("middleware_classes", f"""
SELECT p_partkey, nullif({_of_sql(tuple(MIDDLEWARE.values()), "p_partkey")}, '') AS class, nullif({_of_sql(tuple(CONDITIONS.values()), "p_partkey")}, '') AS guard, ([{", ".join(str(v) for v in BODIES.values())}])[p_partkey % {len(BODIES)} + 1] AS denies FROM part""")
def middleware_classes(spark, d):
    """Classes of middleware, of guarding conditions, and whether a body denies; each word stands before the name of a part as a comment."""
    note = F.concat(F.lit(" // "), "p_partkey")
    rows = c.table(spark, d, "part").withColumn("p_partkey_", F.col("p_partkey"))
    arg, condition, body = (_of(tuple(words), "p_partkey") for words in (MIDDLEWARE, CONDITIONS, BODIES))
    kind = predicates.middleware_class(arg)
    return rows.select("p_partkey", F.concat_ws(" ", kind["operator"], kind["control"]).alias("class"), predicates.guard_condition(F.concat(condition, note)).alias("guard"), predicates.denies(F.concat(body, note)).alias("denies")).withColumn("class", F.nullif("class", F.lit("")))


_LANGUAGE = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in fixed.LANGUAGES.items())
SUFFIXES = tuple(fixed.LANGUAGES) + ("", ".txt", ".PY", ".min.js")


@query("language_by_suffix", f"""
WITH X AS (SELECT p_partkey, {_of_sql(SUFFIXES, "p_partkey")} AS suffix, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE lower(CASE suffix WHEN '.min.js' THEN '.js' ELSE suffix END) {_LANGUAGE} END AS language, k < 2 AS url, 'o' || p_partkey || '/r' AS repository FROM X""")
def language_by_suffix(spark, d):
    """Languages by suffix, addresses against paths, and the repository that an address names."""
    key = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("o"), key, F.lit("/r"))
    k = F.col("p_partkey") % 4
    where = F.when(k == 0, F.concat(F.lit("https://host.org/"), name, F.lit(".git"))).when(k == 1, F.concat(F.lit("git@host.org:"), name)).when(k == 2, name).otherwise(F.concat(name, F.lit("/")))
    return c.table(spark, d, "part").select("p_partkey", predicates.language_of(F.concat(F.lit("src/f"), key, _of(SUFFIXES, "p_partkey"))).alias("language"), predicates.is_url(where).alias("url"), corpus.repository_name(where).alias("repository"))


_JOBS = """J AS (SELECT 'u' || user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_no, event_type AS line,
CASE WHEN event_type = 'error' AND value >= 100 THEN 'failed' WHEN event_type = 'purchase' AND value >= 300 THEN 'done' ELSE 'running' END AS status FROM events)"""


@query("job_log", f"""
WITH {_JOBS}, T AS (SELECT job, min(line_no) AS last, arg_min(status, line_no) AS ended FROM J WHERE status <> 'running' GROUP BY job)
SELECT J.job, 'line' AS kind, line_no, line, status FROM J LEFT JOIN T ON J.job = T.job WHERE T.job IS NULL OR line_no <= last
UNION ALL SELECT job, 'end', last + 1, NULL, ended FROM T""")
def job_log(spark, d):
    """The log of each user as a job, streamed to its end from files whose lines come out of order and twice: lines in order, and one row where a job ends."""
    from pyspark.sql import Window as W

    e, order = c.table(spark, d, "events"), W.partitionBy("user_id").orderBy("ts", "event_id")
    ended = F.when((F.col("event_type") == "error") & (F.col("value") >= 100), "failed").when((F.col("event_type") == "purchase") & (F.col("value") >= 300), "done").otherwise("running")
    log = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job"), (F.row_number().over(order) - 1).cast("bigint").alias("line_no"), F.col("event_type").alias("line"), ended.alias("status"), "event_id")
    again = log.filter("event_id % 10 = 0")
    log = log.unionByName(again).withColumn("file", F.pmod(F.xxhash64("event_id"), F.lit(8)))
    path = _folder(spark, "log")
    log.repartition(8, "file").select("job", "line_no", "line", "status").write.json(path)
    stream = spark.readStream.schema(jobs.LOG).option("maxFilesPerTrigger", 3).json(path)
    out = _folder(spark, "followed")
    jobs.written_out(jobs.followed(stream), out, _folder(spark, "followed-checkpoint")).awaitTermination()
    return spark.read.schema(jobs.EVENTS).parquet(out)
