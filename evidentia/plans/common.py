"""What the queries share: views of the tables in the roles the operators ask for, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Rule

#: Rules for lines of documents, in order. They stay inside what both regular expression dialects read alike.
LINE_RULES = [
    Rule(r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*['\"]?[A-Za-z0-9/+_-]{12,}", "Hardcoded Credential", "CWE-798", "high"),
    Rule(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "Personal Data", "CWE-359", "medium"),
    Rule(r"[0-9]{3}-[0-9]{3,4}", "Personal Data", "CWE-359", "medium"),
    Rule(r"(?i)licen[cs]e", "Licence Notice", "CWE-1104", "info"),
    Rule(r"!!|%%%|\*\*\*|[|]", "Markup Debris", "CWE-116", "low"),
]
SOURCE_RULES = [LINE_RULES[0], LINE_RULES[3]]
TRIGGER_RULES = [Rule(r"!!|\*\*\*", "Shouting", operation="write"), Rule(r"[|]", "Table", operation="read"), Rule(r"%%%", "Noise", operation="route")]
GUARD_RULES = [Rule(r"(?i)licen[cs]e", "Licence line", control="authorization"), Rule(r"@", "Contact line", control="authentication"), Rule(r"^[A-Z][a-z]+\.$", "One word", control="session")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, line (from 1), code."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "code")).select("doc_id", "lang", "source", (F.col("pos") + 1).cast("bigint").alias("line"), "code")


LINES = "L AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """calls (id, containing, callee) from supplier to part of each line item, and the methods, which are the suppliers; other parts are external."""
    items = table(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    calls = items.select(F.col("l_orderkey").alias("id"), name("l_suppkey").alias("containing"), name("l_partkey").alias("callee"))
    methods = table(spark, sf_dir, "supplier").select(name("s_suppkey").alias("full_name"), "s_suppkey", "s_nationkey")
    return calls, methods


GRAPH = """C AS (SELECT l_orderkey AS id, 'm' || l_suppkey AS containing, 'm' || l_partkey AS callee FROM lineitem),
M AS (SELECT 'm' || s_suppkey AS full_name, s_suppkey, s_nationkey FROM supplier)"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))


PATHS = "P AS (SELECT page_id, url, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)"


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: user as file, type as class, seconds as lines, severity by value."""
    e = table(spark, sf_dir, "events")
    second = seconds(F.col("ts"))
    length = (F.floor(F.col("value")) * 60).cast("bigint")
    severity = F.when(F.col("value") >= 40, "critical").when(F.col("value") >= 20, "high").when(F.col("value") >= 10, "medium").when(F.col("value") >= 5, "low").otherwise("info")
    return e.select("event_id", "user_id", "event_type", second.alias("start_line"), (second + length).alias("end_line"), severity.alias("severity"), "value")


EVENTS = """F AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS start_line, epoch_us(ts) // 1000000 + floor(value)::BIGINT * 60 AS end_line,
CASE WHEN value >= 40 THEN 'critical' WHEN value >= 20 THEN 'high' WHEN value >= 10 THEN 'medium' WHEN value >= 5 THEN 'low' ELSE 'info' END AS severity, value FROM events)"""


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def first_sql(rules: list[Rule], column: str, attribute: str) -> str:
    """CASE over the rules in order."""
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {quote(r.pattern)}) THEN {quote(getattr(r, attribute))}" for r in rules) + " END"


def any_sql(rules: list[Rule], column: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {quote(r.pattern)})" for r in rules) + ")"


def rate_sql(part: str, whole: str, digits: int = 3) -> str:
    return f"round(coalesce(CAST({part} AS DOUBLE) / nullif({whole}, 0), 0), {digits})"
