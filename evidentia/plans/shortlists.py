"""Queries on lines of documents and on paths: rules, guards, candidates, windows, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, predicates, text
from ..functions.rules import any_match
from ..operators import contexts, shortlist
from . import common as c
from .common import any_sql, first_sql, quote

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("rule_shortlist", f"""
WITH {c.LINES}, H AS (SELECT source, {first_sql(c.LINE_RULES, "code", "category")} AS category FROM L)
SELECT source, category, count(*) AS n FROM H WHERE category IS NOT NULL GROUP BY source, category""")
def rule_shortlist(spark, d):
    """Hits by source and category, the first rule in order wins."""
    return shortlist.shortlist(c.line_view(spark, d), c.LINE_RULES, "code").groupBy("source", "category").agg(F.count("*").alias("n"))


@query("source_semi", f"""
WITH {c.LINES} SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM L WHERE {any_sql(c.SOURCE_RULES, "code")})""")
def source_semi(spark, d):
    """Documents with a line of a source rule."""
    hits = shortlist.sources(c.line_view(spark, d), c.SOURCE_RULES, "code").select("doc_id").distinct()
    return c.table(spark, d, "documents").select("doc_id", "source").join(hits, "doc_id", "left_semi")


@query("trigger_first_match", f"""
WITH {c.LINES}, T AS (SELECT doc_id, line, code, {first_sql(c.TRIGGER_RULES, "code", "category")} AS category, {first_sql(c.TRIGGER_RULES, "code", "operation")} AS operation FROM L)
SELECT doc_id, line, category, operation, CASE WHEN operation = 'route' THEN regexp_extract(code, {quote(fixed.ROUTE_PATH)}, 1) ELSE '' END AS route_path FROM T WHERE category IS NOT NULL""")
def trigger_first_match(spark, d):
    """Triggers by line, with the quoted path of routes."""
    return shortlist.triggers(c.line_view(spark, d), c.TRIGGER_RULES, "code").select("doc_id", "line", "category", "operation", "route_path")


@query("guard_anti", f"""
WITH {c.LINES} SELECT DISTINCT doc_id FROM L WHERE {any_sql(c.TRIGGER_RULES, "code")}
AND doc_id NOT IN (SELECT doc_id FROM L WHERE {any_sql(c.GUARD_RULES, "code")})""")
def guard_anti(spark, d):
    """Documents with a trigger and without a guard."""
    view = c.line_view(spark, d)
    found = shortlist.triggers(view, c.TRIGGER_RULES, "code").select("doc_id").distinct()
    return shortlist.without_guard(found, shortlist.guards(view, c.GUARD_RULES, "code"), "doc_id")


@query("line_guard_scan", f"""WITH {c.LINES} SELECT doc_id, min(line) AS first_guard FROM L WHERE {any_sql(c.GUARD_RULES, "code")} GROUP BY doc_id""")
def line_guard_scan(spark, d):
    """The first line with a guard."""
    docs = c.table(spark, d, "documents").select("doc_id", F.col("text").alias("code"), F.lit(1).cast("bigint").alias("line"))
    return shortlist.guard_lines(docs, c.GUARD_RULES).groupBy("doc_id").agg(F.min("line").alias("first_guard"))


@query("priority_budget", f"""
WITH {c.LINES}, T AS (SELECT doc_id, line, {first_sql(c.TRIGGER_RULES, "code", "operation")} AS operation FROM L),
N AS (SELECT doc_id, CASE WHEN operation = 'route' THEN 0 ELSE 1 END AS kind, count(*) AS n FROM T WHERE operation IS NOT NULL GROUP BY ALL)
SELECT doc_id, kind::INTEGER AS kind, n FROM N ORDER BY kind, n DESC, doc_id LIMIT 30""")
def priority_budget(spark, d):
    """O2, O3: routes and other candidates under one budget."""
    t = shortlist.triggers(c.line_view(spark, d), c.TRIGGER_RULES, "code")
    n = lambda rows: rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    both = shortlist.with_budget(n(t.filter("operation = 'route'")), n(t.filter("operation <> 'route'")), 30, [F.desc("n"), F.col("doc_id")])
    return both.select("doc_id", "kind", "n")


@query("app_file_filter", f"WITH {c.PATHS} SELECT page_id, path FROM P WHERE path <> '' AND NOT regexp_matches(replace(path, chr(92), '/'), {quote(fixed.NON_APP_PATH)})")
def app_file_filter(spark, d):
    """Paths of the application."""
    return c.page_paths(spark, d).filter(predicates.is_app_file(F.col("path"))).select("page_id", "path")


@query("public_route_filter", f"""
WITH {c.PATHS}, R AS (SELECT page_id, path AS route FROM P UNION ALL SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages)
SELECT page_id, route, route <> '' AND regexp_matches(trim(route), {quote(fixed.PUBLIC_ROUTE)}) AS public, count(*) AS n FROM R GROUP BY ALL""")
def public_route_filter(spark, d):
    """Page paths and links, public or not."""
    hrefs = c.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("route"))
    routes = c.page_paths(spark, d).select("page_id", F.col("path").alias("route")).union(hrefs)
    return routes.withColumn("public", predicates.is_public_route(F.col("route"))).groupBy("page_id", "route", "public").agg(F.count("*").alias("n"))


@query("lang_mode", """
WITH N AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang),
R AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k, sum(n) OVER (PARTITION BY source) AS n_files FROM N)
SELECT source, lang, n, n_files::BIGINT AS n_files FROM R WHERE k = 1""")
def lang_mode(spark, d):
    """The most frequent language of each source."""
    from ..operators.metrics import language_counts

    return language_counts(c.table(spark, d, "documents"), "source", "lang")


@query("contextual_budget", """
WITH RECURSIVE T AS (SELECT conv_id, list(text ORDER BY turn) AS ts FROM conversations GROUP BY conv_id),
U AS (SELECT conv_id, ts, [list_sum([length(x) for x in ts[:i]]) for i in range(1, len(ts) + 1)] AS used FROM T)
SELECT conv_id, array_to_string([ts[i] for i in range(1, len(ts) + 1) if used[i] <= 300] || CASE WHEN used[len(ts)] > 300 THEN ['- ... more ...'] ELSE [] END, chr(10)) AS shown FROM U""")
def contextual_budget(spark, d):
    """O5 inside a context: parts within a budget and one mark for what is left out."""
    t = c.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    return t.select("conv_id", F.array_join(contexts.budgeted(F.transform("ts", lambda x: x["text"]), 300, "- ... more ..."), "\n").alias("shown"))


@query("hash_split", """
SELECT source, n, ('0x' || substr(sha256('split:' || source), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.3 AS held_out
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def hash_split(spark, d):
    """whole sources held out by their hash."""
    return c.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", "n", text.hash_split(F.col("source"), "split", 0.3).alias("held_out"))


@query("control_class_set", f"""
WITH B AS (SELECT conv_id, turn, lower(role || ' ' || text) AS blob FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter([{", ".join(f"CASE WHEN {' OR '.join(f'contains(blob, {quote(w)})' for w in ws)} THEN {quote(k)} END" for k, ws in {"short": ("th",), "accent": ("é", "ü"), "system": ("system", "user")}.items())}], lambda x: x IS NOT NULL), ',') AS classes FROM B""")
def control_class_set(spark, d):
    """Classes by words in a text."""
    classes = {"short": ("th",), "accent": ("é", "ü"), "system": ("system", "user")}
    return c.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(predicates.control_classes(F.col("role"), F.col("text"), classes=classes), ",").alias("classes"))


@query("mutation_apply", f"""
WITH {c.LINES}, H AS (SELECT doc_id, min(line) AS hit FROM L WHERE {any_sql(c.LINE_RULES, "code")} GROUP BY doc_id)
SELECT L.doc_id, hit, count(*) AS n_lines, md5(string_agg(CASE WHEN line = hit THEN '' ELSE code END, chr(10) ORDER BY line)) AS mutant
FROM H JOIN L ON H.doc_id = L.doc_id GROUP BY L.doc_id, hit""")
def mutation_apply(spark, d):
    """M8: a line blanked, the number of lines kept."""
    from ..operators.mutation import applied

    hit = shortlist.shortlist(c.line_view(spark, d), c.LINE_RULES, "code").groupBy("doc_id").agg(F.min("line").cast("int").alias("hit"))
    docs = c.table(spark, d, "documents").select("doc_id", "text").join(hit, "doc_id")
    original = F.get(F.split("text", "\n"), F.col("hit") - 1)
    mutant = docs.withColumn("mutant", applied(F.col("text"), F.col("hit"), F.col("hit"), original, F.lit("")))
    return mutant.select("doc_id", F.col("hit").cast("bigint").alias("hit"), F.size(F.split("mutant", "\n")).cast("bigint").alias("n_lines"), F.md5(F.col("mutant").cast("binary")).alias("mutant"))


@query("validation_range_semi", f"""
WITH {c.LINES}, G AS (SELECT doc_id, line FROM L WHERE {any_sql(c.GUARD_RULES, "code")}), W AS (SELECT doc_id, line FROM L WHERE {any_sql(c.TRIGGER_RULES, "code")})
SELECT doc_id, line FROM G WHERE EXISTS (SELECT 1 FROM W WHERE W.doc_id = G.doc_id AND W.line > G.line AND W.line <= G.line + 60)""")
def validation_range_semi(spark, d):
    """Guards with a trigger at most 60 lines below."""
    from ..operators.mutation import validations_before_writes

    view = c.line_view(spark, d)
    g = view.filter(any_match(c.GUARD_RULES, F.col("code"))).select("doc_id", "line")
    return validations_before_writes(g, view.filter(any_match(c.TRIGGER_RULES, F.col("code"))).select("doc_id", "line"), ["doc_id"], "line")


@query("compression_stats", f"""
WITH D AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*$'))) AS f FROM documents),
{c.LINES}, S AS (SELECT doc_id, count(*) AS s FROM L WHERE {any_sql(c.LINE_RULES, "code")} GROUP BY doc_id),
R AS (SELECT s, f, s / nullif(f, 0) AS ratio FROM S JOIN D USING (doc_id))
SELECT count(*) AS contexts, floor(median(s))::BIGINT AS slice_loc_median, round(avg(s), 1) AS slice_loc_mean, floor(median(f))::BIGINT AS file_loc_median,
round(median(ratio), 4) AS slice_over_file_median, round(avg(ratio), 4) AS slice_over_file_mean, (SELECT sum(f) FROM D)::BIGINT AS repo_source_loc,
round(avg(s) / (SELECT sum(f) FROM D), 6) AS slice_over_repo_mean FROM R""")
def compression_stats(spark, d):
    """How much of a document its hits are."""
    from ..operators.metrics import compression

    hits = shortlist.shortlist(c.line_view(spark, d), c.LINE_RULES, "code")
    slices = hits.groupBy(F.col("doc_id").alias("file")).agg(F.array_join(F.collect_list("code"), "\n").alias("code"))
    return compression(slices, c.table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text"))


@query("group_minimum", """
SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source HAVING count(*) >= 2)""")
def group_minimum(spark, d):
    """Documents of sources that have at least two labels of a kind."""
    from ..operators.corpus import with_minimum

    docs = c.table(spark, d, "documents").select("doc_id", "source")
    toxic = docs.join(c.table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id")
    return docs.join(with_minimum(toxic, "source", 2).select("source").distinct(), "source", "left_semi").select("doc_id", "source")


@query("first_per_group", """
WITH R AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT doc_id, source FROM R WHERE k <= 3""")
def first_per_group(spark, d):
    """The first rows of each program."""
    from ..operators.corpus import first_mutations

    rows = c.table(spark, d, "documents").select("doc_id", F.col("source").alias("app"), F.col("doc_id").alias("position"))
    return first_mutations(rows, 3).select("doc_id", F.col("app").alias("source"))
