import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_lines, brute_near

import corpus_pipeline
from evidentia.llm import queries


DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage over the smallest documents."""
    base, out, found = f"{DATA}/sf0.001", tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, base).write.parquet(f"{out}/{name}")
        after = spark.read.parquet(f"{out}/{name}")
        found[name] = docs, after
        docs = after
    return found


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "text").collect()), key=str)


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(after.columns == ["doc_id", "text", "lang", "source", "n_chars"] for name, (_, after) in stages.items() if name != "packing")


def test_quality_stage_keeps_clean_documents(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")
    kept = after.select("doc_id").withColumn("kept", F.lit(True))
    known = before.join(labels, "doc_id").join(kept, "doc_id", "left").select("quality", F.coalesce("kept", F.lit(False)).alias("kept")).collect()
    assert np.mean([r.kept == (r.quality == 1) for r in known]) > 0.9 and np.mean([r.kept for r in known if r.quality]) > 0.97


def brute_line_stage(source):
    want = []
    for (i, old), (j, new) in zip(source, brute_lines(source)):
        assert i == j
        if old == new or new.strip(" \t\n\x0b\x0c\r"):
            want.append((i, new))
    return want


def test_line_stage_equals_brute_force(stages):
    before, after = stages["line_dedup"]
    assert rows(after) == brute_line_stage(rows(before)) and after.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_line_stage_drops_only_what_is_emptied(spark):
    licence = "this licence line is in every document"
    texts = [licence + "\nAll rights reserved.", "roses are red\n" + licence + "\nviolets are blue", licence + "\nAll  rights reserved.\n", licence + "\n \n", "All rights reserved.", "roses are  red\n" + licence + "\nsugar is sweet"]
    docs = spark.createDataFrame([*enumerate(texts), (None, licence), (9, None)], "doc_id bigint, text string").repartition(3)
    got = dict(rows(corpus_pipeline.drop_repeated_lines(spark, docs, "")))
    assert got == {0: texts[0], 1: "roses are red\nviolets are blue", 5: "sugar is sweet", None: licence, 9: None}


def test_near_stage_equals_brute_force(stages):
    before, after = stages["near_dedup"]
    keep = {r[0] for r in brute_near(rows(before), 80) if r[3]}
    assert rows(after) == [r for r in rows(before) if r[0] in keep]


def test_near_stage_decides_by_row(spark):
    a, b = "one two three four five six seven", "other words that are near nothing"
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (None, a), (None, "no id at all here")], "doc_id bigint, text string").withColumn("component", F.lit("clash"))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and rows(out) == [(1, a), (5, b), (None, "no id at all here")]


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "mixing", "packing"])
def test_stage_edges(spark, sf_dir, name):
    """Nulls in every column, ties, repeated rows, one long text, clashing names, and an empty table."""
    long = " ".join(f"word{k % 977}" for k in range(40_000))
    given = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "x y z", "en", None, 5), (3, "", "de", "s", 0), (4, long, "en", "t", len(long)), (4, "other text", "en", "t", 10), (-7, " \n\t", None, "t", 3)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({"Score": F.lit(1), "gone": F.lit("g"), "row_no": F.lit(2), "label": F.lit(3), "key_id": F.lit(4)})
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf_dir)
    none = stage(spark, docs.limit(0), sf_dir)
    assert none.count() == 0 and none.columns == out.columns
    if name == "packing":
        tokens = {(r.doc_id, r.doc_tokens) for r in out.collect()}
        assert {i for i, _ in tokens} == {r[0] for r in given} and (2, 1) in tokens and (3, 1) in tokens
        return
    assert out.columns == docs.columns and set(rows(out)) <= {r[:2] for r in given}
    if name == "line_dedup":
        assert rows(out) == rows(docs)  # rows with one id are at one place
    if name == "near_dedup":
        assert rows(out) == rows(docs.dropDuplicates(["doc_id", "text"]))
    if name == "mixing":
        assert all(r.text and r.text.strip() for r in out.collect())


def test_mixing_and_packing_stages(stages):
    before, after = stages["mixing"]
    n = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert max(n.values()) <= 2 and set(n) <= {r[0] for r in rows(before)} and after.select("doc_id", "text").exceptAll(after.select("doc_id", "text").dropDuplicates()).join(before, "doc_id", "left_anti").count() == 0
    source, packed = stages["packing"]
    total = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    copies = {r.doc_id: r["count"] for r in source.groupBy("doc_id").count().collect()}
    assert {r.doc_id: r.n for r in total} == {r.doc_id: r.t * copies[r.doc_id] for r in total} and len(total) == len(copies)


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, f"{DATA}/sf0.001").select("doc_id", "start", "length", "ids_crc32")
    want = stages["packing"][1].select("doc_id", "start", "length", "ids_crc32")
    total = lambda df: {r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total(got) == total(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    result = con.execute(queries.ORACLES[name])
    names = [c[0] for c in result.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, result.fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_covers_its_table(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    key, tab = ("page_id", "pages") if "page_id" in df.columns else ("doc_id", "documents")
    assert {r[0] for r in df.select(key).distinct().collect()} == {r[0] for r in spark.read.parquet(f"{sf_dir}/{tab}.parquet").select(key).collect()}


def test_the_rest_stands_without_this_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    subprocess.run(["cp", "-r", f"{root}/evidentia", f"{root}/__spark_entry__.py", f"{root}/corpus_pipeline.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", f"{tmp_path}/evidentia/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rule_shortlist' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    for gone in ("", "corpus_pipeline.py"):
        if gone:
            os.remove(tmp_path / gone)
        subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_a_missing_dependency_is_an_error(tmp_path):
    """Only the absence of the subpackage or of the pipeline is passed over."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    subprocess.run(["cp", "-r", f"{root}/evidentia", f"{root}/__spark_entry__.py", f"{root}/corpus_pipeline.py", str(tmp_path)], check=True)
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True).returncode != 0
