from pyspark.sql import functions as F

from evidentia.operators import corpus


def test_fingerprints_follow_names_and_texts(spark):
    rows = [("a", f"f{k}", "x") for k in range(600)]
    df = lambda r: spark.createDataFrame(r, "app string, file string, text string")
    one = lambda r: corpus.fingerprints(df(r)).first().fingerprint
    first = one(rows)
    assert first == one(rows[::-1]) and len(first) == 64
    assert first != one([*rows[:-1], ("a", "f599", "y")]) and first != one([*rows[:-1], ("a", "g", "x")]) and first != one(rows[:-1])


def test_names_queries_and_minimum(spark):
    urls = spark.createDataFrame([("https://host/a/b.git",), ("git@host:a/b",), ("a/b",), ("nothing",)], "u string").coalesce(1)
    assert [r[0] for r in urls.select(corpus.repository_name(F.col("u"))).collect()] == ["a/b", "a/b", "a/b", None]
    q = spark.range(1).select(corpus.search_query(F.lit(5), F.lit("2024-01-01"))).first()[0]
    assert q == "express language:JavaScript stars:>=5 pushed:>=2024-01-01 archived:false is:public"
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "app string, position int")
    assert {r.app for r in corpus.with_minimum(rows, "app", 2).collect()} == {"a"} and corpus.first_mutations(rows, 1).count() == 2
    c = spark.createDataFrame([("x", 3), ("y", 9), ("z", 9)], "full_name string, stars int")
    assert [r.full_name for r in corpus.best_candidates(c, 2).collect()] == ["y", "z"]
    s = spark.createDataFrame([(1, "judge", 2.04), (0, "load", 0.5), (2, "none", 0.0)], "position int, name string, seconds double")
    assert [tuple(r) for r in corpus.stage_breakdown(s).collect()] == [(0, "load", 0.5), (1, "judge", 2.0)]


def test_escapes_and_base64(spark):
    rows = spark.createDataFrame([('a "b"\n\\c\t',), ("",)], "t string").coalesce(1)
    out = rows.select("t", corpus.unescaped(corpus.escaped(F.col("t"))).alias("back"), corpus.decoded_text(F.base64(F.col("t").cast("binary"))).alias("b64")).collect()
    assert all(r.t == r.back == r.b64 for r in out)
