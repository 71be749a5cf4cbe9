"""Every query of the catalogue against its SQL."""

import os

import duckdb
import pytest

from evidentia import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(names, records):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(repr(r[k]) if isinstance(r[k], float) else str(r[k]) for k in order) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in catalogue.ORACLES:
        result = duck.execute(catalogue.ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, result.fetchall())


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Documents of 300 lines, with a guard in each line of the second half."""
    folder = tmp_path_factory.mktemp("long")
    text = "\n".join(f"{k} " + ("words without any mark " * 5 if k < 150 else f"a licence of x{k}@y.org ") * (1 + k % 2) for k in range(300))
    spark.createDataFrame([(k, text, "en", "s") for k in range(3)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["guard_evidence", "raw_prompt"])
def test_long_documents(spark, long_texts, name):
    """No query reads only the head of a long text."""
    df = catalogue.QUERIES[name](spark, long_texts)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{long_texts}/documents.parquet/*.parquet'")
    result = con.execute(catalogue.ORACLES[name])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got and got == rows([c[0] for c in result.description], result.fetchall())


ODD_TEXTS = ["", "\n", "a\n", "a\n\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e\u2028f\u2029g\nh", " ", "\r\n", "ß│\n日本 \U0001f600", None]


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    """Documents that are empty, null, without a language, or have other line ends than line feeds."""
    folder = tmp_path_factory.mktemp("odd")
    found = [(k, text, lang, "s") for k, (text, lang) in enumerate((t, lang) for t in ODD_TEXTS for lang in ("en", "", None))]
    spark.createDataFrame([*found, (None, "a", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_raw_prompt_of_odd_texts(spark, odd_texts):
    df = catalogue.QUERIES["raw_prompt"](spark, odd_texts)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd_texts}/documents.parquet/*.parquet'")
    result = con.execute(catalogue.ORACLES["raw_prompt"])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == 2 * (len(ODD_TEXTS) - 1) and got == rows([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", ["evaluation_scored", "heldout_scored"])
def test_lines_are_read_once(spark, sf_dir, monkeypatch, name):
    """Labels, findings and baseline come from one scan of the lines."""
    from evidentia.plans import program

    calls, view = [], program.c.line_view
    monkeypatch.setattr(program.c, "line_view", lambda *a: calls.append(a) or view(*a))
    files = catalogue.QUERIES[name](spark, sf_dir).inputFiles()
    assert len(calls) == 1 and not any("documents" in f for f in files)


def test_report_reads_written_findings(spark, sf_dir, monkeypatch):
    """The jobs of a report (counts, bounds, parts) don't scan the documents again."""
    from evidentia.plans import findings

    read, sections = [], findings.writers.markdown_sections
    monkeypatch.setattr(findings.writers, "markdown_sections", lambda found, run: read.extend(found.inputFiles()) or sections(found, run))
    catalogue.QUERIES["report_markdown"](spark, sf_dir)
    assert read and not any("documents" in f for f in read)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["source", "category", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
