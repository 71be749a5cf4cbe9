import re

import pytest
from pyspark.sql import functions as F

from evidentia.functions import predicates, rules, text
from evidentia.functions.rule_table import RULES


def values(spark, expr, rows, *names):
    names = names or ("x",)
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).coalesce(1).select(expr).collect()]


PUBLIC = "/login /logout /sign-in /signup /register /auth/google /auth/github/callback /oauth/callback /reset-password /password/forgot /verify-email /health /healthz /status /metrics /ping /favicon.ico /robots.txt /.well-known/jwks.json /static/app.js /assets/logo.png /public/ /".split()
PRIVATE = ["", *"/admin /admin/users /users/42 /users/:id /profile /dashboard /api/users /orders/17/cancel /account/settings /me /notes/5 /loginHistory".split()]


def test_public_routes(spark):
    assert all(values(spark, predicates.is_public_route(F.col("x")), PUBLIC))
    assert not any(values(spark, predicates.is_public_route(F.col("x")), PRIVATE))


def test_app_files(spark):
    app = "server.ts routes/basket.ts src/app/controllers/user.js src/latest/handler.ts routes/contest.ts services/specification.ts".split()
    other = ["", "<empty>", *"node_modules/express/index.js frontend/dist/frontend/main.js app.min.js test/api/x.ts routes/__tests__/b.test.ts routes\\tests\\b.ts spec/u.rb routes/b.spec.ts data/static/codefixes/c_1.ts".split()]
    assert all(values(spark, predicates.is_app_file(F.col("x")), app))
    assert not any(values(spark, predicates.is_app_file(F.col("x")), other))


MIDDLEWARE = {
    "requireAuth": "authentication", "isLoggedIn": "authentication", "auth('getUsers')": "authentication", "passport.authenticate('jwt')": "authentication", "mw.protect": "authentication",
    "verifyToken": "authentication", "ensureAdmin": "authorization", "authorize(['admin'])": "authorization", "restrictTo('admin')": "authorization", "checkRole('editor')": "authorization",
    "validate(authValidation.register)": "validation", "celebrate(schema)": "validation", "ctrl.index": None, "next": None, "bodyParser": None, "cors()": None, "function (req, res)": None, "(req, res) => {}": None,
}


def test_middleware_classes(spark):
    from evidentia.operators.mutation import middleware

    got = values(spark, predicates.middleware_class(F.col("x"))["control"], list(MIDDLEWARE))
    assert dict(zip(MIDDLEWARE, got)) == MIDDLEWARE
    assert {m: (middleware(m) or (None, None))[1] for m in MIDDLEWARE} == MIDDLEWARE


def test_rule_table_and_probes(spark):
    assert len(RULES) == 141 and len(rules.rules("hygiene", "typescript", "check")) == 7
    probes = [("python", "sink", "os.system(cmd)", "OS Command Injection"), ("python", "source", "request.args.get('id')", "HTTP request input (Flask/Django/FastAPI style)"), ("javascript", "sink", "el.innerHTML = x", "Cross-Site Scripting"), ("javascript", "sink", "req.query", None)]
    for lang, kind, code, category in probes:
        table = rules.rules("injection", lang, kind)
        got = values(spark, rules.attribute(table, rules.first_match(table, F.col("x")), "category"), [code])
        assert got == [category]


def test_first_rule_wins_and_yaml(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("python:\n  sinks:\n    - {pattern: 'a+', category: A}\n    - {pattern: 'b', category: B, cwe: CWE-1}\n")
    table = rules.read_rules(str(tmp_path / "r.yaml"), "sink", "python")
    assert values(spark, rules.first_match(table, F.col("x")), ["ba", "b", "c"]) == [0, 1, None]
    assert rules.rule_frame(spark, table).count() == 2 and rules.read_rules(str(tmp_path / "r.yaml"), "sink", "go") == []
    assert set(rules.rule_sets("both", "python")) == {"sink", "source", "trigger", "guard"}


def test_text_functions(spark):
    assert values(spark, text.clean_type(F.col("x")), ["SQL Injection (CWE-89)", "missing_access-control", "a b_c", ""]) == ["SQL Injection", "Missing Access Control", "a b_c", ""]
    assert values(spark, text.class_key(F.col("x"), F.col("y")), [("cwe-94: x", "T"), ("", " T ")], "x", "y") == ["CWE-94", "t"]
    assert values(spark, text.json_object(F.col("x")), ['```json\n{"a": {}}\n```', "none"]) == ['{"a": {}}', ""]
    assert values(spark, text.nonblank_lines(F.col("x")), ["a\n\n b \n", "", " \n\t"]) == [2, 0, 0]
    body = "\n".join(map(str, range(1, 11)))
    assert values(spark, text.line_range(text.lines(F.col("x")), F.lit(3), F.lit(5)), [body]) == ["3\n4\n5"]
    assert values(spark, text.line_range(text.lines(F.col("x")), F.lit(1), F.lit(9), 2), [body]) == ["1\n2\n3"]
    assert values(spark, text.line_range(text.lines(F.col("x")), F.lit(99), F.lit(1)), [body]) == [""]
    assert values(spark, text.imports(F.col("x"), "python"), ["import os\nx\n  from a import b\n"]) == [["import os", "from a import b"]]
    assert values(spark, text.numbered_window(F.col("x"), F.lit(1)), ["a\nb"]) == ["     1│a\n     2│b"]
    long = values(spark, text.numbered_window(F.col("x"), F.lit(5), 10, 5), [body])[0]
    assert long.startswith("// ... lines 1-2 omitted ...\n     3│3") and long.endswith("// ... lines 7-10 omitted ...")


def test_control_classes_languages_verbs(spark):
    assert values(spark, predicates.control_classes(F.col("x")), ["IDOR on other user, CWE-862", "nothing"]) == [["authorization", "ownership"], []]
    assert values(spark, predicates.language_of(F.col("x")), ["a/b.TSX", "a.h", "a"]) == ["typescript", "c", None]
    assert values(spark, predicates.route_verb(F.col("x")), ["app.get('/x')", "f()"]) == ["GET", "?"]
    assert values(spark, predicates.guard_condition(F.col("x")), ["req.user.id !== doc.ownerId", "!user.isAdmin", "!req.session", "a"]) == ["ownership", "authorization", "session", None]
    assert values(spark, predicates.denies(F.col("x")), ["return next()", "return res.end()", "next()"]) == [False, True, False]


@pytest.mark.parametrize("share,least,most", [(0.0, 0, 0), (0.3, 200, 400), (1.0, 1000, 1000)])
def test_hash_split_is_near_its_share(spark, share, least, most):
    rows = spark.range(1000).select(text.hash_split(F.col("id").cast("string"), "s", share).alias("h"))
    assert least <= rows.filter("h").count() <= most


def test_needed_literals_and_marks(spark):
    from evidentia.functions.rule_table import RULES

    assert sorted(rules.needed_literals(r"(?:os\.system|popen)\s*\(")) == ["os.system", "popen"]
    assert [sorted(rules.needed_literals(p)) for p in (r"a[bc]d|xyz", r"(?i)Api_?key", r"\w+", r"re(cv|ad)+", r"(x|\d)yy")] == [["abd", "acd", "xyz"], ["api"], [], ["re"], ["yy"]]
    texts = ["os.system(x)", "OS.SYSTEM", "res.redirect(req.query.u)", "app.get('/x', isAdmin, h)", "db.query('a' + b)", "eval", "open\n", "", None, "Ünïcode API_KEY = 'abcdefghijklmnop'", "plain prose of no interest", "popen recv read SHA1 SHA12"]
    for rule in RULES:
        for text in filter(None, texts):
            assert not re.search(rule[3], text) or any(x in text.lower() for x in rules.needed_literals(rule[3]))
    sets = {f"{a}_{b}_{k}": rules.rules(a, b, k) for a, b, k in dict.fromkeys(r[:3] for r in RULES)} | {"none": [], "free": [rules.Rule(r"^\w+$", "any"), rules.Rule("popen", "p")]}
    rows = spark.createDataFrame([(k, t, "eval" if k % 2 else None) for k, t in enumerate(texts)], "id int, code string, name string")
    columns = [F.col("code"), F.col("name")]
    want = {r.id: r for r in rows.select("id", *[rules.first_match(given, *columns).alias(n) for n, given in sets.items()]).collect()}
    for singly in (10**6, 0):  # one by one, and by an automaton
        rules.SINGLY, before = singly, rules.SINGLY
        try:
            got = {r.id: r for r in rules.marked(rows, sets, "code", "name").collect()}
        finally:
            rules.SINGLY = before
        assert all(got[i][n] == want[i][n] for i in want for n in sets)


@pytest.mark.parametrize("singly", [10**6, 0])
def test_a_filter_on_marks_searches_texts_once(spark, singly, monkeypatch):
    """A filter on marks stays above the search, one by one or by an automaton, and takes the same rows."""
    monkeypatch.setattr(rules, "SINGLY", singly)
    rows = spark.createDataFrame([(1, "a TOKEN"), (2, "popen x"), (3, "plain"), (4, None)], "id int, code string")
    found = rules.marked(rows, {"one": [rules.Rule("(?i)token", "t")], "two": [rules.Rule("popen", "p"), rules.Rule("x$", "x")]}, "code").filter("one is not null or two is not null")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(concat_ws(" if singly else "ArrowEvalPython") == 1
    assert sorted(map(tuple, found.collect())) == [(1, "a TOKEN", 0, None), (2, "popen x", None, 0)]


def test_lines_cut_a_text_once(spark):
    rows = spark.createDataFrame([("a\r\nb\rc\x0bd\x1ce\x85f\u2028g\u2029\n\n",), ("\n",), ("",), (None,)], "x string")
    df = rows.select(text.lines(F.col("x")).alias("l"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r.l for r in df.collect()] == [["a", "b", "c", "d", "e", "f", "g", "", ""], [""], [], None]
