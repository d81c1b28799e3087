"""The symbol index: definitions, references and tests, and what look-ups read."""

from pyspark.sql import functions as F

from palisade.operators import project as P
from palisade.operators import symbols as Y

FILES = [
    ("src/auth.ts", "export function login(u) { return u; }\nexport class Guard {}\nconst check = (x) => { return login(x); };\n", "typescript"),
    ("src/app.ts", "import { login } from './auth';\nimport { Guard } from './auth';\n// LOGIN here\nlogin(1); login(2);\nconst loginx = 'login';\n", "typescript"),
    ("py/a.py", "class A:\n    pass\ndef run(): pass\ndef run(): pass\n", "python"), ("py/b.py", "from .a import run, A\nrun()\n", "python"), ("py/c.py", None, "python"),
    ("tests/auth.test.ts", "import { login } from '../src/auth';\n" + "login();\n" * 8, "typescript"), ("src/other.spec.js", "describe('login')", "javascript"), ("py/test_a.py", "run()", "python"), ("tests/test_b.py", "x", "python"), ("deep/x_test.py", "run\nrun", "python"),
]


def test_definitions_and_references(spark):
    files = spark.createDataFrame(FILES, "path string, text string, lang string").selectExpr("*", "1 AS name", "2 AS line")
    ix = P.index(files)
    asked = [("src/auth.ts", "login"), ("src/app.ts", "login"), ("src/app.ts", "Guard"), ("src/auth.ts", "check"), ("py/b.py", "run"), ("py/a.py", "A"), ("py/b.py", "nothing"), ("py/b.py", "run"), ("none.ts", "login")]
    queries = spark.createDataFrame(asked, "path string, symbol string")
    got = {(r.path, r.symbol): (r.target, r.line, r.confidence) for r in Y.find_definition(ix, queries).collect()}
    assert got == {
        ("src/auth.ts", "login"): ("src/auth.ts", 1, 0.8), ("src/app.ts", "login"): ("src/auth.ts", 1, 0.7), ("src/app.ts", "Guard"): ("src/auth.ts", 2, 0.7), ("src/auth.ts", "check"): ("src/auth.ts", 3, 0.8),
        ("py/b.py", "run"): ("py/a.py", 3, 0.7), ("py/a.py", "A"): ("py/a.py", 1, 0.8),
    }
    found = Y.find_references(Y.postings(files), queries.where("symbol in ('login', 'run')"), most=5)
    rows = sorted((r.path, r.symbol, r.target, r.line, r.confidence) for r in found.collect())
    assert [r[2:] for r in rows if r[0] == "src/app.ts"] == [("src/app.ts", 1, 0.9), ("src/app.ts", 3, 0.9), ("src/app.ts", 4, 0.9), ("src/app.ts", 5, 0.9), ("src/auth.ts", 1, 0.9)]
    assert [r[2:] for r in rows if r[0] == "py/b.py"] == [("deep/x_test.py", 1, 0.6), ("deep/x_test.py", 2, 0.6), ("py/a.py", 3, 0.6), ("py/a.py", 4, 0.6), ("py/b.py", 1, 0.6)]


def test_tests_by_name_and_symbol(spark):
    files = spark.createDataFrame(FILES, "path string, text string, lang string")
    queries = spark.createDataFrame([("src/auth.ts", "login"), ("src/auth.ts", None), ("py/a.py", "run"), ("py/b.py", None), ("src/none.ts", "zzz")], "path string, symbol string")
    got = {}
    for r in Y.find_tests(files, Y.postings(files), queries).orderBy("rank").collect():
        got.setdefault((r.path, r.symbol), []).append((r.test, r.how, r.confidence, r.lines))
    assert got == {
        ("src/auth.ts", "login"): [("tests/auth.test.ts", "naming", 0.9, []), ("src/other.spec.js", "symbol", 0.7, [1])], ("src/auth.ts", None): [("tests/auth.test.ts", "naming", 0.9, [])],
        ("py/a.py", "run"): [("py/test_a.py", "naming", 0.9, []), ("deep/x_test.py", "symbol", 0.7, [1, 2])], ("py/b.py", None): [("tests/test_b.py", "naming", 0.9, [])],
    }
    one = Y.find_tests(files, Y.postings(files), spark.createDataFrame([("q.ts", "login")], "path string, symbol string")).where("test = 'tests/auth.test.ts'").first()
    assert one.lines == [1, 2, 3, 4, 5] and one.previews[1] == "login();"
    assert spark.createDataFrame([("a.test.ts",), ("x/b.spec.mjs",), ("test_a.py",), ("a_test.py",), ("test.ts",), ("atest.py",)], "p string").where(Y.is_test(F.col("p"))).count() == 4


def test_look_ups_read_their_buckets(spark, tmp_path):
    files = spark.createDataFrame([(f"f{k}", " ".join(f"n{k}_{j}" for j in range(30)) + "\ncommon") for k in range(20)], "path string, text string")
    folder = str(tmp_path / "index")
    Y.write_index(files, folder, buckets=16)
    whole = Y.read_index(spark, folder)
    assert whole.count() == Y.postings(files).count() == 620
    some = Y.read_index(spark, folder, ["n3_4", "Common", "absent"], buckets=16)
    assert sorted((r.name, r.path, r.line) for r in some.collect()) == sorted([("n3_4", "f3", 1)] + [("common", f"f{k}", 2) for k in range(20)])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(name" in plan


def test_dynamic_patterns(spark):
    js = "const m = require(mod);\nimport(name);\nconst lib = require(`./lib/${process.env.LIB}`);\napp.use(require(process.env.MIDDLEWARE));\nconst fn = new Function('a', 'return a');\nconst r = eval(mod);\nrequire('x'); eval('1'); import('y');\nif (a) { require(b); }\nconst gs = glob.sync('*');\nrequire(gs);\nvm.runInThisContext(code);\n"
    ix = P.index(spark.createDataFrame([("d.js", js, "javascript")], "path string, text string, lang string"))
    got = sorted((r.line, r.type) for r in Y.dynamic_patterns(ix).collect())
    assert got == [(1, "D1"), (2, "D2"), (3, "D3"), (4, "D1"), (4, "D4"), (5, "D6"), (6, "D9"), (8, "D8"), (10, "D10"), (11, "D7")]


def test_named_tests_are_the_candidates(spark):
    paths = ["src/a.ts", "src/a.py", "tests/a.ts", "/a.ts", "/a.py", "a.ts", "a//a.js", ".ts", "Makefile", "src/a.b.ts", "x/spec/a.tsx", "x/A.ts", "test/a.py", "x.PY", "d\ne/a.ts"]
    asked = spark.createDataFrame([(p, s) for p in paths for s in ("s", None)], "path string, symbol string")
    want = {(r.path, r.symbol): r.c for r in asked.select("*", Y.test_candidates(F.col("path")).alias("c")).collect()}
    some = sorted({c for cs in want.values() for c in cs[::3]}) + ["/a.test.ts", "/test_a.py", "a/a.test.js", "src/a.test.py", "src/test_a.py\n", "other/a.test.ts"]
    got = {(r.path, r.symbol): r.named for r in Y.named_tests(spark.createDataFrame([(c,) for c in some + some[:9]], "path string"), asked).collect()}
    assert got == {k: [c for c in cs if c in set(some)] for k, cs in want.items()} and any(len(v) > 5 for v in got.values())


def test_a_query_makes_no_row_for_each_name_and_hit(spark):
    """However many names a test may have and tests hold the symbol, no step has more rows than queries have tests to tell."""
    n = 150
    files = spark.createDataFrame([(f"src/m{k}.ts", "") for k in range(n)] + [(f"tests/m{k}.test.ts", "same") for k in range(n)], "path string, text string")
    df = Y.find_tests(files, Y.postings(files), files.where("path like 'src/%'").selectExpr("path", "'same' AS symbol"))
    rows = df.collect()
    assert len(rows) == 30 * n and all((r.test == f"tests/{r.path[4:-3]}.test.ts") == (r["rank"] == 1) == (r.how == "naming") for r in rows)
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        children = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
        todo += children
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
    assert 0 < most <= 30 * n
