"""Syntax tables and the taint fixpoint: golden flows from joins alone."""

import pytest
from pyspark.sql import functions as F

from palisade.operators import dataflow as D
from palisade.operators import syntax as S

FLOWS = [
    ("javascript", "const q = req.body.q;\nexec(q);", [("req.body.q", "exec", 2)]),
    ("javascript", 'const id = req.body.id;\ndb.query("SELECT * FROM t WHERE id = " + id);', [("req.body.id", "sql-concat", 2)]),
    ("javascript", "const id = req.body.id;\ndb.query(`SELECT ${id}`);", [("req.body.id", "sql-concat", 2)]),
    ("javascript", "db.query(`SELECT ${req.body.id}`)", [("req.body.id", "sql-concat", 1)]),
    ("javascript", 'const q = req.query.id;\nconst id = parseInt(q);\ndb.query("SELECT " + id)', []),
    ("javascript", "const url = req.query.url;\nfetch(url);", [("req.query.url", "ssrf-fetch", 2)]),
    ("javascript", "const { name } = req.body;\nexec(name);", [("req.body", "exec", 2)]),
    ("python", "q = request.args['q']\nos.system('ls ' + q)", [("request.args['q']", "os.system", 2)]),
    ("python", "n = int(request.args['n'])\nos.system(n)", []),
    ("python", "cursor.execute(f\"select {request.GET}\")", [("request.GET", "cursor-execute", 1)]),
]

SINKS = [
    ("javascript", "exec('ls')", ["exec"]),
    ("javascript", "const eval_ = 1; // eval(x)\nconst s = 'eval(x)';", []),
    ("javascript", "db.query('select 1')", []),
    ("javascript", "db.query('select ' + x)", ["sql-concat"]),
    ("javascript", "el.innerHTML = x;", ["innerHTML"]),
    ("javascript", "el.innerHTML = 'x';", []),
    ("tsx", "<div dangerouslySetInnerHTML={{__html: x}} />", ["dangerouslySetInnerHTML"]),
    ("javascript", "fetch(url)", []),
    ("javascript", "const url = req.query.url; fetch(url)", ["ssrf-fetch"]),
    ("python", "pickle.loads(x)\nhashlib.md5(x)", ["pickle-loads", "py-md5"]),
    ("python", "open('a.txt')", []),
    ("python", "open(name)", ["py-open"]),
]

FILES = {
    "src/routes.js": "import { run } from './handler';\nimport * as safe from './safe';\nexport function post(req) {\n  const cmd = req.body.cmd;\n  run('x', cmd);\n  safe.run(cmd, 1);\n  show(req.query.html);\n}\nfunction show(h) { document.write(h); }\n",
    "src/handler.js": "import { execute } from './lib/shell';\nexport function run(name, c) {\n  log(name);\n  execute(c);\n}\n",
    "src/lib/shell.js": "export const execute = (line) => { exec(line); };\n",
    "src/safe.js": "export function run(a, b) { return parseInt(a); }\n",
    "app/views.py": "from .tools import call\n\ndef view(request):\n    call(request.args.get('q'))\n\ndef current():\n    return request.args.get('u')\n",
    "app/tools.py": "import os\n\ndef call(q):\n    os.system(q)\n",
}

#: text, language, sinks expected (source, sink, line).
MORE = [
    ("function getInput(req) {\n  return req.body.q;\n}\nconst q = getInput(req);\nexec(q);", "javascript", [("req.body.q", "exec", 5)]),
    ("const q = req.body.q;\nconst url = req.query.url;\nexec(q);\nres.redirect(url);", "javascript", [("req.body.q", "exec", 3), ("req.query.url", "res.redirect", 4)]),
    ("q = request.GET.get('q')\nos.system(q)", "python", [("request.GET.get", "os.system", 2)]),
    ("q = request.GET.get('q')\nid = int(q)\ncursor.execute('a' + str(id))", "python", []),
    ("const q = 'hello';\nexec(q);", "javascript", []),
    ("const x = req.body;\nexec(x.q);", "javascript", [("req.body", "exec", 2)]),
    ("function h(req) {\n  const id = req.params.id;\n  const a = id;\n  const b = 'x' + a;\n  exec(b);\n}", "javascript", [("req.params.id", "exec", 5)]),
    ("exec(q);\nconst q = req.body.q;", "javascript", []),
    ("let a = req.body.a, b = 1;\nexec(b);\nexec(a);", "javascript", [("req.body.a", "exec", 3)]),
    ("let a = req.body.a\nlet b = a\n  .trim()\nel.innerHTML = b", "javascript", [("req.body.a", "innerHTML", 4)]),
    ("app.post('/x', (req, res) => {\n  const c = req.body.c;\n  run(wrap(c), () => { exec(other); });\n  db.query(String(wrap(c)));\n});", "javascript", [("req.body.c", "sql-concat", 4)]),
    ("const a = safe(parseInt(req.body.a));\nexec(a);\nexec(`${encodeURI(req.query.b)} ${1}`);", "javascript", []),
    ("def f(a):\n    a = 1\n    return a\nx = request.args.get('x')\ny = f(x)\nos.system(y)\n", "python", [("request.args.get", "os.system", 6)]),
    ("const run = (x) => exec(x);\nitems.map(x => exec(x));\nrun(req.body.r);\nlet x = 2", "javascript", [("req.body.r", "exec", 1)]),
    ("function f(p) { return f(p); }\nconst a = f(req.body.z);\nexec(a);", "javascript", [("req.body.z", "exec", 3)]),
]


@pytest.fixture(scope="module")
def flows(spark):
    rows = [(f"a{i}", t, lang) for i, (lang, t, _) in enumerate(FLOWS)] + [(f"b{i}", t, lang) for i, (t, lang, _) in enumerate(MORE)]
    rows += [(p, t, "python" if p.endswith("py") else "javascript") for p, t in FILES.items()] + [("none.js", None, "javascript"), ("empty.js", "", "javascript"), ("odd.js", ")}](( ` ' {", "javascript"), ("x.rb", "exec(req.body)", "ruby")]
    files = spark.createDataFrame(rows, "path string, text string, lang string").selectExpr("*", "1 AS at", "'x' AS fn", "2 AS line")
    return D.taint(files).collect()


@pytest.mark.parametrize("k", range(len(FLOWS)))
def test_golden_flows(flows, k):
    assert [(r.source, r.sink, r.line) for r in flows if r.path == f"a{k}"] == FLOWS[k][2]


@pytest.mark.parametrize("k", range(len(MORE)))
def test_more_flows(flows, k):
    assert sorted((r.source, r.sink, r.line) for r in flows if r.path == f"b{k}") == sorted(MORE[k][2])


def test_flows_across_files(flows):
    got = {(r.s_path, r.s_line, r.path, r.sink, r.hops) for r in flows if "/" in r.path}
    assert got == {("src/routes.js", 4, "src/lib/shell.js", "exec", 2), ("src/routes.js", 4, "src/handler.js", "sql-exec", 1), ("app/views.py", 4, "app/tools.py", "os.system", 1)}
    assert not [r for r in flows if r.path in ("none.js", "empty.js", "odd.js", "x.rb")]


def test_depth_limits_calls(spark):
    chain = "exec(x)"
    text = "".join(f"function f{k}(x) {{ {f'f{k - 1}(x)' if k else chain}; }}\n" for k in range(6))
    files = spark.createDataFrame([(f"s{n}.js", text + f"f{n}(req.body.q);\n", "javascript") for n in range(5)], "path string, text string, lang string")
    assert {(r.path, r.hops) for r in D.taint(files).collect()} == {("s0.js", 1), ("s1.js", 2), ("s2.js", 3)}


def test_fixpoint_against_a_sequential_fold(spark):
    import random

    rng, rows, want = random.Random(4), [], set()
    for n in range(25):
        held, lines = set(), []
        for k in range(rng.randrange(1, 60)):
            a, b, kind = rng.randrange(6), rng.randrange(6), rng.randrange(5)
            lines.append([f"v{a} = req.body.x;", f"v{a} = v{b} + 1;", f"v{a} = Number(v{b});", f"eval(v{a});", f"if (v{b}) {{ v{a} = [v{b}, 1]; }}"][kind])
            if kind == 0 or kind in (1, 4) and b in held:
                held.add(a)
            if kind == 3 and a in held:
                want.add((f"r{n}.js", k + 1))
        rows.append((f"r{n}.js", "\n".join(lines), "javascript"))
    got = D.taint(spark.createDataFrame(rows, "path string, text string, lang string")).collect()
    assert {(r.path, r.line) for r in got} == want != set()


def test_gated_sinks(spark):
    extra = [
        ("python", "def f(x):\n    try:\n        eval(x)\n    except E:\n        pass\n    os.system(x)", [("eval", "f", True), ("os.system", "f", False)]),
        ("javascript", "function handleRequest(q) { try { exec(q); } catch (e) { spawn(e); } }\neval(1);", [("exec", "handleRequest", True), ("eval", None, False)]),
        ("javascript", "exec(a); spawn(b);\nexec(c);", [("exec", None, False), ("exec", None, False)]),
        ("javascript", "db.query(() => 1); db.query(['a']); knex.raw(`x`);", []),
        ("javascript", "const f = () => { db.query(`a ${b}`); };", [("sql-concat", "f", False)]),
    ]
    rows = [(f"a{i}", t, lang) for i, (lang, t, _) in enumerate(SINKS)] + [(f"b{i}", t, lang) for i, (lang, t, _) in enumerate(extra)]
    found = D.sinks(spark.createDataFrame(rows, "path string, text string, lang string")).collect()
    for i, (_, text, want) in enumerate(SINKS):
        assert [r.sink for r in sorted((r for r in found if r.path == f"a{i}"), key=lambda r: r.line)] == want, text
    for i, (_, text, want) in enumerate(extra):
        assert sorted([(r.sink, r.function, r.in_try) for r in found if r.path == f"b{i}"], key=str) == sorted(want, key=str), text


def test_enclosing_is_the_innermost_interval(spark):
    import random

    rng = random.Random(2)
    intervals, points = [], []

    def nest(path, lo, hi):
        while hi - lo > 2 and rng.random() < 0.8:
            a = rng.randrange(lo, hi - 1)
            b = rng.randrange(a + 1, hi)
            intervals.append((path, a, b, f"{a}-{b}"))
            nest(path, a + 1, b)
            lo = b + 1

    for path in "abc":
        nest(path, 0, 80)
        points += [(path, k, k * 2) for k in range(-1, 82)]
    ivs = spark.createDataFrame(intervals, "path string, first int, last int, name string")
    got = {(r.path, r.at): r.in_name for r in S.enclosing(spark.createDataFrame(points, "path string, at int, extra int"), ivs, ["name"]).collect()}
    for path, k, _ in points:
        around = [(a, n) for p, a, b, n in intervals if p == path and a < k < b]
        assert got[path, k] == (max(around)[1] if around else None)


def test_tokens_cover_the_text(spark):
    text = "const a = `x${ b + `y` }z` // c\n/* d\n e */ f('\\'(', \"}\")\nreturn 'unended"
    toks = S.tokens(spark.createDataFrame([("p", text, "javascript")], "path string, text string, lang string")).orderBy("at").collect()
    assert [t.text for t in toks][:12] == ["const", "a", "=", "`(", "${", "b", "+", "`y`", "}$", ")`", "f", "("]
    assert {t.text: t.line for t in toks}["f"] == 3 and {t.text: t.line for t in toks}["return"] == 4
    long = spark.createDataFrame([("q", "x = '" + "a\\'" * 60000 + "';\n" + "`" + "b" * 90000 + "`;" + "(" * 500 + ")" * 500, "javascript")], "path string, text string, lang string")
    assert S.brackets(S.tokens(long)).count() == 500
    assert S.tokens(long.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_fixes_by_their_differences(spark):
    bad = "function f(req) {\n  const q = req.body.q;\n  exec(q);\n}\nfunction g() {}\n"
    rows = [
        ("good", "javascript", "command_injection", bad, "function f(req) {\n  const q = parseInt(req.body.q);\n  run(q);\n}\nfunction g() {}\n"),
        ("same", "javascript", "command_injection", bad, bad),
        ("new", "javascript", "command_injection", bad, "function f(req) {\n  const q = req.body.q;\n  db.query('a' + q);\n}\n"),
        ("broken", "javascript", "command_injection", bad, "function f(req) {\n  run(1;\n}\n"),
        ("any", "javascript", None, bad, "function f(req) {\n}\nfunction g() {}\n"),
        ("none", "javascript", None, "const a = 1;", "const a = 2;"),
        ("null", "python", "ssti", None, None),
    ]
    got = {r.id: (r.passes, r.syntax_valid, r.effective, r.new_sinks, r.new_flows, r.gone_sinks, r.gone_flows, r.functions_removed) for r in D.fix_tests(spark.createDataFrame(rows, "id string, lang string, type string, before string, after string")).collect()}
    assert got == {
        "good": (True, True, True, 0, 0, 1, 1, []), "same": (False, True, False, 0, 0, 0, 0, []), "new": (False, True, True, 1, 1, 1, 1, ["g"]), "broken": (False, False, True, 0, 0, 1, 1, ["f", "g"]),
        "any": (True, True, True, 0, 0, 1, 1, []), "none": (True, True, False, 0, 0, 0, 0, []), "null": (False, True, False, 0, 0, 0, 0, []),
    }
