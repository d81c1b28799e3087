"""Endpoints, guards, paths and redaction against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from palisade.functions import paths, text
from palisade.operators import endpoints as E
from palisade.operators import state


def values(spark, rows, column, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").select("i", column.alias("v")).orderBy("i").select("v").collect()]


def test_endpoints_by_first_pattern(spark):
    lines = ["export async function GET(req) {", "app.post('/a', f)", 'router.all("/b")', "@router.delete(`/c`)", "@app.route('/d')", "re_path('^e$', v)", "fetch('/f')", None]
    got = E.endpoints(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line int, text string")).orderBy("line").collect()
    assert [(r.line, r.method, r.path, r.framework) for r in got] == [(0, "GET", "", "nextjs"), (1, "POST", "/a", "express"), (2, "*", "/b", "express"), (3, "DELETE", "/c", "express"), (4, "*", "/d", "flask"), (5, "*", "^e$", "django")]


def test_routes_of_files_and_their_parameters(spark):
    x = F.col("x")
    files = ["app/api/products/[id]/route.ts", "src/app/(shop)/@modal/cart/route.tsx", "app/route.js", "pages/api/orders/[id].ts", "pages/api/users/index.tsx", "lib/x.ts"]
    assert values(spark, files, E.file_route(x)) == ["/api/products/[id]", "/cart", "/", "/api/orders/[id]", "/api/users", None]
    got = values(spark, ["/a/[id]/[...rest]", "/[[...slug]]", "<int:pk>/<slug>/<int:pk>", "/plain"], E.path_params(x))
    assert [[tuple(p) for p in ps] for ps in got] == [[("id", False), ("rest", False)], [("slug", False)], [("pk", True), ("slug", False)], []]
    covers = lambda route, m: values(spark, [route], E.matcher_covers(x, F.lit(m)))[0]
    assert [covers("/dash", "/dash/:path*"), covers("/dash/x", "/dash/:path*"), covers("/dashboard", "/dash/:path*"), covers("/a", "/a"), covers("/a/b", "/a")] == [True, True, False, True, False]
    assert values(spark, ["/x", "x", "/", "?"], E.mounted(F.lit("/api/"), x)) == ["/api/x", "/api/x", "/api/", "/api/"]


@pytest.mark.parametrize(("folder", "target", "want"), [("src/a", "src/b/c.ts", "../b/c"), ("src", "src/x.js", "./x"), ("tests/unit", "lib/x.py", "../lib/x.py"), ("", "a.mjs", "./a"), ("a/b/c", "a/b/d.tsx", "../d")])
def test_import_path(spark, folder, target, want):
    assert values(spark, [target], E.import_path(F.lit(folder), F.col("x"))) == [want]


def test_libraries_by_import(spark):
    x, kind = F.col("x"), "array<string>"
    assert values(spark, [["left", "@prisma/client"], ["django.db"], ["knexish"], ["knex"], [], None], E.data_layer(x), kind) == ["prisma", "django-orm", "none", "knex", "none", "none"]
    assert values(spark, [["zod/v4"], ["zodiac"], ["pydantic.main"]], E.validator_library(x), kind) == ["zod", "none", "pydantic"]
    assert values(spark, [["jsonwebtoken"], ["authlib.x"], []], E.file_auth(x, F.lit("req.headers['x-api-key']")), kind) == ["jwt", "oauth", "api-key"]


def test_response_shapes(spark):
    code = ["res.status(200).json({})", "res.send(x); res.redirect('/')", "return render(request, 't')", "return jsonify(a=1)", "x.json()", "reply.sendFile('a')", None]
    assert values(spark, code, E.response_shape(F.col("x"))) == ["json", "redirect", "html", "json", "unknown", "file", "unknown"]


GUARDS = [
    ("function sanitize(x) { return parseInt(x, 10); }", "javascript", "sanitizer-numeric", "sql_injection", True),
    ("function escapeHtml(x) { return escape(x); }", "javascript", "sanitizer-html", "sql_injection", False),
    ("function escapeHtml(x) { return escape(x); }", "javascript", "sanitizer-html", "xss", True),
    ('function safe(db, id) {\n  return db.query("SELECT * FROM users WHERE id = ?", [id]);\n}', "javascript", "parameterized-query", "sql_injection", True),
    ("function a(req) { jwt.verify(req.headers.authorization, SECRET, { algorithms: ['HS256'] }); }", "javascript", "auth-jwt-verify", "broken_access_control", False),
    ("function a(req) { jwt.verify(req.headers.authorization, SECRET); }", "javascript", "auth-jwt-verify-noalg", "broken_access_control", False),
    ("function a(req, res) { if (!req.session.user) return res.status(401).send(); }", "javascript", "auth-session", "broken_access_control", False),
    ("function a(req) { if (!req.headers['x-api-key']) throw 1; }", "javascript", "auth-api-key", "broken_access_control", False),
    ("function a(x) { if (['a', 'b'].includes(x)) return x; }", "javascript", "allowlist-literal", "sql_injection", True),
    ("function a(x) { if ([p, q].includes(x)) return x; }", "javascript", "allowlist-dynamic", "sql_injection", False),
    ("app.use(cors({ origin: '*' }))", "javascript", "cors-permissive", "broken_access_control", False),
    ("def f(x):\n    if x in ('a', 'b'):\n        return x", "python", "allowlist-literal", "command_injection", True),
    ("def f(c, x):\n    c.execute(\"SELECT 1 WHERE a = %s\", [x])", "python", "parameterized-query", "sql_injection", True),
    ("def f(a, b):\n    return hmac.compare_digest(a, b)", "python", "auth-api-key", "broken_access_control", False),
    ("function a() { return 1; }", "javascript", "unknown", "xss", False),
]


def test_guards_and_what_they_stop(spark):
    attacks = sorted({g[3] for g in GUARDS})
    df = spark.createDataFrame([(i, *g[:2]) for i, g in enumerate(GUARDS)], "i int, text string, language string")
    got = {(r.i, r.attack): r for r in E.guard_verdicts(df, attacks).collect()}
    for i, (_, _, kind, attack, effective) in enumerate(GUARDS):
        r = got[i, attack]
        assert (r.guard_type, r.effective) == (kind, effective), (i, r)
        assert effective or kind in ("unknown",) or r.bypass, r
    assert got[len(GUARDS) - 1, "xss"].reason == "Guard detected as 'unknown' but effectiveness against xss is unknown" and got[len(GUARDS) - 1, "xss"].bypass is None
    assert got[2, "xss"].reason == """HTML escaping escapes <, >, ", ', & — prevents script injection""" and got[2, "xss"].bypass is None
    assert got[2, "sql_injection"].reason == "Guard type 'sanitizer-html' is NOT effective against sql_injection"
    assert got[2, "sql_injection"].bypass == "escapeHtml doesn't stop SQLi: q' OR 1=1-- is valid HTML"
    assert got[11, "command_injection"].reason == "Guard type 'allowlist-literal' is effective against command_injection"


def test_ignore_files_and_secret_names(spark):
    patterns = paths.ignore_patterns("# no\nbuild/\n\nsrc/a.ts\nvendor\nbuild/\n")
    assert patterns == ["build/", "src/a.ts", "vendor"]
    names = ["build/x.ts", "src/a.ts", "src/a.tsx", "vendor/q/z.js", "vendors/z.js"]
    assert values(spark, names, paths.ignored(F.col("x"), patterns)) == [True, True, False, True, False]
    names = ["a/.env", ".env.local.bak", "certs/S.PEM", "id_rsa", "keys.ts", ".key", "a/credentials"]
    assert values(spark, names, paths.secret_file(F.col("x"))) == [True, True, True, True, False, False, True]


def test_neighbouring_secrets_are_all_redacted(spark):
    a, b = "a" * 40, "b" * 40
    rows = [f"{a} {b}", f"{a},{b};{'c' * 33}", "Authorization: bearer abc.def eyJa.b.c me@x.org,you@y.org", "x" * 64]
    assert values(spark, rows, text.replaced(F.col("x"), text.REDACT_A)) == ["[REDACTED] [REDACTED]", f"[REDACTED],[REDACTED];{'c' * 33}", "Authorization: Bearer [REDACTED] [JWT_REDACTED] [EMAIL_REDACTED],[EMAIL_REDACTED]", "[REDACTED]"]
    rows = ["A <a@b.c> and d@e.org.", "SK-" + "x" * 20, "xoxb-1-2 xoxq-1", "AKIA" + "A" * 16 + " AKIA" + "B" * 16, "ghp_" + "z" * 36]
    assert values(spark, rows, text.replaced(F.col("x"), text.REDACT_B)) == ["A <redacted> and redacted@email.", "sk-REDACTED", "xox-REDACTED xoxq-1", "AKIA-REDACTED AKIA-REDACTED", "ghp-REDACTED"]


def test_versions_of_any_length(spark):
    x = F.col("x")
    got = spark.createDataFrame([("1.2.3.4.5.6.7",), ("1.2.3.4.5.6.10",), ("1.2",), ("1.2.0",), ("1.10",), ("20240101123456789012.1",)], "x string").select("x", text.version_key(x).alias("k")).orderBy("k", "x").collect()
    assert [r.x for r in got] == ["1.2", "1.2.0", "1.2.3.4.5.6.7", "1.2.3.4.5.6.10", "1.10", "20240101123456789012.1"] and got[0].k == got[1].k


def test_line_ranges(spark):
    got = [E.read_lines(F.col("x"), F.lit(a), F.lit(b)) for a, b in ((2, 3), (0, 1), (3, 99), (5, 6), (None, None))]
    assert [values(spark, ["a\nb\nc"], c)[0] for c in got] == ["b\nc", "a", "c", "", "a\nb\nc"]


def test_queue_decisions_and_false_positives(spark):
    queue = spark.createDataFrame([("k1", "xss", "e1"), ("k2", "ssrf", "e2"), ("k3", "xss", "e3")], "key string, finding string, evidence string")
    said = spark.createDataFrame([("k1", "accepted", "r", 1), ("k1", "rejected", "no", 2), ("k2", "accepted", "ok", 1)], "key string, decision string, reason string, at int")
    done = state.decided(queue, said, ["key"])
    assert {r.key: (r.decision, r.decision_reason) for r in done.collect()} == {"k1": ("rejected", "no"), "k2": ("accepted", "ok"), "k3": ("pending", None)}
    assert [r.key for r in state.cleared(done, True).collect()] == ["k3"] and state.cleared(done, False).count() == 0
    assert [r.key for r in state.false_positives(done, ["key"], "finding", "evidence").collect()] == ["k1"]


def test_regression_gate_names_its_reasons(spark):
    kind = "precision double, recall double, completion double, cases long"
    row = lambda *x: spark.createDataFrame([x], kind)
    r = state.regression(row(0.9, 0.8, 1.0, 4), row(0.85, 0.79, 0.96, 5)).first()
    assert (r.verdict, r.reasons) == ("fail", "precision dropped, completion dropped, cases mismatch")
    assert state.regression(row(0.9, 0.8, 1.0, 4), row(0.89, 0.9, 0.98, 4)).first().verdict == "pass"
