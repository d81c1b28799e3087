"""Routes, mounts, guards, schemas and endpoints of small projects."""

import pytest
from pyspark.sql import functions as F

from palisade.operators import project as P

EXPRESS = """const express = require('express');
const router = express.Router();
const { PrismaClient } = require('@prisma/client');
const prisma = new PrismaClient();

const auth = (req, res, next) => {
  if (!req.headers['x-api-key']) return res.status(401).json({ error: 'No token' });
  next();
};

router.get('/users/:id', auth, async (req, res) => {
  const user = await prisma.user.findUnique({ where: { id: req.params.id } });
  res.json(user);
});

router.post('/users', async (req, res) => {
  const { email, name } = req.body;
  const user = await prisma.user.create({ data: { email, name } });
  res.status(201).json(user);
});

module.exports = router;
"""
FILES = {
    "app.js": "const users = require('./routes/users');\nconst v1 = require('./routes/v1');\nconst { requireAuth } = require('./lib/guard');\napp.use(cors());\napp.use('/api', requireAuth);\napp.use('/api/v1', limiter, v1);\napp.use('/public', users);\napp.use('/late', makeGuard() || x);\napp.get('/health', (req, res) => res.send('ok'));\n",
    "routes/users.js": EXPRESS,
    "routes/v1.js": "import items from './items';\nconst BASE = '/stats';\nrouter.use('/items', items);\nrouter.get(BASE, stats);\nfunction stats(req, res) { log(1); log(2); res.json(count()); }\n",
    "routes/items.js": "import v1 from './v1';\nimport { show } from '../lib/views';\nrouter.use('/again', v1);\nrouter.get('/:id', show);\nrouter.all(`/any`, checkSession, (q, r) => { r.redirect('/'); });\nfunction checkSession(req) { return req.session.user; }\n",
    "lib/guard.js": "import jwt from 'jsonwebtoken';\nexport function requireAuth(req, res, next) { jwt.verify(req.headers.a, KEY); next(); }\n",
    "lib/views.js": "export const show = (req, res) => { res.render('x'); };\n",
    "api/main.py": "from fastapi import APIRouter, Depends\nfrom .security import current\n\nrouter = APIRouter(dependencies=[Depends(nothing)])\n\n@router.get('/me')\n@cached\ndef me(user = Depends(current)):\n    return find(user)\n\n@router.post('/open')\nasync def open_(x: int):\n    return x\n",
    "api/security.py": "def current(request):\n    return request.cookies.get('s')\n",
    "site/urls.py": "from . import views\nurlpatterns = [\n    path('articles/', views.articles),\n    re_path(r'^x$', views.other),\n]\n",
    "site/views.py": "@login_required\n@require_http_methods(['POST'])\ndef articles(request):\n    return render(request, 'a')\n\ndef other(request):\n    return JsonResponse({})\n",
    "web/app/api/notes/[id]/route.ts": "export async function GET(req) {\n  return NextResponse.json(await load(req));\n}\nfunction POST() {}\n",
    "none.js": None,
}


@pytest.fixture(scope="module")
def ix(spark):
    rows = [(p, t, "python" if p.endswith("py") else "javascript") for p, t in FILES.items()]
    return P.index(spark.createDataFrame(rows, "path string, text string, lang string").selectExpr("*", "1 AS line", "'x' AS name"))


def test_mounts_compose_along_files(ix):
    got = {(r.path, r.prefix, r.by) for r in P.mounts(ix).collect()}
    assert got == {("routes/users.js", "/public", "app.js"), ("routes/v1.js", "/api/v1", "app.js"), ("routes/items.js", "/api/v1/items", "routes/v1.js")}


def test_endpoints(spark, ix):
    edge = spark.createDataFrame([("/api/notes/:path*", "jwt")], "matcher string, auth string")
    got = {(r.path, r.method, r.route): r for r in P.project_endpoints(ix, edge).collect()}
    brief = {k: (r.mounted, r.handler, r.auth, r.response) for k, r in got.items()}
    assert brief == {
        ("app.js", "GET", "/health"): (None, "<anonymous>", "none", "text"),
        ("routes/users.js", "GET", "/users/:id"): ("/public/users/:id", "<anonymous>", "api-key", "json"),
        ("routes/users.js", "POST", "/users"): ("/public/users", "<anonymous>", "api-key", "json"),
        ("routes/v1.js", "GET", "/stats"): ("/api/v1/stats", "stats", "jwt", "json"),
        ("routes/items.js", "GET", "/:id"): ("/api/v1/items/:id", "show", "jwt", "html"),
        ("routes/items.js", "ALL", "/any"): ("/api/v1/items/any", "<anonymous>", "jwt", "unknown"),
        ("api/main.py", "GET", "/me"): (None, "me", "session", "json"),
        ("api/main.py", "POST", "/open"): (None, "open_", "none", "json"),
        ("site/urls.py", "POST", "articles/"): (None, "articles", "session", "html"),
        ("site/urls.py", "GET", "^x$"): (None, "other", "none", "json"),
        ("web/app/api/notes/[id]/route.ts", "GET", "/api/notes/[id]"): (None, "GET", "jwt", "json"),
    }
    assert got["routes/users.js", "GET", "/users/:id"].middleware == ["cors()", "auth"]
    assert got["routes/items.js", "ALL", "/any"].middleware == ["cors()", "requireAuth", "limiter", "checkSession"]
    assert got["routes/v1.js", "GET", "/stats"].calls == ["log", "count"] and got["routes/v1.js", "GET", "/stats"].path_sure == 0.6
    assert got["routes/users.js", "GET", "/users/:id"].calls == ["prisma.user.findUnique"] and got["routes/users.js", "GET", "/users/:id"].sure == 0.6
    assert got["api/main.py", "GET", "/me"].id == "api/main.py:6:GET:/me"
    took = lambda *k: [(p.name, p.source, p.validated) for p in got[k].params]
    assert took("routes/users.js", "GET", "/users/:id") == [("id", "path", False)] and took("routes/users.js", "POST", "/users") == [("email", "body", False), ("name", "body", False)]
    assert took("web/app/api/notes/[id]/route.ts", "GET", "/api/notes/[id]") == [("id", "path", False)]
    assert {k: r.data_layer for k, r in got.items() if r.data_layer != "none"} == {("routes/users.js", "GET", "/users/:id"): "prisma", ("routes/users.js", "POST", "/users"): "prisma"}


def test_parameters_and_data_layers(spark):
    files = [
        ("a.ts", "import { z } from 'zod';\nimport { db } from './lib/db';\nconst Body = z.object({ email: z.string(), age: z.number() });\nrouter.post('/x', async (req, res) => {\n  const b = Body.parse(req.body);\n  const { email, nick: n = 1 } = req.body;\n  const { page } = req.query;\n  log(req.headers['x-k'], req.cookies.sid, req.query['q'], url.searchParams.get('s'));\n  await db.user.create(b);\n});\nrouter.get('/y', (req, res) => res.json(1));\n", "typescript"),
        ("lib/db.ts", "import { PrismaClient } from '@prisma/client';\nexport const db = new PrismaClient();\n", "typescript"),
        ("m.py", "from pydantic import BaseModel\nclass Item(BaseModel):\n    title: str\n    price: float\n\n@app.post('/items')\ndef make(item: Item, limit: int = Query(5), plain: str = 'x', token: str = Header()):\n    return save(item)\n", "python"),
        ("u.py", "from django.urls import path\nurlpatterns = [\n    path('a/<int:pk>/<slug>', v.show),\n]\ndef show(request, pk):\n    t = request.GET.get('tag')\n    return render(request, Article.objects.get(id=pk))\n", "python"),
    ]
    got = {r.route: r for r in P.project_endpoints(P.index(spark.createDataFrame(files, "path string, text string, lang string"))).collect()}
    took = {k: sorted((p.name, p.source, p.validated) for p in r.params) for k, r in got.items()}
    assert took == {
        "/x": sorted([("email", "body", True), ("age", "body", True), ("n", "body", False), ("page", "query", False), ("x-k", "header", False), ("sid", "cookie", False), ("q", "query", False), ("s", "query", False)]), "/y": [],
        "/items": sorted([("title", "body", True), ("price", "body", True), ("limit", "query", True), ("token", "header", True)]), "a/<int:pk>/<slug>": sorted([("pk", "path", True), ("slug", "path", False), ("tag", "query", False)]),
    }
    assert {k: (r.validator, r.data_layer) for k, r in got.items()} == {"/x": ("zod", "prisma"), "/y": ("none", "none"), "/items": ("pydantic", "none"), "a/<int:pk>/<slug>": ("none", "django-orm")}


def test_schemas_close_over_classes(spark):
    files = [
        ("a.py", "class A(BaseModel):\n    x: int\n    y = 1\n    def f(self):\n        z: int = 2\n\nclass B(A):\n    w: str\n\nclass C(B, Mixin):\n    q: float\n\nclass D(Other):\n    n: int\n\nclass E(C):\n    pass\n\nclass X(Y):\n    a: int\nclass Y(X):\n    b: int\n", "python"),
        ("b.py", "class B(pydantic.BaseModel):\n    v: int\n", "python"),
        ("s.ts", "import { z } from 'zod';\nimport J from 'joi';\nexport const User = z.object({ email: z.string().email(), 'full-name': z.object({ inner: z.string() }) });\nconst T = J.object({ a: 1 });\nconst U = yup.object().shape({ b: 2 });\nconst V = other.object({ c: 1 });\nconst W = z.object({});\n", "typescript"),
    ]
    got = {(r.path, r.name): (r.library, r.fields) for r in P.schemas(P.index(spark.createDataFrame(files, "path string, text string, lang string"))).collect()}
    assert got == {
        ("a.py", "A"): ("pydantic", ["x", "y"]), ("a.py", "B"): ("pydantic", ["w"]), ("a.py", "C"): ("pydantic", ["q"]), ("b.py", "B"): ("pydantic", ["v"]),
        ("s.ts", "User"): ("zod", ["email", "full-name"]), ("s.ts", "T"): ("joi", ["a"]),
    }


def test_routes_middleware_and_sockets(spark):
    js = "const BASE = '/base';\nlet v = `x`;\napp.get('/a', f);\nrouter.post(BASE, f);\napp.put(`/t`, f);\napp.delete(`/t/${id}`, f);\napp.get(setting);\napp.get(unknown, f);\nlogger.get('/no', f);\napp.use(cors());\napp.use('/api', auth, limit);\napp.use(BASE, x);\n"
    py = "@app.route('/x')\ndef a(): pass\n\nurlpatterns = [\n    path('articles/', views.list),\n    re_path(r'^y$', views.y),\n]\npath('z', q)\n"
    ws = "io.on('connection', f);\nemitter.on('tick', f);\nio.on('tick', f);\nprocess.on('error', f);\nws.on('error', f);\nserver.on('upgrade', f);\nio.on(name, f);\n"
    ix = P.index(spark.createDataFrame([("a.js", js, "javascript"), ("b.py", py, "python"), ("c.js", ws, "javascript")], "path string, text string, lang string"))
    assert [tuple(r) for r in P.constants(ix).collect()] == [("a.js", "BASE", "/base")]
    got = sorted((r.path, r.line, r.method, r.route, r.sure) for r in P.routes(ix).collect())
    assert got == [("a.js", 3, "GET", "/a", 1.0), ("a.js", 4, "POST", "/base", 0.6), ("a.js", 5, "PUT", "/t", 1.0), ("a.js", 6, "DELETE", "?", 0.2), ("a.js", 8, "GET", "?", 0.2), ("b.py", 1, "ALL", "/x", 1.0), ("b.py", 5, "ALL", "articles/", 1.0), ("b.py", 6, "ALL", "^y$", 1.0)]
    assert sorted((r.line, r.place, r.prefix, r.name) for r in P.middleware(ix).collect()) == [(10, 0, None, "cors()"), (11, 1, "/api", "auth"), (11, 2, "/api", "limit"), (12, 1, "/base", "x")]
    assert sorted((r.line, r.receiver, r.event) for r in P.sockets(ix).collect()) == [(1, "io", "connection"), (3, "io", "tick"), (5, "ws", "error"), (6, "server", "upgrade")]


def test_functions_and_their_calls(spark):
    js = "export async function load(id) {\n  return db.get(id);\n}\nconst save = async (x) => {\n  check(x);\n  check(x);\n  if (x) { store(x); }\n};\nclass A { run(y) { load(y); } }\nitems.map(z => z.id);\n"
    py = "class A:\n    def f(self, a: int = g(1)):\n\n        h(a)\n\n    def k(self):\n        pass\nx = 1\n"
    ix = P.index(spark.createDataFrame([("a.js", js, "javascript"), ("b.py", py, "python")], "path string, text string, lang string"))
    assert sorted((r.path, r.line, r.end_line, r.name) for r in ix.fns.where("name is not null").collect()) == [("a.js", 1, 3, "load"), ("a.js", 4, 8, "save"), ("a.js", 9, 9, "run"), ("b.py", 2, 4, "f"), ("b.py", 6, 7, "k")]
    got = sorted((r.path, r.line, r.caller, r.callee) for r in P.call_graph(ix).collect())
    assert got == [("a.js", 2, "load", "get"), ("a.js", 5, "save", "check"), ("a.js", 7, "save", "store"), ("a.js", 9, "run", "load"), ("b.py", 2, "f", "g"), ("b.py", 4, "f", "h")]
    assert [tuple(r) for r in P.function_text(ix, "load").collect()] == [("a.js", "export async function load(id) {\n  return db.get(id);\n}")]
    assert P.function_text(ix, "nope").count() == 0


def test_modules(spark):
    files = spark.createDataFrame([
        ("src/a.ts", "import { run as go } from './b';\nimport * as n from '../lib';\nimport d from 'x';\nconst { p } = require('./c/d');\nconst y = require('y');", "typescript"), ("src/b.ts", "", "typescript"), ("lib/index.ts", "", "typescript"), ("src/c/d.js", "", "javascript"),
        ("p/a.py", "from .b import c as d, e\nimport os\nimport x.y as z\nfrom ..q import r\nfrom . import b", "python"), ("p/b.py", "", "python"), ("q.py", "", "python"),
    ], "path string, text string, lang string")
    assert {tuple(r) for r in P.modules(files).collect()} == {
        ("src/a.ts", "go", "./b", "src/b.ts"), ("src/a.ts", "n", "../lib", "lib/index.ts"), ("src/a.ts", "d", "x", None), ("src/a.ts", "p", "./c/d", "src/c/d.js"), ("src/a.ts", "y", "y", None),
        ("p/a.py", "d", "./b", "p/b.py"), ("p/a.py", "e", "./b", "p/b.py"), ("p/a.py", "os", "os", None), ("p/a.py", "z", "x.y", None), ("p/a.py", "r", "../q", "q.py"), ("p/a.py", "b", "./b", "p/b.py"),
    }
    assert files.select(P.language(F.lit("a.py")), P.language(F.lit("A.TSX")), P.language(F.lit("x.rb"))).first() == ("python", "tsx", None)
