"""Which runtime, package manager and framework a file belongs to, by the nearest folder above that says so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans.registry import Registry, table

R = Registry()

#: Fixed values: (package, framework, tier) in order; the first that is a dependency counts.
SCRIPT_FRAMEWORKS = [
    ("react-native", "react-native", 4), ("@cloudflare/workers-types", "cloudflare-workers", 4), ("wrangler", "cloudflare-workers", 4), ("electron", "electron", 2), ("next", "next", 2),
    ("@remix-run/node", "remix", 2), ("remix", "remix", 2), ("nuxt", "nuxt", 2), ("@nestjs/core", "nestjs", 1), ("fastify", "fastify", 1), ("express", "express", 1), ("koa", "koa", 1), ("@hapi/hapi", "hapi", 1),
    ("svelte", "svelte", 3), ("vue", "vue", 3), ("react", "react", 3),
]
PYTHON_FRAMEWORKS = [("fastapi", "fastapi", 1), ("flask", "flask", 1), ("django", "django", 1)]
#: Files that name what a folder needs, and locks with the package manager that writes them, in order.
PYTHON_MANIFESTS = ["requirements.txt", "pyproject.toml", "setup.py", "Pipfile"]
LOCKS = ["bun.lockb", "bun.lock", "bunfig.toml", "deno.json", "deno.jsonc", "package-lock.json", "pnpm-lock.yaml", "yarn.lock"]
MANAGERS = [("bun.lockb", "bun"), ("bun.lock", "bun"), ("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm")]
PYTHON_LOCKS = [("poetry.lock", "poetry"), ("uv.lock", "uv"), ("Pipfile", "pip"), ("requirements.txt", "pip"), ("pyproject.toml", "pip")]
_PACKAGE = "packageManager string, engines map<string,string>, dependencies map<string,string>, devDependencies map<string,string>"


def folder_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "^(.*/)?[^/]*$", 1), "/$", "")


def nearest(folders: DataFrame, files: DataFrame, names: list[str]) -> DataFrame:
    """(folder, dir, name, text): for each folder the deepest folder above it, or itself, that holds a file of these names, and which; the first of several.

    Each folder is put once under each folder above it, and an equality join with those that hold such a file keeps the
    deepest: rows grow with the depth of paths, never with pairs of files.
    """
    steps = F.filter(F.split("folder", "/"), lambda s: s != "")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(F.array_join(F.slice(steps, F.lit(1), n), "/").alias("dir"), n.alias("depth")))
    up = folders.select("folder").distinct().select("folder", F.explode(above).alias("x")).select("folder", "x.dir", "x.depth")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    held = files.select(folder_of(F.col("path")).alias("dir"), name.alias("name"), "text").where(F.col("name").isin(names))
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    best = up.join(held.withColumn("rank", rank), "dir").groupBy("folder").agg(F.max_by(F.struct("dir", "name", "text"), F.struct("depth", -F.col("rank"))).alias("x"))
    return best.select("folder", "x.dir", "x.name", "x.text")


def _first(tests: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(t, F.lit(v)) for t, v in tests], F.lit(None).cast("string"))


def detect(queries: DataFrame, files: DataFrame) -> DataFrame:
    """(path, runtime, package_manager, framework, framework_version, tier) for queries (path), by files (path, text) of the workspace.

    Scripts: bun by the package's manager or engine or a lock at the root, deno likewise, else node; the manager by the
    package, else by the nearest lock's folder, else npm; the framework by the nearest package. Python: the manager by the
    file's own folder, the framework by the nearest list of requirements. Unreadable or null texts say nothing; tier is 1
    without a framework. Whether programs are installed isn't looked at.
    """
    asked = queries.select("path").distinct().withColumn("folder", folder_of(F.col("path")))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    held = files.select(folder_of(F.col("path")).alias("dir"), name.alias("name")).groupBy("dir").agg(F.collect_set(F.when(F.col("name").isin(sorted({*LOCKS, *PYTHON_MANIFESTS, *(n for n, _ in PYTHON_LOCKS)})), F.col("name"))).alias("names"))
    root = held.where("dir = ''").select(F.col("names").alias("at_root"))
    has = lambda of, *names: reduce(lambda a, b: a | b, [F.coalesce(F.array_contains(of, n), F.lit(False)) for n in names])
    package = nearest(asked, files, ["package.json"]).select("folder", F.from_json("text", _PACKAGE).alias("pkg"))
    lock = nearest(asked, files, LOCKS).select("folder", F.col("dir").alias("lock_dir"), F.col("name").alias("lock"))
    rows = asked.join(package, "folder", "left").join(lock, "folder", "left").join(held.withColumnsRenamed({"dir": "lock_dir", "names": "beside"}), "lock_dir", "left").join(held.withColumnsRenamed({"dir": "folder", "names": "own"}), "folder", "left")
    rows = rows.join(F.broadcast(root.limit(1)), F.lit(True), "left")  # one row
    needs = nearest(asked, files, PYTHON_MANIFESTS).select("folder", F.lower("text").alias("needs"))
    rows = rows.join(needs, "folder", "left")
    manager = F.lower(F.coalesce("pkg.packageManager", F.lit("")))
    runtime = _first([
        (manager.startswith("bun"), "bun"), (F.coalesce(F.col("pkg.engines")["bun"].isNotNull(), F.lit(False)), "bun"), (has(F.col("at_root"), "bun.lockb", "bun.lock", "bunfig.toml"), "bun"), (manager.startswith("deno"), "deno"),
        (has(F.col("at_root"), "deno.json", "deno.jsonc"), "deno"), (F.coalesce(F.col("lock").isin("deno.json", "deno.jsonc"), F.lit(False)), "deno"), (F.lit(True), "node"),
    ])
    script_manager = _first([(manager.startswith(m), m) for m in ("bun", "pnpm", "yarn", "npm")] + [(has(F.col("beside"), n), m) for n, m in MANAGERS] + [(F.lit(True), "npm")])
    at = lambda dep: F.coalesce(F.nullif(F.col("pkg.devDependencies")[dep], F.lit("")), F.when(~F.coalesce(F.map_contains_key("pkg.devDependencies", dep), F.lit(False)), F.nullif(F.col("pkg.dependencies")[dep], F.lit(""))))
    script = F.coalesce(*[F.when(at(dep).isNotNull(), F.struct(F.lit(f).alias("framework"), at(dep).alias("version"), F.lit(t).alias("tier"))) for dep, f, t in SCRIPT_FRAMEWORKS])
    python = F.coalesce(*[F.when(F.col("needs").rlike(rf"(?m)^\s*{dep}(\s*[=><~!]|\s*$)"), F.struct(F.lit(f).alias("framework"), F.nullif(F.regexp_extract("needs", rf"{dep}\s*[=><~!]*\s*([0-9][0-9a-zA-Z.\-]*)", 1), F.lit("")).alias("version"), F.lit(t).alias("tier"))) for dep, f, t in PYTHON_FRAMEWORKS])
    is_python = F.lower("path").rlike(r"\.p(yi?|yx)$")
    rows = rows.withColumn("f", F.when(is_python, python).otherwise(script))
    return rows.select(
        "path", F.when(is_python, "python").otherwise(runtime).alias("runtime"), F.when(is_python, _first([(has(F.col("own"), n), m) for n, m in PYTHON_LOCKS])).otherwise(script_manager).alias("package_manager"),
        F.col("f.framework").alias("framework"), F.col("f.version").alias("framework_version"), F.coalesce("f.tier", F.lit(1)).alias("tier"),
    )


# ---- registered on folders that the pages make


def _workspace(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 5).alias("k"), F.col("page_id").cast("string").alias("s"))
    k = F.col("k").cast("string")
    queries = p.select(F.concat(F.lit("p"), k, F.lit("/s"), (F.col("page_id") % 3).cast("string"), F.lit("/f"), "s", F.when(F.col("page_id") % 4 == 0, ".py").otherwise(".ts")).alias("path"))
    folders = p.select("k").distinct()
    at = lambda name: F.concat(F.lit("p"), k, F.lit("/" + name)).alias("path")
    package = F.concat(F.lit('{"dependencies": {"react": "1.0", "'), F.element_at(F.array(*map(F.lit, ["express", "next", "left-pad"])), (F.col("k") % 3 + 1).cast("int")), F.lit('": "2.'), k, F.lit('"}}'))
    rows = [
        folders.where("k % 5 <> 0").select(at("package.json"), package.alias("text")), folders.where("k % 2 = 0").select(at("s1/pnpm-lock.yaml"), F.lit("")), folders.where("k % 4 = 1").select(at("requirements.txt"), F.concat(F.lit("x\nFlask==1."), k)),
        folders.where("k % 7 = 0").select(at("s0/poetry.lock"), F.lit("")), folders.limit(1).select(F.lit("package.json"), F.lit('{"devDependencies": {"fastify": "4"}}')), folders.limit(1).select(F.lit("yarn.lock"), F.lit("")),
    ]
    return queries, reduce(DataFrame.union, rows)


@R.frame("""WITH q AS (SELECT page_id // 5 AS k, page_id % 3 AS s, page_id % 4 = 0 AS py, 'p' || page_id // 5 || '/s' || page_id % 3 || '/f' || page_id || CASE WHEN page_id % 4 = 0 THEN '.py' ELSE '.ts' END AS path FROM pages)
 SELECT path, CASE WHEN py THEN 'python' ELSE 'node' END AS runtime, CASE WHEN py THEN CASE WHEN k % 7 = 0 AND s = 0 THEN 'poetry' END WHEN k % 2 = 0 AND s = 1 THEN 'pnpm' ELSE 'yarn' END AS package_manager,
 CASE WHEN py THEN CASE WHEN k % 4 = 1 THEN 'flask' END WHEN k % 5 = 0 THEN 'fastify' ELSE ['express', 'next', 'react'][k % 3 + 1] END AS framework,
 CASE WHEN py THEN CASE WHEN k % 4 = 1 THEN '1.' || k END WHEN k % 5 = 0 THEN '4' WHEN k % 3 = 2 THEN '1.0' ELSE '2.' || k END AS framework_version,
 CAST(CASE WHEN py OR k % 5 = 0 THEN 1 ELSE [1, 2, 3][k % 3 + 1] END AS INT) AS tier FROM q""")
def runtime_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(*_workspace(spark, sf_dir))
