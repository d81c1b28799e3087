"""A symbol index: postings of names by file and line, written once in buckets, and look-ups that read only the buckets they need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.operators import syntax as S
from palisade.operators.project import Index
from palisade.plans.registry import Registry, table

R = Registry()

#: How sure a definition or reference is by where it was found, and a test by how.
LOCAL, IMPORTED, SCRIPT_REFERENCE, PYTHON_REFERENCE, BY_NAME, BY_SYMBOL = 0.8, 0.7, 0.9, 0.6, 0.9, 0.7
#: Hits of a search, tests of a file, lines of a test, length of a preview.
MOST_HITS, MOST_TESTS, MOST_LINES, PREVIEW = 50, 30, 5, 120
SCRIPTS = ["ts", "tsx", "js", "jsx", "mjs", "cjs"]
TEST_FOLDERS = ["tests", "test", "__tests__", "__test__", "spec", ""]


def _bucket(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def postings(files: DataFrame) -> DataFrame:
    """(name, path, line, preview): every word of a line of files (path, text) in lower case, comments and strings included.

    Look-ups are for whole words in any case, as a search would find them. Null texts have none; a word counts once a line;
    other columns are ignored.
    """
    lines = files.where("text is not null").select("path", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    names = F.array_distinct(F.regexp_extract_all(F.lower("x"), F.lit("[a-z0-9_]+"), F.lit(0)))
    return lines.select(F.explode(names).alias("name"), "path", (F.col("line") + 1).alias("line"), F.substring(F.trim("x"), 1, PREVIEW).alias("preview"))


def write_index(files: DataFrame, folder: str, buckets: int = 64) -> None:
    """Writes the postings of files to a folder, a partition for each bucket of names, sorted by name: look-ups prune both."""
    rows = postings(files).withColumn("bucket", _bucket(F.col("name"), buckets))
    # a bucket is dealt over several tasks by path, so that a name that all lines hold is in no single one
    rows.repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(8))).sortWithinPartitions("bucket", "name", "path", "line").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_index(spark: SparkSession, folder: str, names: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """The postings of an index, of a few names only (in any case) if given: other buckets aren't listed, and in a file other row groups aren't read."""
    rows = spark.read.parquet(folder)
    if names is not None:
        names = sorted({n.lower() for n in names})
        at = [r.b for r in spark.createDataFrame([(n,) for n in names], "name string").select(_bucket(F.col("name"), buckets).alias("b")).distinct().collect()]  # as many rows as names asked for
        rows = rows.where(F.col("bucket").isin(at) & F.col("name").isin(names))
    return rows.select("name", "path", "line", "preview")


def definitions(ix: Index) -> DataFrame:
    """(path, name, line): where each file first defines a function or a class of that name."""
    classes = ix.toks.where("p1 = 'class'").where(F.col("text").rlike(S.NAME)).select("path", F.col("text").alias("name"), F.col("at").alias("first"), "line")
    every = ix.fns.where("name is not null").select("path", "name", "first", "line").union(classes)
    return every.groupBy("path", "name").agg(F.min_by("line", "first").alias("line"))


def find_definition(ix: Index, queries: DataFrame) -> DataFrame:
    """(path, symbol, target, line, confidence) for queries (path, symbol): in the file itself, else in the file that the symbol is imported from.

    Queries that repeat are answered once; those without a definition have no row.
    """
    asked = queries.select("path", "symbol").distinct()
    defs = definitions(ix)
    local = asked.join(defs.withColumnRenamed("name", "symbol"), ["path", "symbol"]).select("path", "symbol", F.col("path").alias("target"), "line", F.lit(LOCAL).alias("confidence"))
    taken = ix.imports.where("target is not null").groupBy("path", F.col("local").alias("symbol")).agg(F.min("target").alias("target"))
    abroad = asked.join(local, ["path", "symbol"], "left_anti").join(taken, ["path", "symbol"]).join(defs.withColumnsRenamed({"path": "target", "name": "symbol"}), ["target", "symbol"])
    return local.unionByName(abroad.select("path", "symbol", "target", "line", F.lit(IMPORTED).alias("confidence")))


def find_references(found: DataFrame, queries: DataFrame, most: int | None = MOST_HITS) -> DataFrame:
    """(path, symbol, target, line, confidence) for queries (path, symbol): lines of any file, of postings(), that hold the symbol; the first `most` by file and line, or all.

    Names are looked up by an equality join and cut to their first hits, which are the same for every query, before queries
    are joined: a name that all lines hold costs each task its first hits alone.
    """
    asked = queries.select("path", "symbol", F.lower("symbol").alias("name")).distinct()
    hits = found.select("name", F.col("path").alias("target"), "line").join(asked.select("name").distinct(), "name")
    if most is not None:
        ranked = Window.partitionBy("name").orderBy("target", "line")
        hits = hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most)
    hits = asked.join(hits, "name")
    script = F.lower(F.regexp_extract("path", "[.]([A-Za-z]+)$", 1)).isin(SCRIPTS)
    return hits.select("path", "symbol", "target", "line", F.when(script, SCRIPT_REFERENCE).otherwise(PYTHON_REFERENCE).alias("confidence"))


def is_test(path: Column) -> Column:
    base = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    return base.rlike(r"\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)$") | base.rlike(r"^test_.*\.py$") | base.endswith("_test.py")


def test_candidates(path: Column) -> Column:
    """The paths, in order, at which a test of this file would be expected by its name."""
    folder = F.regexp_replace(F.regexp_extract(path, "^(.*/)?[^/]*$", 1), "/$", "")
    base = F.regexp_extract(path, "([^/]*?)([.][^./]*)?$", 1)
    at = lambda d, name: F.when(d == "", name).otherwise(F.concat(d, F.lit("/"), name))
    python = F.array(*[at(d, F.concat(F.lit("test_"), base, F.lit(".py"))) for d in (F.lit("tests"), F.lit("test"), folder, F.lit("src"), F.lit(""))])
    script = F.array(*[at(d, F.concat(base, F.lit(suffix + "." + ext))) for ext in SCRIPTS for suffix in (".test", ".spec") for d in [*map(F.lit, TEST_FOLDERS), folder]])
    return F.array_distinct(F.when(path.endswith(".py"), python).otherwise(script))


def _test_folders(path: Column) -> Column:
    """The folders, in order, in which test_candidates() expects a test of this file; what occurs again counts where it came first."""
    own = F.regexp_replace(F.regexp_extract(path, "^(.*/)?[^/]*$", 1), "/$", "")
    python = F.array(F.lit("tests"), F.lit("test"), own, F.lit("src"), F.lit(""))
    return F.array_distinct(F.when(path.endswith(".py"), python).otherwise(F.array(*map(F.lit, TEST_FOLDERS), own)))


def named_tests(files: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, symbol, named) for each row of asked (path, symbol): the files (path) among its test_candidates(), in their order.

    Candidates differ by folder, suffix and extension alone. So files that are named like tests are taken apart, and a query
    looks up its few folders with the name, not each of its candidates: with one it meets as many files as there are suffixes.
    """
    script, python = r"(?s)\A(.*/)?([^/]*)[.](test|spec)[.](" + "|".join(SCRIPTS) + r")\z", r"(?s)\A(.*/)?test_([^/]*)[.]py\z"
    is_python = F.col("test").rlike(python)
    part = lambda k: F.when(is_python, F.regexp_extract("test", python, k)).otherwise(F.regexp_extract("test", script, k))
    suffix = F.array_position(F.array(*[F.lit(f"{s}.{ext}") for ext in SCRIPTS for s in ("test", "spec")]), F.concat_ws(".", F.regexp_extract("test", script, 3), F.regexp_extract("test", script, 4)))
    tests = files.select(F.col("path").alias("test")).where(is_python | F.col("test").rlike(script)).distinct()
    # a file right under / is nobody's candidate: the folder "" puts no / before a name
    tests = tests.select("test", part(1).alias("at"), part(2).alias("base"), is_python.alias("python"), F.when(is_python, F.lit(0)).otherwise(suffix).alias("suffix")).where("at <> '/'")
    tests = tests.withColumn("folder", F.expr("left(at, greatest(length(at) - 1, 0))")).drop("at")
    base = F.regexp_extract("path", "([^/]*?)([.][^./]*)?$", 1)
    places = asked.select("path", "symbol", base.alias("base"), F.col("path").endswith(".py").alias("python"), F.posexplode(_test_folders(F.col("path"))).alias("place", "folder"))
    found = places.join(tests, ["folder", "base", "python"], "left").select("path", "symbol", F.when(F.col("test").isNotNull(), F.struct("suffix", "place", "test")).alias("x"))
    return found.groupBy("path", "symbol").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["test"]).alias("named"))


def find_tests(files: DataFrame, found: DataFrame, queries: DataFrame) -> DataFrame:
    """(path, symbol, test, rank, how, confidence, lines, previews) for queries (path, symbol): tests by their name, then tests that hold the symbol.

    files (path) are all files there are, found their postings(); a null symbol is looked for by name alone. Of a test the
    first lines are listed, in a query the first tests. Both kinds come to a query as short lists, so that it stays one row
    until its tests are told.
    """
    asked = named_tests(files, queries.select("path", "symbol").where("path is not null").distinct()).withColumn("name", F.lower("symbol"))
    words = queries.select(F.lower("symbol").alias("name")).where("name is not null").distinct()
    hits = found.where(is_test(F.col("path"))).select("name", F.col("path").alias("test"), "line", "preview").join(words, "name")
    first = Window.partitionBy("name", "test").orderBy("line")
    hits = hits.withColumn("k", F.row_number().over(first)).where(F.col("k") <= MOST_LINES).groupBy("name", "test").agg(F.array_sort(F.collect_list(F.struct("line", "preview"))).alias("x"))
    # a query lists so many tests, and there are only so many names to leave out: more of a symbol's tests need no query
    enough = MOST_TESTS + 2 * len(SCRIPTS) * (len(TEST_FOLDERS) + 1)
    hits = hits.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("test"))).where(F.col("k") <= enough)
    hits = hits.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("test", "x"))).alias("hits"))

    def told(test: Column, how: str, confidence: float, lines: Column, previews: Column) -> Column:
        return F.struct(test.alias("test"), F.lit(how).alias("how"), F.lit(confidence).alias("confidence"), lines.alias("lines"), previews.alias("previews"))

    by_name = F.transform("named", lambda t: told(t, "naming", BY_NAME, F.array().cast("array<int>"), F.array().cast("array<string>")))
    some = F.slice(F.coalesce("hits", F.array()), 1, F.size("named") + MOST_TESTS)
    by_symbol = F.transform(F.filter(some, lambda y: ~F.array_contains("named", y["test"])), lambda y: told(y["test"], "symbol", BY_SYMBOL, y["x"]["line"], y["x"]["preview"]))
    tests = asked.join(hits, "name", "left").select("path", "symbol", F.posexplode(F.slice(F.concat(by_name, by_symbol), 1, MOST_TESTS)).alias("k", "t"))
    return tests.select("path", "symbol", "t.test", (F.col("k") + 1).alias("rank"), "t.how", "t.confidence", "t.lines", "t.previews")


def dynamic_patterns(ix: Index) -> DataFrame:
    """(path, type, line): places that can't be told before running: D1 require of a name, D2 import of one, D3 require of a template, D4 middleware from the environment, D6 new Function, D7 vm.runIn*, D8 a conditional require, D9 eval, D10 a require of what glob found. Each once a line."""
    first = ix.args.where("place = 0").select("path", "call", "kind", "text", "n")
    calls = ix.calls.withColumnRenamed("first", "call").join(first, ["path", "call"], "left")
    globbed = ix.calls.where("receiver = 'glob' and method = 'sync'").join(ix.toks.where("p1 = '='").select("path", F.col("at").alias("start"), F.col("p2").alias("text")), ["path", "start"]).select("path", "text", F.lit(True).alias("globbed")).distinct()
    blocks = ix.pairs.where("kind = '{' and p1 = ')'").select("path", F.col("p1_at").alias("close"), "first", "last").join(ix.pairs.where("kind = '(' and p1 = 'if'").select("path", F.col("last").alias("close")), ["path", "close"]).select("path", "first", "last", F.lit(True).alias("if"))
    needed = calls.where("receiver = '' and method = 'require' and kind is not null and kind <> 'string'").join(globbed, ["path", "text"], "left")
    needed = S.enclosing(needed.withColumnRenamed("start", "at"), blocks, ["if"])
    template = (F.col("kind") == "template") | F.col("text").startswith("`(")
    kind = F.when(template, "D3").when((F.col("kind") == "name") & F.col("globbed"), "D10").when((F.col("kind") == "name") & F.col("in_if"), "D8").otherwise("D1")
    parts = [
        needed.select("path", kind.alias("type"), "line"),
        calls.where("method like 'runIn%' and (receiver = '' or receiver like '%vm')").select("path", F.lit("D7").alias("type"), "line"),
        calls.where("receiver = '' and method = 'eval' and kind is not null and kind <> 'string'").select("path", F.lit("D9").alias("type"), "line"),
        ix.toks.where("text = '(' and p1 = 'import'").where(~F.col("n1").rlike("^['\"]")).select("path", F.lit("D2").alias("type"), "line"),
        ix.toks.where("text = 'Function' and p1 = 'new'").select("path", F.lit("D6").alias("type"), "line"),
        ix.calls.where("method = 'use'").select("path", "first", "last", "line", F.lit(True).alias("use")).transform(lambda uses: S.enclosing(ix.names.where("text like 'process.env%'").select("path", "at"), uses, ["line"])).where("in_line is not null").select("path", F.lit("D4").alias("type"), F.col("in_line").alias("line")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


# ---- registered


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".ts").otherwise(".py")).alias("path"), "text")


_HITS = "h AS (SELECT DISTINCT unnest(regexp_extract_all(lower(x), '[a-z0-9_]+')) AS name, path, line FROM (SELECT 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.ts' ELSE '.py' END AS path, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL))"


@R.frame(f"""WITH {_HITS}, q AS (SELECT DISTINCT CASE WHEN item_id % 2 = 0 THEN 'q.ts' ELSE 'q.py' END AS path, regexp_extract(text, '[A-Za-z_]+') AS symbol FROM benchmark),
 r AS (SELECT q.path, symbol, h.path AS target, line, row_number() OVER (PARTITION BY q.path, symbol ORDER BY h.path, line) AS k FROM q JOIN h ON h.name = lower(q.symbol))
 SELECT path, symbol, target, CAST(line AS INT) AS line, CASE WHEN path = 'q.ts' THEN 9e-1 ELSE 6e-1 END AS confidence FROM r WHERE k <= 50""")
def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    queries = items.select(F.when(F.col("item_id") % 2 == 0, "q.ts").otherwise("q.py").alias("path"), F.regexp_extract("text", "[A-Za-z_]+", 0).alias("symbol"))
    return find_references(postings(_documents(spark, sf_dir)), queries)


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page a module, for some a test by name, for some a test under another name that holds a symbol."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("k"))
    symbol = F.concat(F.lit("s"), (F.col("page_id") % 7).cast("string"))
    rows = [
        p.select(F.concat(F.lit("src/m"), "k", F.lit(".ts")).alias("path"), F.lit("export {}").alias("text")),
        p.where("page_id % 6 = 0").select(F.concat(F.lit("tests/m"), "k", F.lit(".test.ts")), F.concat(F.lit("it();\n"), symbol, F.lit("();"))),
        p.where("page_id % 10 = 0").select(F.concat(F.lit("src/m"), "k", F.lit(".spec.js")), symbol),
        p.where("page_id % 15 = 0").select(F.concat(F.lit("lib/x"), "k", F.lit("_test.py")), F.concat(symbol, F.lit("\n\n"), symbol, F.lit("x "), symbol)),
    ]
    return reduce(DataFrame.union, rows)


@R.frame("""WITH t AS (SELECT 'tests/m' || page_id || '.test.ts' AS test, page_id AS id, page_id % 7 AS s, [2] AS lines FROM pages WHERE page_id % 6 = 0 UNION ALL SELECT 'src/m' || page_id || '.spec.js', page_id, page_id % 7, [1] FROM pages WHERE page_id % 10 = 0
 UNION ALL SELECT 'lib/x' || page_id || '_test.py', NULL, page_id % 7, [1, 3] FROM pages WHERE page_id % 15 = 0),
 a AS (SELECT 'src/m' || p.page_id || '.ts' AS path, 's' || p.page_id % 7 AS symbol, t.test, t.id IS NOT DISTINCT FROM p.page_id AS named, CASE WHEN t.test LIKE 'tests/%' THEN 0 ELSE 1 END AS o, t.lines FROM pages p JOIN t ON t.id = p.page_id OR t.s = p.page_id % 7),
 r AS (SELECT *, row_number() OVER (PARTITION BY path, symbol ORDER BY CASE WHEN named THEN 0 ELSE 1 END, CASE WHEN named THEN o ELSE 0 END, test) AS rank FROM a)
 SELECT path, symbol, test, CAST(rank AS INT) AS rank, CASE WHEN named THEN 'naming' ELSE 'symbol' END AS how, CASE WHEN named THEN 9e-1 ELSE 7e-1 END AS confidence, CASE WHEN named THEN '' ELSE array_to_string(lines, ',') END AS lines FROM r WHERE rank <= 30""")
def test_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _modules(spark, sf_dir)
    queries = table(spark, sf_dir, "pages").select(F.concat(F.lit("src/m"), F.col("page_id").cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("s"), (F.col("page_id") % 7).cast("string")).alias("symbol"))
    found = find_tests(files, postings(files), queries)
    return found.select("path", "symbol", "test", "rank", "how", "confidence", F.array_join("lines", ",").alias("lines"))


@R.frame("""WITH l AS (SELECT doc_id, k - 1 AS k, (doc_id * 7 + (k - 1) * 3 + length(s)) % 8 AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL))
 SELECT 'src/d' || doc_id || '.js' AS path, 'g' || k AS symbol, CAST(k + 1 AS INT) AS line, 8e-1 AS confidence FROM l WHERE t = 4 AND k < 20""")
def symbol_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.operators.dataflow import code_files
    from palisade.operators.project import index

    files = code_files(spark, sf_dir)
    queries = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("g"), k.cast("string")))).alias("symbol"))
    return find_definition(index(files), queries).select("path", "symbol", "line", "confidence")
