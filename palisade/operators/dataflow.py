"""Taint as a fixpoint over tables: facts of files, edges between variables, and rounds that follow new facts alone.

A cell is what can hold something: a variable of a scope (path, scope, name; scope -1 is the module), a parameter, or what a
function returns (name `()`). Edges say that a cell, if tainted before some place, taints another one from a place on. All
of a program's edges are written once; a round joins the cells tainted since the last one with them, so rounds are as many
as the longest chain of assignments and calls, and their rows shrink with it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import rules
from palisade.operators import syntax as S
from palisade.plans.registry import Registry, table
from palisade.plans.scratch import written

R = Registry()

MODULE, FAR = -1, S.FAR
CELL = ["c_path", "c_scope", "c_name"]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def sink_of(lang: Column, form: str, receiver: Column, name: Column) -> Column:
    """struct<id, type, severity, rank> of the first rule that matches a call (or an assignment to a member); null if none does."""
    found = []
    for rank, (id_, type_, severity, languages, matchers, _) in enumerate(rules.SINKS, 1):
        tests = [(name == n) & (F.lit(True) if r == "*" else receiver == r) for f, r, n in matchers if f == form]
        if tests:
            found.append(F.when(lang.isin(*languages) & _any(tests), F.struct(F.lit(id_).alias("id"), F.lit(type_).alias("type"), F.lit(severity).alias("severity"), F.lit(rank).alias("rank"))))
    return F.coalesce(*found)


def is_sanitizer(lang: Column, receiver: Column, method: Column) -> Column:
    python = [(method == m) & (F.lit(True) if not r else receiver == r) for r, m in rules.SANITIZERS["python"]]
    script = [(method == m) & (F.lit(True) if not r else receiver == r) for r, m in rules.SANITIZERS["javascript"]]
    return F.when(lang == "python", _any(python)).otherwise(_any(script))


def is_source(lang: Column, text: Column) -> Column:
    """Whether a dotted name is a source or goes on from one."""
    hit = lambda names: _any([(text == s) | text.startswith(s + ".") for s in names])
    return F.when(lang == "python", hit(rules.SOURCES["python"])).otherwise(hit(rules.SOURCES["javascript"]))


def imports(files: DataFrame) -> DataFrame:
    """(path, local, original, target): names that a file takes from another file; original is null for the whole of it.

    Relative modules are looked for by suffixes, in order; other modules are outside of the files and left out.
    """
    word = "[A-Za-z0-9_$]"
    script = F.col("lang") != "python"
    js = F.regexp_extract_all("text", F.lit(r"import\s+(?:type\s+)?[\w$*{}\s,]+?\s+from\s+['\"][^'\"]+['\"]|(?:const|let|var)\s+(?:[\w$]+|\{[^}]*\})\s*=\s*require\(\s*['\"][^'\"]+['\"]\s*\)"), F.lit(0))
    py = F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*from\s+\.[\w.]*\s+import\s+[^\n#]+"), F.lit(0))
    one = files.where("text is not null").select("path", "lang", F.explode(F.when(script, js).otherwise(py)).alias("x"))
    dots = F.length(F.regexp_extract("x", r"from\s+(\.+)", 1))
    module = F.regexp_replace(F.regexp_extract("x", r"from\s+\.+([\w.]*)", 1), r"\.", "/")
    spec = F.when(script, F.regexp_extract("x", r"['\"]([^'\"]+)['\"]", 1)).otherwise(F.concat(F.when(dots == 1, "./").otherwise(F.repeat(F.lit("../"), dots - 1)), module))
    names = F.when(script, F.regexp_extract("x", r"(?:import\s+(?:type\s+)?|const\s+|let\s+|var\s+)([\w$*{}\s,:]+?)\s*(?:from|=)", 1)).otherwise(F.regexp_extract("x", r"import\s+([^\n#]+)", 1))
    each = one.select("path", "lang", spec.alias("spec"), F.explode(F.split(F.regexp_replace(names, r"[()]", ""), ",")).alias("part"), names.alias("names")).where(F.col("spec").startswith("."))
    bare = ~script & (F.col("spec").rlike("/$"))  # from . import module
    whole = F.col("part").contains("*") | script & ~F.col("names").contains("{") | bare
    part = F.trim(F.regexp_replace("part", r"[{}*]", ""))
    local = F.regexp_extract(part, f"({word}+)$", 1)
    original = F.when(~whole, F.regexp_extract(part, f"^({word}+)", 1))
    spec = F.when(bare, F.concat("spec", F.regexp_extract(part, f"^({word}+)", 1))).otherwise(F.col("spec"))
    each = each.select("path", "lang", spec.alias("spec"), local.alias("local"), original.alias("original")).where("local <> ''")
    steps = F.split(F.concat(F.regexp_replace("path", "[^/]*$", ""), "spec"), "/")
    flat = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when((s == ".") | (s == ""), a).otherwise(F.concat(a, F.array(s))))
    suffixes = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py"]
    tried = each.select("path", "local", "original", F.posexplode(F.transform(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.concat(F.array_join(flat, "/"), s))).alias("rank", "target"))
    found = tried.join(files.select(F.col("path").alias("target")), "target")
    return found.groupBy("path", "local", "original").agg(F.min_by("target", "rank").alias("target"))


@dataclass
class Facts:
    """Tables of a program: what cells taint what, where sources come in, and what sinks read. See facts()."""

    seeds: DataFrame
    edges: DataFrame
    reads: DataFrame


def facts(files: DataFrame) -> Facts:
    """The taint facts of files (path, text, lang). Null texts and other languages have none; a path is one file.

    seeds (cell, at, source, s_path, s_line): a source is assigned to a cell, which holds it from `at` on.
    edges (cell, before, d_path, d_scope, d_name, at, hop): the cell is used at `before` for what another one gets at `at`.
    reads (path, line, sink, type, at, cell or source): what stands in the arguments of a sink, or is assigned to one.
    Whatever a sanitizer's call holds counts for nothing outside of it. Statements count in the order of the text,
    branches and loops don't matter, and nothing takes a taint away again.
    """
    toks = written(S.tokens(files), "tokens")
    pairs = written(S.brackets(toks), "brackets")
    fns = written(S.functions(toks, pairs), "functions")
    names = written(S.chains(toks), "names")
    calls = written(S.calls(names, pairs, fns), "calls")
    bodies = fns.select("path", "first", "last", "fn")
    own = lambda df, at="at": S.enclosing(df, bodies, ["fn"], at=at).withColumn("fn", F.coalesce("in_fn", F.lit(MODULE))).drop("in_fn")

    # scopes: the functions around each, then the module
    up = S.scopes(fns).select("path", "fn", "up", "far")
    here = fns.select("path", "fn").union(toks.select("path", F.lit(MODULE).alias("fn")).distinct())
    up = written(up.unionByName(here.select("path", "fn", F.lit(MODULE).alias("up"), F.lit(1 << 30).alias("far"))), "scopes")

    # assignments and returns, each up to the end of its statement within the same bracket
    inside = S.until(toks, pairs, "=", "+=", "return")
    blocks = F.when(F.col("lang") == "python", F.col("in_first").isNull()).otherwise(F.coalesce(F.col("in_kind") == "{", F.lit(True)))
    sets = written(own(inside.where(blocks | (F.col("text") == "return")).select("path", "lang", "at", "text", "line", "until", "p1", "p2", "p3", "p1_at")), "assignments")
    equals = sets.where("text <> 'return'")
    single = equals.where(F.col("p1").rlike(S.NAME) & ~F.coalesce(F.col("p2").isin(".", "?."), F.lit(False)))
    typed = F.coalesce(F.col("p2") == ":", F.lit(False)) & F.coalesce(F.col("p3").rlike(S.NAME), F.lit(False))
    declared = typed | F.coalesce(F.col("p2").isin("const", "let", "var"), F.lit(False)) | (F.col("lang") == "python")
    single = single.select("path", "fn", F.when(typed, F.col("p3")).otherwise(F.col("p1")).alias("name"), "at", "until", declared.alias("declared"))
    patterns = equals.where("p1 in ('}', ']')").select("path", "fn", "at", "until", F.col("p1_at").alias("last")).join(pairs.select("path", "last", "first", F.col("p1").isin("const", "let", "var").alias("declared")), ["path", "last"])
    bound = S.enclosing(names.where("n1 in (',', '}', ']', '=') and not contains(text, '.')").select("path", "at", "text"), patterns.select("path", "first", "last", "fn", F.col("at").alias("eq"), "until", "declared"), ["fn", "eq", "until", "declared"])
    several = bound.where("in_eq is not null").select("path", F.col("in_fn").alias("fn"), F.col("text").alias("name"), F.col("in_eq").alias("at"), F.col("in_until").alias("until"), F.coalesce("in_declared", F.lit(False)).alias("declared"))
    defs = single.unionByName(several)

    # parameters, by place
    heads = fns.select("path", "fn", F.col("head").alias("first")).join(pairs.where("kind = '('").select("path", "first", "last"), ["path", "first"])
    listed = S.enclosing(names.where("root is not null and p1 in ('(', ',', '{', '*') and n1 in (',', ')', '=', ':', '}')").select("path", "first", "root"), heads.select("path", "first", "last", "fn"), ["fn"], at="first")
    alone = fns.select("path", "fn", F.col("head").alias("at")).join(toks.where(F.col("text").rlike(S.NAME)).select("path", "at", F.col("text").alias("root")), ["path", "at"])
    params = listed.where("in_fn is not null").select("path", F.col("in_fn").alias("fn"), "first", "root").union(alone.select("path", "fn", "at", "root"))
    params = written(params.select("path", "fn", F.col("root").alias("name"), (F.row_number().over(Window.partitionBy("path", "fn").orderBy("first")) - 1).alias("place")), "parameters")

    # the scope that binds a name: the innermost one around that has it as a parameter or declares it
    plain = own(names.where("p1 in ('const', 'let', 'var') and root is not null").select("path", "at", F.col("root").alias("name")))
    binding = params.select("path", "fn", "name").union(plain.select("path", "fn", "name")).union(defs.where("declared").select("path", "fn", "name")).distinct()
    binding = written(binding.withColumnRenamed("fn", "up"), "bindings")

    def resolved(df: DataFrame) -> DataFrame:
        """df (path, fn, name, ...) with `scope`."""
        asked = df.select("path", "fn", "name").distinct()
        scope = asked.join(up, ["path", "fn"]).join(binding, ["path", "up", "name"]).groupBy("path", "fn", "name").agg(F.min_by("up", "far").alias("scope"))
        return df.join(scope, ["path", "fn", "name"], "left").withColumn("scope", F.coalesce("scope", F.lit(MODULE)))

    # functions that calls reach: of the same file, or imported
    first_of = fns.where("name is not null").groupBy("path", "name").agg(F.min("fn").alias("g_fn")).withColumnsRenamed({"path": "g_path", "name": "g_name"})
    taken = imports(files)
    local = calls.where("receiver = ''").select("path", F.col("first").alias("call"), F.col("path").alias("g_path"), F.col("method").alias("g_name"), F.lit(0).alias("rank"))
    by_name = calls.where("receiver = ''").join(taken.where("original is not null").withColumnRenamed("local", "method"), ["path", "method"]).select("path", F.col("first").alias("call"), F.col("target").alias("g_path"), F.col("original").alias("g_name"), F.lit(1).alias("rank"))
    by_module = calls.join(taken.select("path", F.col("local").alias("receiver"), "target").distinct(), ["path", "receiver"]).select("path", F.col("first").alias("call"), F.col("target").alias("g_path"), F.col("method").alias("g_name"), F.lit(2).alias("rank"))
    reached = local.union(by_name).union(by_module).join(first_of, ["g_path", "g_name"])
    reached = written(reached.groupBy("path", "call").agg(F.min_by(F.struct("g_path", "g_fn"), "rank").alias("g")).select("path", "call", "g.g_path", "g.g_fn"), "reached")

    # what stands in expressions: sources, variables, calls of functions
    clean = calls.where(is_sanitizer(F.col("lang"), F.col("receiver"), F.col("method")))
    cleaned = clean.select("path", F.col("start").alias("first"))
    index = toks.where("p1 = '[' and n1 = ']'").select("path", F.col("p1_at").alias("n1_at"), F.concat(F.lit("["), "text", F.lit("]")).alias("index"))
    key = F.coalesce(F.col("p1").isin("{", ","), F.lit(False)) & F.coalesce(F.col("n1") == ":", F.lit(False)) & (F.col("lang") != "python")
    some = names.where(F.col("root").isNotNull() & ~key).join(cleaned, ["path", "first"], "left_anti").withColumn("source", is_source(F.col("lang"), F.col("text")))
    some = some.join(index, ["path", "n1_at"], "left")
    called = F.coalesce(F.col("n1") == "(", F.lit(False))
    assigned = F.coalesce(F.col("n1").isin("=", "+="), F.lit(False))
    label = F.when(F.col("source"), F.concat("text", F.coalesce("index", F.lit(""))))
    items = some.where(F.col("source") | ~assigned & ~(called & ~F.col("text").contains("."))).select("path", F.col("first").alias("at"), F.col("root").alias("name"), label.alias("label"), "line", F.lit(None).cast("string").alias("g_path"), F.lit(None).cast("int").alias("g_fn"))
    answers = calls.withColumnRenamed("first", "call").join(reached, ["path", "call"]).select("path", F.col("start").alias("at"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("label"), "line", "g_path", "g_fn")
    items = S.enclosing(items.unionByName(answers), clean.select("path", "first", "last", F.col("first").alias("by")), ["by"])
    items = written(resolved(own(items)), "items")
    cell = [
        F.when(F.col("label").isNull(), F.coalesce("g_path", "path")).alias("c_path"), F.when(F.col("label").isNull(), F.coalesce("g_fn", "scope")).alias("c_scope"),
        F.when(F.col("label").isNull(), F.when(F.col("g_fn").isNotNull(), "()").otherwise(F.col("name"))).alias("c_name"), F.when(F.col("g_fn").isNotNull(), F.lit(FAR)).otherwise(F.col("at")).alias("before"),
    ]
    unclean = lambda first: F.col("in_by").isNull() | (F.col("in_by") < F.col(first))

    # into variables and returns
    held = S.enclosing(items, sets.select("path", F.col("at").alias("first"), F.col("until").alias("last"), F.col("at").alias("set"), F.col("fn").alias("s_fn")), ["set", "s_fn"]).where((F.col("in_s_fn") == F.col("fn")) & unclean("in_set"))
    held = written(held.select("path", F.col("in_set").alias("set"), *cell, "label", "line"), "held")
    into = resolved(defs).select("path", F.col("at").alias("set"), F.col("scope").alias("d_scope"), F.col("name").alias("d_name"), F.col("until").alias("at"))
    back = sets.where(f"text = 'return' and fn <> {MODULE}").select("path", F.col("at").alias("set"), F.col("fn").alias("d_scope"), F.lit("()").alias("d_name"), F.lit(-1).cast("long").alias("at"))
    flows = held.join(into.unionByName(back), ["path", "set"]).select(*CELL, "before", "label", "line", F.col("path").alias("d_path"), "d_scope", "d_name", "at", F.lit(0).alias("hop"), "path")

    # into calls: those around an item within its function, and which argument it stands in
    around = own(calls.select("path", F.col("first").alias("at"), "last"))
    inner = S.enclosing(around, calls.select("path", "first", "last", F.col("first").alias("call")), ["call"]).where("in_call is not null")
    parent = written(inner.select("path", "fn", F.col("at").alias("call"), F.col("in_call").alias("up")).join(around.select("path", "fn", F.col("at").alias("up")), ["path", "fn", "up"]), "nested")
    rows = S.enclosing(items, calls.select("path", "first", "last", F.col("first").alias("call")), ["call"]).where("in_call is not null").withColumnRenamed("in_call", "call").join(around.select("path", "fn", F.col("at").alias("call")), ["path", "fn", "call"])
    rows = written(rows, "inner-arguments")
    every, front = [rows], rows
    while not front.isEmpty():  # as many rounds as calls are nested within a function
        front = front.join(parent, ["path", "fn", "call"]).drop("call").withColumnRenamed("up", "call").select(*rows.columns)
        front = written(front, "outer-arguments")
        every.append(front)
    passed = reduce(DataFrame.unionByName, every).where(unclean("call"))
    commas = S.enclosing(toks.where("text = ','").select("path", "at"), calls.select("path", "first", "last", F.col("first").alias("call")), ["call"])
    direct = S.enclosing(commas, pairs.select("path", "first", "last", F.col("first").alias("bracket")), ["bracket"]).where("in_call = in_bracket").select("path", F.col("in_call").alias("call"), F.col("at").alias("comma"))
    parted = direct.groupBy("path", "call").agg(F.collect_list("comma").alias("commas"))
    passed = passed.join(parted, ["path", "call"], "left").withColumn("place", F.coalesce(F.size(F.filter("commas", lambda c: c < F.col("at"))), F.lit(0)))
    passed = written(passed.select("path", "call", "place", *cell, "label", "line"), "passed")
    seeded = reached.join(params.select(F.col("path").alias("g_path"), F.col("fn").alias("g_fn"), F.col("name").alias("d_name"), "place"), ["g_path", "g_fn"])
    given = passed.join(seeded, ["path", "call", "place"]).select(*CELL, "before", "label", "line", F.col("g_path").alias("d_path"), F.col("g_fn").alias("d_scope"), "d_name", F.lit(-1).cast("long").alias("at"), F.lit(1).alias("hop"), "path")
    moves = written(flows.unionByName(given), "moves")
    target = ["d_path", "d_scope", "d_name"]
    seeds = moves.where("label is not null").select(*[F.col(d).alias(c) for d, c in zip(target, CELL, strict=True)], "at", "hop", F.col("label").alias("source"), F.col("path").alias("s_path"), F.col("line").alias("s_line"))
    edges = moves.where("label is null").select(*CELL, "before", *target, "at", "hop")

    # into sinks
    hits = calls.withColumn("sink", sink_of(F.col("lang"), "call", F.col("receiver"), F.col("method"))).where("sink is not null").select("path", F.col("first").alias("call"), "sink", F.col("line").alias("at_line"))
    read = passed.join(hits, ["path", "call"])
    member = equals.where("p2 = '.'").withColumn("sink", sink_of(F.col("lang"), "assign", F.lit("*"), F.col("p1"))).where("sink is not null").select("path", F.col("at").alias("set"), "sink", F.col("line").alias("at_line"))
    read = read.drop("call", "place").unionByName(held.join(member, ["path", "set"]).drop("set"))
    reads = read.select("path", F.col("at_line").alias("line"), F.col("sink.id").alias("sink"), F.col("sink.type").alias("type"), *CELL, "before", "label", F.col("line").alias("s_line"))
    return Facts(written(seeds, "seeds"), written(edges, "edges"), written(reads, "reads"))


def fixpoint(seeds: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(cell, hops, at, source, s_path, s_line): the cells that a source reaches, from where on, over at most `depth` calls.

    Semi-naive: a round joins only cells that are new, or tainted from an earlier place than known, with the edges. The
    source of a cell is the one that reaches it in the fewest steps; of several, that which does so first in the text, then
    by path, line and name.
    """
    info = ["at", "s_path", "s_line", "source"]
    best = lambda df: df.groupBy(*CELL, "hops").agg(F.min(F.struct(*info)).alias("x")).select(*CELL, "hops", "x.*")
    known = delta = written(best(seeds.withColumnRenamed("hop", "hops")), "tainted")
    while not delta.isEmpty():
        met = delta.withColumnRenamed("at", "since").join(edges, CELL).where(f"since < before and hops + hop <= {int(depth)}")
        moved = best(met.select(F.col("d_path").alias("c_path"), F.col("d_scope").alias("c_scope"), F.col("d_name").alias("c_name"), (F.col("hops") + F.col("hop")).alias("hops"), *info))
        old = known.select(*CELL, "hops", F.col("at").alias("known_at"), F.struct("s_path", "s_line", "source").alias("old"))
        # with fewer calls on the way the same or more is reached, so the number of calls is part of the key
        new = moved.join(old, [*CELL, "hops"], "left").where("known_at is null or at < known_at")
        delta = written(new.select(*CELL, "hops", "at", *[F.coalesce(F.col(f"old.{c}"), F.col(c)).alias(c) for c in info[1:]]), "delta")
        known = written(known.join(delta.select(*CELL, "hops"), [*CELL, "hops"], "left_anti").unionByName(delta), "tainted")
    return known


def taint(files: DataFrame, depth: int = 3) -> DataFrame:
    """(source, s_path, s_line, path, sink, type, line, hops): sources of files (path, text, lang) that reach a sink, within a function, across functions or files.

    One row for each source, sink and line; hops is the least number of calls on the way.
    """
    f = facts(files)
    held = fixpoint(f.seeds, f.edges, depth)
    direct = f.reads.where("label is not null").select(F.col("label").alias("source"), F.col("path").alias("s_path"), "s_line", "path", "sink", "type", "line", F.lit(0).alias("hops"))
    through = f.reads.where("label is null").drop("label", "s_line").join(held, CELL).where("at < before").select("source", "s_path", "s_line", "path", "sink", "type", "line", "hops")
    found = direct.unionByName(through)
    return found.groupBy("source", "s_path", "path", "sink", "type", "line").agg(F.min("s_line").alias("s_line"), F.min("hops").alias("hops"))


def sinks(files: DataFrame) -> DataFrame:
    """(path, line, sink, type, severity, function, in_try): sinks of files (path, text, lang) that pass the gates of their rules.

    A call takes the first rule that matches it and whose gate it passes: none; a first argument that is no literal; or a
    source that reaches it. Of the calls of a line just one stands for each type, the first. function is the innermost one
    around, null at the top.
    """
    toks = written(S.tokens(files), "tokens")
    pairs = written(S.brackets(toks), "brackets")
    fns = written(S.functions(toks, pairs), "functions")
    calls = written(S.calls(S.chains(toks), pairs, fns), "calls")
    rows = [(rank, id_, type_, severity, language, form, receiver, name, gate) for rank, (id_, type_, severity, languages, matchers, gate) in enumerate(rules.SINKS, 1) for language in languages for form, receiver, name in matchers]
    table_ = F.broadcast(files.sparkSession.createDataFrame(rows, "rank int, sink string, type string, severity string, lang string, form string, wanted string, method string, gate string"))  # fixed: a row for each matcher
    named = (F.col("wanted") == F.col("receiver")) | (F.col("wanted") == "*") & (F.col("receiver") != "")
    of = calls.join(table_.where("form = 'call'"), ["lang", "method"]).where(named)
    # the first argument: up to the first comma of the call's own, or to its end
    commas = S.enclosing(toks.where("text = ','").select("path", "at"), pairs.select("path", "first", "last", F.col("first").alias("bracket")), ["bracket"]).groupBy("path", F.col("in_bracket").alias("first")).agg(F.min("at").alias("comma"))
    firsts = of.select("path", "first", "last").distinct().join(commas, ["path", "first"], "left").select("path", "first", F.coalesce("comma", "last").alias("last"), F.col("first").alias("call"))
    inside = S.enclosing(toks.select("path", "at", "text", "lang"), firsts, ["call"]).where("in_call is not null")
    word = F.col("text").rlike(S.NAME) & ~F.col("text").isin("true", "false", "null", "None", "True", "False", "undefined")
    shape = inside.groupBy("path", F.col("in_call").alias("first")).agg(F.count("*").alias("n"), F.min_by("text", "at").alias("head"), F.max((F.col("text") == "=>").cast("int")).alias("arrow"), F.max((word | (F.col("text") == "`(")).cast("int")).alias("open"))
    literal = (F.col("arrow") == 1) | F.col("head").isin("function", "lambda", "async") | ((F.col("n") == 1) | F.col("head").isin("[", "{")) & (F.col("open") == 0)
    of = of.join(shape.select("path", "first", (~literal).alias("open")), ["path", "first"], "left")
    reached = taint(files, 0).select("path", "line", "sink", F.lit(True).alias("reached")).distinct()
    of = of.join(reached, ["path", "line", "sink"], "left")
    passes = F.when(F.col("gate") == "not literal", F.coalesce("open", F.lit(False))).when(F.col("gate") == "user input", F.coalesce("reached", F.lit(False))).otherwise(True)
    found = of.where(passes).select("path", F.col("start").alias("at"), "line", "sink", "type", "severity", "rank")
    # assignments to members and attributes: no literal on the right
    sets = toks.where("text = '=' and lang <> 'python'").withColumn("plain", (F.col("n1").rlike("^['\"`0-9]")) & (F.col("n1") != "`("))
    member = sets.where("p2 = '.'").join(table_.where("form = 'assign'").withColumnRenamed("method", "p1"), ["lang", "p1"]).where((F.col("gate") == "none") | ~F.col("plain"))
    attribute = sets.where("p2 is null or p2 not in ('.', '?.')").join(table_.where("form = 'jsx'").withColumnRenamed("method", "p1"), ["lang", "p1"])
    found = found.unionByName(member.unionByName(attribute).select("path", "at", "line", "sink", "type", "severity", "rank"))
    one = found.withColumn("x", F.row_number().over(Window.partitionBy("path", "line", "type").orderBy("at", "rank"))).where("x = 1").withColumn("y", F.row_number().over(Window.partitionBy("path", "at").orderBy("rank"))).where("y = 1")
    return S.sites(one.drop("x", "y"), fns, S.tries(toks, pairs)).select("path", "line", "sink", "type", "severity", "function", "in_try")


def fix_tests(fixes: DataFrame) -> DataFrame:
    """(id, passes, syntax_valid, effective, new_sinks, new_flows, gone_sinks, gone_flows, functions_removed) for fixes (id, lang, type, before, after).

    Sinks are compared by line and type, flows by source, sink and line, functions by name: what one text has and the other
    hasn't is an anti join on those keys, in both directions. A fix is effective if the type it is about was there and is
    gone, or, without a type, if there are fewer sinks or flows. It passes if its brackets match, it brings no new sink or
    flow, and it is effective or about no type. Null texts have nothing in them; an id is one fix.
    """
    side = lambda name: fixes.select(F.concat(F.lit(name + "/"), F.col("id").cast("string")).alias("path"), F.col(name).alias("text"), "lang")
    files = written(side("before").unionByName(side("after")), "fixes")
    toks = written(S.tokens(files), "tokens")
    pairs = written(S.brackets(toks), "brackets")
    named = lambda df: df.withColumn("when", F.substring_index("path", "/", 1)).withColumn("key", F.expr("substring(path, instr(path, '/') + 1)"))
    found, flows = written(named(sinks(files)), "fix-sinks"), written(named(taint(files, 0)), "fix-flows")
    names = written(named(S.functions(toks, pairs).where("name is not null").select("path", "name").distinct()), "fix-functions")

    def lost(df: DataFrame, here: str, there: str, on: list[str]) -> DataFrame:
        """What is in one text and not in the other."""
        return df.where(F.col("when") == here).join(df.where(F.col("when") == there).select("key", *on), ["key", *on], "left_anti")

    count = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    by_sink, by_flow = ["line", "type"], ["source", "sink", "line"]
    marks = named(toks.where(F.col("text").isin(S.OPEN + S.CLOSE))).where("when = 'after'").groupBy("key").agg(F.count("*").alias("marks"))
    paired = count(named(pairs).where("when = 'after'"), "paired")
    types = found.select("key", "when", "type").union(flows.select("key", "when", "type"))
    asked = fixes.select(F.col("id").cast("string").alias("key"), F.col("type").alias("about"), "id")
    there = types.join(asked, [types.key == asked.key, types.type == asked.about]).groupBy(asked.key).agg(F.max((F.col("when") == "before").cast("int")).alias("had"), F.max((F.col("when") == "after").cast("int")).alias("has"))
    size = lambda df, name: df.groupBy("key").agg(F.count(F.when(F.col("when") == "before", 1)).alias(f"{name}_before"), F.count(F.when(F.col("when") == "after", 1)).alias(f"{name}_after"))
    parts = [
        count(lost(found, "after", "before", by_sink), "new_sinks"), count(lost(flows, "after", "before", by_flow), "new_flows"), count(lost(found, "before", "after", by_sink), "gone_sinks"), count(lost(flows, "before", "after", by_flow), "gone_flows"),
        lost(names, "before", "after", ["name"]).groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("functions_removed")), marks, paired, there, size(found, "s"), size(flows, "f"),
    ]
    rows = reduce(lambda a, b: a.join(b, "key", "left"), parts, asked).fillna(0, [c for p in parts for c in p.columns if c not in ("key", "functions_removed")])
    effective = F.when(F.col("about").isNotNull(), (F.col("had") == 1) & (F.col("has") == 0)).otherwise((F.col("s_before") > F.col("s_after")) | (F.col("f_before") > F.col("f_after")))
    rows = rows.withColumn("effective", effective).withColumn("syntax_valid", F.col("marks") == 2 * F.col("paired"))
    passes = F.col("syntax_valid") & (F.col("new_sinks") == 0) & (F.col("new_flows") == 0) & (F.col("effective") | F.col("about").isNull())
    return rows.select("id", passes.alias("passes"), "syntax_valid", "effective", "new_sinks", "new_flows", "gone_sinks", "gone_flows", F.coalesce("functions_removed", F.array().cast("array<string>")).alias("functions_removed"))


# ---- registered on code that the lines of the documents turn into

_LINES = "l AS (SELECT doc_id, k - 1 AS k, (k - 1) % 5 AS a, length(s) % 5 AS b, (doc_id * 7 + (k - 1) * 3 + length(s)) % 8 AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL))"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each document, a statement for each line of it: which one, and on what variables, depends on the line."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "s"))
    a, b = (F.concat(F.lit("v"), (x % 5).cast("string")) for x in (F.col("k"), F.length("s")))
    k = F.col("k").cast("string")
    forms = [
        F.concat(F.lit("let "), a, F.lit(" = req.body.f"), k, F.lit(";")), F.concat(a, F.lit(" = "), b, F.lit(";")), F.concat(a, F.lit(" = parseInt("), b, F.lit(");")), F.concat(F.lit("exec("), a, F.lit(");")),
        F.concat(F.lit("function g"), k, F.lit("(p) { db.query('x' + "), a, F.lit("); }")), F.concat(a, F.lit(" = 'lit (' + "), b, F.lit(" + `{`;")), F.concat(F.lit("// exec("), a, F.lit(") {")),
        F.concat(F.lit("try { run(`a ${"), a, F.lit("} b`); } catch (e) { eval("), a, F.lit("); }")),
    ]
    of = (F.col("doc_id") * 7 + F.col("k") * 3 + F.length("s")) % 8
    text = F.element_at(F.array(*forms), (of + 1).cast("int"))
    made = lines.select("doc_id", F.struct("k", text.alias("x")).alias("x")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["x"]), "\n").alias("text"))
    return made.select(F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), "text", F.lit("javascript").alias("lang"))


@R.frame(f"""WITH {_LINES}, c(t, n, receiver, method, nested, in_try) AS (VALUES (2, 1, '', 'parseInt', false, false), (3, 1, '', 'exec', false, false), (4, 1, 'db', 'query', true, false), (7, 1, '', 'run', false, true), (7, 2, '', 'eval', false, true))
 SELECT 'src/d' || doc_id || '.js' AS path, CAST(k + 1 AS INT) AS line, receiver, method, CASE WHEN nested THEN 'g' || k END AS function, in_try FROM l JOIN c ON c.t = l.t""")
def code_call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = written(S.tokens(code_files(spark, sf_dir)), "tokens")
    pairs = written(S.brackets(toks), "brackets")
    fns = written(S.functions(toks, pairs), "functions")
    calls = S.calls(S.chains(toks), pairs, fns).select("path", F.col("start").alias("at"), "line", "receiver", "method")
    return S.sites(calls, fns, S.tries(toks, pairs)).select("path", "line", "receiver", "method", "function", "in_try")


@R.frame(f"""WITH RECURSIVE {_LINES}, held(doc_id, v, k) AS (SELECT doc_id, a, k FROM l WHERE t = 0 UNION SELECT l.doc_id, l.a, l.k FROM held h JOIN l ON l.doc_id = h.doc_id AND l.t IN (1, 5) AND l.b = h.v AND l.k > h.k),
 since AS (SELECT doc_id, v, min(k) AS k FROM held GROUP BY doc_id, v)
 SELECT 'src/d' || l.doc_id || '.js' AS path, CAST(l.k + 1 AS INT) AS line, CASE l.t WHEN 3 THEN 'exec' WHEN 4 THEN 'sql-concat' ELSE 'eval' END AS sink, CASE l.t WHEN 4 THEN 'sql_injection' ELSE 'command_injection' END AS type
 FROM l JOIN since ON since.doc_id = l.doc_id AND since.v = l.a AND since.k < l.k WHERE l.t IN (3, 4, 7)""")
def code_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint(code_files(spark, sf_dir)).select("path", "line", "sink", "type").distinct()
