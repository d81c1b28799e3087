"""A project as tables: routes, middleware, mounts, endpoints and who guards them, schemas, symbols. All of it from the syntax tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import rules
from palisade.operators import dataflow, endpoints
from palisade.operators import syntax as S
from palisade.plans.registry import Registry, table
from palisade.plans.scratch import written

R = Registry()

#: Who registers routes, by which methods, and names of Django's route functions.
ROUTERS = ["app", "router", "server", "fastify", "api", "route", "controller", "rtr", "blueprint", "bp"]
ROUTE_METHODS = ["get", "post", "put", "patch", "delete", "head", "options", "all", "route"]
DJANGO_ROUTES = ["path", "re_path", "url"]
NEXT_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
#: Events and receivers of sockets, and events that others have too.
SOCKET_EVENTS = ["connection", "message", "disconnect", "error", "close", "open", "upgrade", "ping", "pong", "listening", "unexpected-response", "handshake", "data", "end"]
SOCKETS = ["ws", "wss", "socket", "io", "sio", "websocket", "client", "connection", "sock"]
COMMON_EVENTS = ["error", "end", "data"]
#: How sure a statement is that is written out, found through a constant of the file, or neither.
LITERAL, CONSTANT, OPEN = 1.0, 0.6, 0.2
#: Receivers and functions that build a response, and frameworks' own receivers: no calls of a handler's graph.
RESPONSE_RECEIVERS = ["res", "response", "reply", "ctx", "NextResponse", "JsonResponse", "HttpResponse", "HttpResponseRedirect"]
RESPONSE_BUILDERS = ["redirect", "HttpResponseRedirect", "render", "render_template", "FileResponse", "send_file", "StreamingHttpResponse", "JsonResponse", "jsonify", "HttpResponse"]
FRAMEWORKS = ["app", "router", "fastify", "server"]
#: Methods that run a schema against a value, and builders of object schemas: (library, receiver, methods).
VALIDATES = ["parse", "safeParse", "parseAsync", "safeParseAsync", "validate", "validateAsync", "validateSync", "cast", "load", "model_validate", "parse_obj"]
BUILDERS = [("zod", "^(z|zod)$", ["object", "strictObject"]), ("joi", "^(?i:joi)$", ["object"]), ("yup", "^yup$", ["object", "shape"])]
#: Decorators of Django views that ask for a session.
SESSION_DECORATORS = ["@login_required", "@permission_required", "@staff_member_required", "@user_passes_test"]


@dataclass
class Index:
    """The syntax tables of files (path, text, lang), each written once, and the files' modules found among them."""

    files: DataFrame
    toks: DataFrame
    pairs: DataFrame
    fns: DataFrame
    names: DataFrame
    calls: DataFrame
    args: DataFrame
    imports: DataFrame


def index(files: DataFrame) -> Index:
    files = files.select("path", "text", "lang")
    toks = written(S.tokens(files), "tokens")
    pairs = written(S.brackets(toks), "brackets")
    fns = written(S.functions(toks, pairs), "functions")
    names = written(S.chains(toks), "names")
    calls = written(S.calls(names, pairs, fns), "calls")
    return Index(files, toks, pairs, fns, names, calls, written(arguments(toks, pairs, calls), "arguments"), written(modules(files), "imports"))


def modules(files: DataFrame) -> DataFrame:
    """(path, local, spec, target): what a file imports under which name, from which module; target is the file, where it is one of them."""
    script = r"import\s+(?:type\s+)?[\w$*{}\s,]+?\s+from\s+['\"][^'\"]+['\"]|(?:const|let|var)\s+(?:[\w$]+|\{[^}]*\})\s*=\s*require\(\s*['\"][^'\"]+['\"]\s*\)"
    python = r"(?m)^[ \t]*(?:from\s+[\w.]+\s+)?import\s+[^\n#]+"
    js = F.col("lang") != "python"
    one = files.where("text is not null").select("path", js.alias("js"), F.explode(F.when(js, F.regexp_extract_all("text", F.lit(script), F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(python), F.lit(0)))).alias("x"))
    names = F.when(F.col("js"), F.regexp_extract("x", r"(?:import\s+(?:type\s+)?|const\s+|let\s+|var\s+)([\w$*{}\s,:]+?)\s*(?:from|=)", 1)).otherwise(F.regexp_extract("x", r"import\s+([^\n#]+)", 1))
    each = one.select("path", "js", "x", F.explode(F.split(F.regexp_replace(names, r"[(){}*]", ""), ",")).alias("part")).withColumn("part", F.trim("part"))
    module = F.regexp_extract("x", r"from\s+([\w.]+)", 1)
    dots = F.length(F.regexp_extract(module, r"^(\.+)", 1))
    path = F.concat(F.when(dots == 1, "./").otherwise(F.repeat(F.lit("../"), dots - 1)), F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/"))
    spec = F.when(F.col("js"), F.regexp_extract("x", r"['\"]([^'\"]+)['\"]", 1)).when(module == "", F.regexp_extract("part", r"^([\w.]+)", 1)).when(module.rlike(r"^\.+$"), F.concat(path, F.regexp_extract("part", r"^(\w+)", 1))).when(dots > 0, path).otherwise(module)
    local = F.regexp_extract("part", r"([\w$]+)$", 1)
    found = each.select("path", F.when(~F.col("js") & (module == "") & ~F.col("part").contains(" as "), F.regexp_extract("part", r"^(\w+)", 1)).otherwise(local).alias("local"), spec.alias("spec")).where("local <> ''").distinct()
    targets = dataflow.imports(files).groupBy("path", "local").agg(F.min("target").alias("target"))
    return found.join(targets, ["path", "local"], "left")


def arguments(toks: DataFrame, pairs: DataFrame, calls: DataFrame) -> DataFrame:
    """(path, call, place, lo, hi, n, head, text, kind): the arguments of calls, between lo and hi.

    text: the tokens that stand in no argument of a call inside; kind: string, template, name, member, function, call or other.
    """
    commas = S.enclosing(toks.where("text = ','").select("path", "at"), pairs.select("path", "first", "last", F.col("first").alias("bracket")), ["bracket"])
    commas = commas.groupBy("path", F.col("in_bracket").alias("first")).agg(F.array_sort(F.collect_list("at")).alias("commas"))
    cut = F.concat(F.array("first"), F.coalesce("commas", F.array().cast("array<int>")), F.array("last"))
    rows = calls.join(commas, ["path", "first"], "left").select("path", F.col("first").alias("call"), cut.alias("cut"))
    rows = rows.select("path", "call", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("cut") - 1), lambda i: F.struct(F.element_at("cut", i).alias("lo"), F.element_at("cut", i + 1).alias("hi")))).alias("place", "x"))
    rows = rows.select("path", "call", "place", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))
    inside = S.enclosing(toks.select("path", "at", "text"), rows, ["call", "place", "lo", "hi"], first="lo", last="hi").where("in_call is not null")
    shape = inside.groupBy("path", F.col("in_call").alias("call"), F.col("in_place").alias("place"), F.col("in_lo").alias("lo"), F.col("in_hi").alias("hi")).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"))
    text = F.transform("x", lambda y: y["text"])
    shape = shape.select("path", "call", "place", "lo", "hi", F.size("x").alias("n"), F.col("x")[0]["text"].alias("head"), F.element_at("x", -1)["text"].alias("tail"), F.array_join(text, "").alias("text"), F.exists(text, lambda y: y.isin("=>", "function", "lambda")).alias("is_function"))
    kind = (
        F.when(F.col("is_function"), "function").when((F.col("n") == 1) & F.col("head").rlike("^[rRbBuUfF]*['\"]"), "string").when((F.col("n") == 1) & F.col("head").startswith("`"), "template")
        .when((F.col("n") == 1) & F.col("head").rlike(S.NAME), "name").when(F.col("text").rlike(r"^[A-Za-z_$][\w$]*(\??\.[A-Za-z_$][\w$]*)+$"), "member").when((F.col("tail") == ")") & F.col("head").rlike(S.NAME), "call").otherwise("other")
    )
    return shape.select("path", "call", "place", "lo", "hi", "n", "head", "text", kind.alias("kind"))


def unquoted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^[rRbBuUfF]*('''|\"\"\"|['\"`])", ""), "('''|\"\"\"|['\"`])$", "")


def constants(ix: Index) -> DataFrame:
    """(path, name, value): names to which a statement assigns just one string; the last of a file counts."""
    ends = ix.toks.select("path", F.col("p1_at").alias("at"), F.col("text").alias("n2"), "fresh")
    one = ix.toks.where("p1 = '='").where(F.col("p2").rlike(S.NAME) & ~F.coalesce(F.col("p3").isin(".", "?."), F.lit(False)) & F.col("text").rlike("^[rRbBuU]*['\"]")).select("path", "at", F.col("p2").alias("name"), "text")
    one = one.join(ends, ["path", "at"], "left").where("n2 is null or fresh or n2 in (';', ',', '}')")
    return one.groupBy("path", "name").agg(unquoted(F.max_by("text", "at")).alias("value"))


def _argument(ix: Index, place: int, name: str) -> DataFrame:
    return ix.args.where(F.col("place") == place).select("path", "call", F.struct("kind", "text", "head", "lo", "hi", "n").alias(name))


def _sized(ix: Index, calls: DataFrame) -> DataFrame:
    """calls with `call`, `first` argument (null without any) and `n_args`."""
    count = ix.args.groupBy("path", "call").agg(F.count("*").alias("n_args"))
    return calls.withColumnRenamed("first", "call").join(count, ["path", "call"]).join(_argument(ix, 0, "arg"), ["path", "call"])


def _path(ix: Index, rows: DataFrame) -> DataFrame:
    """rows with route `route` and its confidence, from the argument `arg`."""
    known = constants(ix).select("path", F.col("name").alias("_name"), "value")
    rows = rows.join(known, [rows.path == known.path, F.col("arg.kind") == "name", F.col("arg.text") == F.col("_name")], "left").drop(known.path)
    written_out = F.col("arg.kind") == "string"
    plain = (F.col("arg.kind") == "template") & ~F.col("arg.text").contains("${")
    return rows.withColumn("route", F.when(written_out | plain, unquoted(F.col("arg.text"))).when(F.col("value").isNotNull(), F.col("value")).otherwise("?")).withColumn("sure", F.when(written_out | plain, LITERAL).when(F.col("value").isNotNull(), CONSTANT).otherwise(OPEN)).drop("_name", "value")


def routes(ix: Index) -> DataFrame:
    """(path, call, line, framework, method, route, sure, receiver, decorated, n_args): registrations of routes, by calls, decorators and Django's lists.

    A route is a string, a template or a name; of the latter two one alone, without a handler, is a getter.
    """
    at = ix.names.where("p1 = '@'").select("path", F.col("first").alias("start"), F.lit(True).alias("decorated"))
    calls = _sized(ix, ix.calls).join(at, ["path", "start"], "left").withColumn("decorated", F.coalesce("decorated", F.lit(False)))
    tokened = (F.col("arg.kind") == "other") & F.col("arg.text").startswith("`(")
    by_call = calls.where(F.col("receiver").isin(ROUTERS) & F.lower("method").isin(ROUTE_METHODS)).where((F.col("arg.kind") == "string") | (F.col("arg.kind").isin("name", "template") | tokened) & ((F.col("n_args") > 1) | F.col("decorated")))
    verb = F.when(F.lower("method").isin("all", "route"), "ALL").otherwise(F.upper("method"))
    by_call = _path(ix, by_call).select("path", "call", "line", F.when(F.col("decorated"), "fastapi").otherwise("express").alias("framework"), verb.alias("method"), "route", "sure", "receiver", "decorated", "n_args")
    lists = ix.toks.where("p1 in ('=', '+=') and p2 = 'urlpatterns' and text = '['").select("path", F.col("at").alias("first")).join(ix.pairs.select("path", "first", "last"), ["path", "first"])
    entries = calls.where(F.col("receiver").isin("") & F.col("method").isin(DJANGO_ROUTES) & (F.col("arg.kind") == "string"))
    entries = S.enclosing(entries, lists.select("path", "first", "last", F.lit(True).alias("list")), ["list"], at="start").where("in_list")
    django = entries.select("path", "call", "line", F.lit("django").alias("framework"), F.lit("ALL").alias("method"), unquoted(F.col("arg.text")).alias("route"), F.lit(LITERAL).alias("sure"), "receiver", "decorated", "n_args")
    return by_call.unionByName(django)


def middleware(ix: Index) -> DataFrame:
    """(path, call, line, place, prefix, name, base, from_file, sure): what use() registers, in order; prefix null for all paths, '?' for one that can't be told.

    base is the name without the call; a name that is imported is sure, and from_file says from which module.
    """
    uses = _path(ix, _sized(ix, ix.calls.where(F.col("receiver").isin(ROUTERS) & (F.col("method") == "use"))))
    led = (F.col("n_args") > 1) & (F.col("arg.kind").isin("string", "template") | (F.col("sure") > OPEN))
    uses = uses.select("path", "call", "line", led.alias("led"), F.when(led, F.col("route")).alias("prefix"))
    each = uses.join(ix.args.select("path", "call", "place", "text", "kind"), ["path", "call"]).where("not led or place > 0")
    base = F.regexp_extract("text", r"^([A-Za-z_$][\w$]*)", 1)
    each = each.withColumn("base", F.when(base == "", F.col("text")).otherwise(base))
    taken = ix.imports.groupBy("path", F.col("local").alias("base")).agg(F.min("spec").alias("spec"), F.min("target").alias("target"))
    each = each.join(taken, ["path", "base"], "left")
    return each.select("path", "call", "line", "place", "prefix", F.col("text").alias("name"), "base", "kind", F.coalesce("spec", "path").alias("from_file"), "target", F.when(F.col("spec").isNotNull(), LITERAL).otherwise(CONSTANT).alias("sure"))


def sockets(ix: Index) -> DataFrame:
    """(path, line, receiver, event): socket handlers: an event of sockets, or any event of what is named like one. Events that other emitters have too need such a name."""
    rows = _sized(ix, ix.calls.where("method in ('on', 'addEventListener', 'handle') and receiver <> ''")).where("arg.kind = 'string'")
    of = F.lower(F.substring_index("receiver", ".", -1))
    named = of.isin(SOCKETS) | of.rlike("^(ws|socket|io|wss|sock)[0-9_]") | of.rlike("[0-9_](ws|socket|io)$")
    event = unquoted(F.col("arg.text"))
    return rows.where((event != "") & (named | F.lower(event).isin(SOCKET_EVENTS) & ~event.isin(COMMON_EVENTS))).select("path", "line", "receiver", event.alias("event"))


# ---- functions and what they hold


def function_texts(ix: Index) -> DataFrame:
    """(path, fn, name, first, last, line, end_line, head, text): functions with the lines that they take up."""
    lines = F.slice(F.split("text", "\n"), F.col("line"), F.col("end_line") - F.col("line") + 1)
    return ix.fns.join(ix.files.select("path", "text"), "path").withColumn("text", F.array_join(lines, "\n"))


def function_text(ix: Index, name: str) -> DataFrame:
    """(path, text) of the first function of that name in each file that has one."""
    return function_texts(ix).where(F.col("name") == name).groupBy("path").agg(F.min_by("text", "first").alias("text"))


def call_graph(ix: Index) -> DataFrame:
    """(path, caller, callee, line): the distinct callees of each named function, by first line; a call counts for the innermost one."""
    bodies = ix.fns.where("name is not null").select("path", "first", "last", "name")
    inside = S.enclosing(ix.calls.select("path", F.col("start").alias("at"), "method", "line"), bodies, ["name"]).where("in_name is not null")
    return inside.groupBy("path", F.col("in_name").alias("caller"), F.col("method").alias("callee")).agg(F.min("line").alias("line"))


def decorators(ix: Index) -> DataFrame:
    """(path, fn, line, text): the decorator lines of each function, those that no other statement parts from it."""
    lines = ix.toks.where("text = '@' and fresh").select("path", "at", "line")
    starts = ix.toks.where("fresh and lang = 'python' and text <> '@'").select("path", "at", F.col("at").alias("next"))
    both = lines.select("path", "at", "line", F.lit(None).cast("int").alias("next")).unionByName(starts.select("path", "at", F.lit(None).cast("int").alias("line"), "next"))
    ahead = both.withColumn("first", F.last("next", ignorenulls=True).over(Window.partitionBy("path").orderBy(F.desc("at")))).where("line is not null")
    found = ahead.join(ix.fns.select("path", "first", "fn"), ["path", "first"]).join(ix.files.select("path", "text"), "path")
    return found.select("path", "fn", "line", F.trim(F.element_at(F.split("text", "\n"), F.col("line"))).alias("text"))


def handlers(ix: Index, found: DataFrame) -> DataFrame:
    """routes with `h_path`, `fn` and `handler`: the function that answers, as decorated, written in place, named, or imported."""
    last = ix.args.groupBy("path", "call").agg(F.max_by(F.struct("kind", "text", "lo", "hi"), "place").alias("end"))
    rows = found.join(last, ["path", "call"], "left")
    inline = S.enclosing(ix.fns.select("path", "fn", F.col("head").alias("at")), rows.where("not decorated").select("path", "call", F.col("end.lo").alias("first"), F.col("end.hi").alias("last")), ["call"]).where("in_call is not null")
    inline = inline.groupBy("path", F.col("in_call").alias("call")).agg(F.min("fn").alias("i_fn"))
    lines = decorators(ix).select("path", "line", F.col("fn").alias("d_fn")).distinct()
    base = F.substring_index("end.text", ".", -1)
    named = ix.fns.where("name is not null").groupBy("path", "name").agg(F.min("fn").alias("n_fn"))
    taken = ix.imports.where("target is not null").groupBy("path", "local").agg(F.min("target").alias("m_path"))
    abroad = named.select(F.col("path").alias("m_path"), F.col("name").alias("base"), F.col("n_fn").alias("m_fn"))
    refers = rows["end.kind"].isin("name", "member")
    rows = rows.withColumn("base", F.when(refers, base)).withColumn("local", F.when(refers, F.substring_index("end.text", ".", 1)))
    rows = rows.join(inline, ["path", "call"], "left").join(lines.withColumn("decorated", F.lit(True)), ["path", "line", "decorated"], "left")
    rows = rows.join(named.withColumnRenamed("name", "base"), ["path", "base"], "left").join(taken, ["path", "local"], "left").join(abroad, ["m_path", "base"], "left")
    fn = F.when(F.col("decorated"), F.col("d_fn")).otherwise(F.coalesce("i_fn", "n_fn", "m_fn"))
    where = F.when(F.col("decorated") | F.coalesce("i_fn", "n_fn").isNotNull(), F.col("path")).otherwise(F.coalesce(F.when(F.col("m_fn").isNotNull(), F.col("m_path")), F.col("path")))
    rows = rows.withColumn("fn", fn).withColumn("h_path", where)
    names = ix.fns.select(F.col("path").alias("h_path"), "fn", F.col("name").alias("f_name"))
    rows = rows.join(names, ["h_path", "fn"], "left")
    return rows.select(*found.columns, "h_path", "fn", F.coalesce(F.when(~F.col("decorated"), F.col("base")), "f_name", F.lit("<anonymous>")).alias("handler"))


# ---- mounts and who guards


def mounts(ix: Index, depth: int = 16) -> DataFrame:
    """(path, prefix, by, line): under which prefixes the routers of a file are reached, through all files that mount them.

    A file mounts another one by use() with a name imported from it. Prefixes are composed along the mounts, a round for each
    step, from files that no other one mounts; a file that mounts itself on the way is followed no further, nor are more
    than `depth` steps. A prefix that can't be told stays '?'.
    """
    step = middleware(ix).where("target is not null and target <> path").join(ix.imports.select(F.col("path").alias("target")).union(ix.calls.select(F.col("path").alias("target"))).distinct(), "target")
    routed = ix.calls.where(F.col("receiver").isin(ROUTERS)).select(F.col("path").alias("target")).distinct()
    edges = written(step.join(routed, "target").select("path", "target", F.coalesce("prefix", F.lit("")).alias("prefix"), "line").distinct(), "mount-edges")
    roots = edges.select("path").distinct().join(edges.select(F.col("target").alias("path")), "path", "left_anti")
    front = roots.select("path", F.lit("").alias("prefix"), F.lit(None).cast("string").alias("by"), F.lit(None).cast("int").alias("line"), F.array("path").alias("way"))
    reached = []
    for _ in range(depth):
        below = edges.select(F.col("path").alias("m_path"), "target", F.col("prefix").alias("m_prefix"), F.col("line").alias("m_line"))
        front = front.drop("by", "line").join(below, F.col("path") == F.col("m_path")).where("not array_contains(way, target)")
        joined = F.when(F.col("m_prefix") == "", F.col("prefix")).otherwise(endpoints.mounted(F.col("prefix"), F.col("m_prefix")))
        front = written(front.select(F.col("target").alias("path"), joined.alias("prefix"), F.col("m_path").alias("by"), F.col("m_line").alias("line"), F.concat("way", F.array("target")).alias("way")), "mounts")
        if front.isEmpty():
            break
        reached.append(front.drop("way"))
    if not reached:
        return front.drop("way")
    return reduce(DataFrame.unionByName, reached).distinct()


def inherited(ix: Index) -> DataFrame:
    """(path, line, place, name, base, kind, m_path, sure, far): middleware that guards a file's router where it is mounted, that of the files above included.

    It counts if it is registered before the mount, for all paths or for one that the mount's prefix begins with, or stands
    in the mount itself before the router.
    """
    uses = middleware(ix)
    routed = ix.calls.where(F.col("receiver").isin(ROUTERS)).select(F.col("path").alias("target")).distinct()
    at = uses.where("target is not null and target <> path").join(routed, "target").select(F.col("path").alias("m_path"), F.col("target").alias("path"), F.col("line").alias("m_line"), F.col("call").alias("m_call"), F.col("place").alias("m_place"), F.coalesce("prefix", F.lit("")).alias("m_prefix"))
    plain = uses.join(routed.withColumnRenamed("target", "_routed"), F.col("target") == F.col("_routed"), "left_anti").select(F.col("path").alias("m_path"), "call", "line", "place", "prefix", "name", "base", "kind", "sure")
    before = (F.col("call") < F.col("m_call")) & (F.col("prefix").isNull() | F.col("m_prefix").startswith(F.col("prefix"))) | (F.col("call") == F.col("m_call")) & (F.col("place") < F.col("m_place"))
    own = written(at.join(plain, "m_path").where(before).select("path", "m_path", "line", "place", "name", "base", "kind", "sure").distinct(), "guards")
    up = written(at.select("path", F.col("m_path").alias("up")).distinct(), "mounted-by")
    out, front = [own.withColumn("far", F.lit(0))], up
    for far in range(1, 16):  # guards of the file above guard what it mounts
        got = front.select("path", F.col("up").alias("above")).join(own.withColumnRenamed("path", "above"), "above").drop("above").withColumn("far", F.lit(far)).select(*out[0].columns)
        out.append(got)
        front = written(front.withColumnRenamed("up", "mid").join(up.select(F.col("path").alias("mid"), "up"), "mid").where("up <> path").select("path", "up").distinct(), "mounted-by")
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, out).distinct()


def auth_of(ix: Index, asked: DataFrame) -> DataFrame:
    """asked (path, base) with `scheme`: the auth that a named function implements: by its own text where it is found (imported or local), else by that of the file it comes from."""
    texts = function_texts(ix).where("name is not null").groupBy("path", "name").agg(F.min_by("text", "first").alias("text"))
    by_name = texts.select("path", F.col("name").alias("base"), endpoints.function_auth(F.col("text")).alias("f_auth"))
    taken = ix.imports.where("target is not null").groupBy("path", F.col("local").alias("base")).agg(F.min("target").alias("target"))
    rows = asked.select("path", "base").distinct().join(taken, ["path", "base"], "left").join(by_name.withColumnsRenamed({"path": "target", "f_auth": "m_auth"}), ["target", "base"], "left")
    rows = rows.join(file_auths(ix).withColumnsRenamed({"path": "target", "auth": "t_auth"}), "target", "left").join(by_name, ["path", "base"], "left")
    scheme = F.when(F.col("target").isNotNull(), F.coalesce("m_auth", "t_auth")).otherwise(F.col("f_auth"))
    return asked.join(rows.select("path", "base", F.coalesce(scheme, F.lit("none")).alias("scheme")), ["path", "base"], "left")


def file_auths(ix: Index) -> DataFrame:
    """(path, auth): the auth scheme of a file by its imports, then its text."""
    specs = ix.imports.groupBy("path").agg(F.collect_set("spec").alias("specs"))
    return ix.files.join(specs, "path", "left").select("path", endpoints.file_auth(F.coalesce("specs", F.array().cast("array<string>")), F.col("text")).alias("auth"))


# ---- schemas


def schemas(ix: Index) -> DataFrame:
    """(path, name, library, fields): object schemas of builders, and models, which inherit from BaseModel through any number of classes of their file.

    Fields are those that the schema or the class itself declares, in order; without any it is left out. Inheritance is a
    closure in rounds over the edges class to base that have not been followed yet, so a cycle ends.
    """
    built = []
    sets = ix.toks.where("p1 = '='").where(F.col("p2").rlike(S.NAME)).select("path", F.col("at").alias("start"), F.col("p2").alias("name"))
    some = ix.calls.join(sets, ["path", "start"])
    specs = ix.imports.groupBy("path", F.col("local").alias("receiver")).agg(F.min("spec").alias("spec"))
    some = some.join(specs, ["path", "receiver"], "left")
    library = F.coalesce(*[F.when(F.col("method").isin(methods) & (F.col("receiver").rlike(r) | F.coalesce(F.col("spec").rlike(r), F.lit(False))), F.lit(lib)) for lib, r, methods in BUILDERS])
    some = some.withColumn("library", library).where("library is not null").select("path", "name", "library", F.col("first").alias("call"), "start")
    objects = ix.pairs.where("kind = '{' and p1 = '('").select("path", "first", "last", F.col("p1_at").alias("call")).join(some, ["path", "call"])
    keys = S.enclosing(ix.toks.where("n1 = ':' and p1 in ('{', ',')").select("path", "at", "text"), ix.pairs.where("kind in ('{', '(', '[')").select("path", "first", "last", F.col("first").alias("bracket")), ["bracket"])
    keys = keys.select("path", F.col("in_bracket").alias("first"), "at", unquoted(F.col("text")).alias("field"))
    built = objects.join(keys, ["path", "first"]).groupBy("path", "name", "library", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "field"))), lambda x: x["field"]).alias("fields"))
    built = built.groupBy("path", "name").agg(F.max_by(F.struct("library", "fields"), "start").alias("x")).select("path", "name", "x.library", "x.fields")

    bodies = written(S.indented(ix.toks, "class"), "classes")
    heads = ix.toks.where("p1 = 'class'").select("path", F.col("p1_at").alias("word_at"), F.col("text").alias("name"), F.col("n1_at").alias("open"))
    bodies = bodies.join(heads, ["path", "word_at"])
    lists = ix.pairs.where("kind = '('").select("path", F.col("first").alias("open"), F.col("last").alias("close"))
    bases = S.enclosing(ix.names.select("path", "at", F.substring_index("text", ".", -1).alias("base")), bodies.join(lists, ["path", "open"]).select("path", F.col("open").alias("first"), F.col("close").alias("last"), "name"), ["name"]).where("in_name is not null")
    edges = written(bases.select("path", F.col("in_name").alias("name"), "base").distinct(), "bases")
    front = edges.where("base = 'BaseModel'").select("path", "name").distinct()
    models = written(front, "models")
    while True:
        front = written(edges.join(front.withColumnRenamed("name", "base"), ["path", "base"]).select("path", "name").distinct().join(models, ["path", "name"], "left_anti"), "models-new")
        if front.isEmpty():
            break
        models = written(models.unionByName(front), "models")
    fields = S.enclosing(ix.toks.where("fresh and n1 in (':', '=') and lang = 'python'").where(F.col("text").rlike(S.NAME) & ~F.col("text").isin(S.NO_CALLS)).select("path", "at", "text", "column"), bodies.select("path", "first", "last", "name"), ["name", "first"])
    own = S.enclosing(fields, ix.fns.select("path", "first", "last", "fn"), ["fn"]).where("in_fn is null and in_name is not null")
    own = own.groupBy("path", F.col("in_name").alias("name"), "in_first").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("fields"))
    own = own.groupBy("path", "name").agg(F.max_by("fields", "in_first").alias("fields"))
    return built.unionByName(own.join(models, ["path", "name"]).select("path", "name", F.lit("pydantic").alias("library"), "fields"))


# ---- what a handler takes and which data it touches

#: Parts of requests by the source that they stand for, and accessors that name a parameter in a string.
SOURCES_OF = [("body", "body"), ("query", "query"), ("params", "path"), ("header", "header"), ("headers", "header"), ("cookie", "cookie"), ("cookies", "cookie")]
ACCESSORS = [
    ("query", r"\bsearchParams\s*\.\s*get\(\s*['\"`]([^'\"`]+)['\"`]"),
    ("query", r"\brequest\s*\.\s*GET\s*\.\s*get\(\s*['\"]([^'\"]+)['\"]"),
    ("query", r"\brequest\s*\.\s*GET\s*\[\s*['\"]([^'\"]+)['\"]\s*\]"),
    ("body", r"\brequest\s*\.\s*POST\s*\.\s*get\(\s*['\"]([^'\"]+)['\"]"),
    ("body", r"\brequest\s*\.\s*POST\s*\[\s*['\"]([^'\"]+)['\"]\s*\]"),
    ("query", r"\b(?:req|request)\s*\.\s*query\s*\[\s*['\"]([^'\"]+)['\"]\s*\]"),
    ("body", r"\b(?:req|request)\s*\.\s*body\s*\[\s*['\"]([^'\"]+)['\"]\s*\]"),
    ("path", r"\b(?:req|request)\s*\.\s*params\s*\[\s*['\"]([^'\"]+)['\"]\s*\]"),
    ("header", r"\b(?:req|request)\s*\.\s*(?:headers|header)\s*\[\s*['\"]([^'\"]+)['\"]\s*\]"),
]
DECLARED = [("Path", "path"), ("Query", "query"), ("Body", "body"), ("Header", "header"), ("Cookie", "cookie")]


def parameters(ix: Index, found: DataFrame) -> DataFrame:
    """(path, call, name, type, source, validated, validator, place): the parameters of the endpoints found (handlers()), in order.

    Collected from the route, reads of parts of the request, destructuring, accessors that name one in a string, Python
    signatures, and schemas run against the body. A name counts once, as it was found first; it is validated if any way is.
    """
    texts = function_texts(ix).select(F.col("path").alias("h_path"), "fn", "text")
    rows = found.where("fn is not null").join(texts, ["h_path", "fn"]).select("path", "call", "h_path", "fn", "text")
    one = lambda name, source, type_=F.lit("unknown"), validated=F.lit(False), validator=F.lit(None).cast("string"): F.struct(name.alias("name"), type_.alias("type"), source.alias("source"), validated.alias("validated"), validator.alias("validator"))
    of = lambda part: F.coalesce(*[F.when(F.lower(part) == k, F.lit(v)) for k, v in SOURCES_OF], F.lit("unknown"))
    reads = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\b(?:req|request|ctx|c)\.(?:body|query|params|headers|header|cookies)\.\w+"), F.lit(0)), lambda x: one(F.regexp_extract(x, r"(\w+)$", 1), of(F.regexp_extract(x, r"\.(\w+)\.", 1))))
    taken = F.flatten(F.transform(
        F.regexp_extract_all("text", F.lit(r"\{[^{}]*\}\s*=\s*(?:req|request|ctx)\.(?:body|query|params|headers|cookies)(?![\w.(\[])"), F.lit(0)),
        lambda x: F.transform(F.filter(F.transform(F.split(F.regexp_extract(x, r"\{([^{}]*)\}", 1), ","), lambda y: F.regexp_extract(y, r"(?::\s*)?([A-Za-z_$][\w$]*)\s*(?:=.*)?$", 1)), lambda y: y != ""), lambda y: one(y, of(F.regexp_extract(x, r"\.(\w+)$", 1)))),
    ))
    said = lambda source, pattern: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda y: one(y, F.lit(source)))
    named = F.flatten(F.array(*[said(source, pattern) for source, pattern in ACCESSORS]))
    from_text = rows.select("path", "call", F.posexplode(F.concat(reads, taken, named)).alias("o", "p")).select("path", "call", F.lit(1).alias("way"), "o", "p.*")
    seeds = found.where("framework in ('nextjs', 'django')").select("path", "call", F.posexplode(endpoints.path_params(F.col("route"))).alias("o", "p"))
    seeds = seeds.select("path", "call", F.lit(0).alias("way"), "o", F.col("p.name").alias("name"), F.lit("unknown").alias("type"), F.lit("path").alias("source"), F.col("p.validated").alias("validated"), F.lit(None).cast("string").alias("validator"))

    # Python signatures: name: annotation = default
    heads = ix.fns.select("path", "fn", F.col("head").alias("first")).join(ix.pairs.where("lang = 'python' and kind = '('").select("path", "first", "last"), ["path", "first"])
    marks = S.enclosing(ix.toks.where("p1 = ':' and lang = 'python'").select("path", "at", "text", "n1", "p2"), heads, ["fn"]).where("in_fn is not null")
    defaults = ix.calls.select("path", F.col("start").alias("at"), "method")
    signed = marks.join(ix.toks.where("p1 = '='").select("path", F.col("p2").alias("text"), F.col("at").alias("d_at"), F.col("p1_at").alias("eq"), F.col("p2_at").alias("at")), ["path", "text", "at"], "left").join(defaults.withColumnsRenamed({"at": "d_at", "method": "default"}), ["path", "d_at"], "left")
    signed = signed.select(F.col("path").alias("h_path"), F.col("in_fn").alias("fn"), F.col("at").alias("o"), F.col("p2").alias("name"), F.col("text").alias("type"), "default")
    models = schemas(ix)
    asked = found.where("fn is not null").select("path", "call", "h_path", "fn").join(signed, ["h_path", "fn"])
    by_model = models.select(F.col("path").alias("h_path"), F.col("name").alias("type"), "library", "fields")
    asked = asked.join(by_model, ["h_path", "type"], "left")
    source = F.coalesce(*[F.when(F.col("default") == k, F.lit(v)) for k, v in DECLARED])
    plain = asked.where("fields is null").withColumn("source", source).where("source is not null").select("path", "call", F.lit(2).alias("way"), "o", "name", "type", "source", F.lit(True).alias("validated"), F.lit("pydantic").alias("validator"))
    whole = asked.where("fields is not null").select("path", "call", F.lit(2).alias("way"), "o", F.explode("fields").alias("name"), F.lit("unknown").alias("type"), F.lit("body").alias("source"), F.lit(True).alias("validated"), F.col("library").alias("validator"))

    # schemas run within the handler
    runs = S.enclosing(ix.calls.where(F.col("method").isin(VALIDATES) & (F.col("receiver") != "")).select("path", F.col("start").alias("at"), "receiver"), ix.fns.select("path", "first", "last", "fn"), ["fn"]).where("in_fn is not null")
    around = written(S.scopes(ix.fns), "scopes")
    runs = runs.join(around.select("path", F.col("fn").alias("in_fn"), "up"), ["path", "in_fn"]).select(F.col("path").alias("h_path"), F.col("up").alias("fn"), F.col("at").alias("o"), F.col("receiver").alias("type"))
    checked = found.where("fn is not null").select("path", "call", "h_path", "fn").join(runs, ["h_path", "fn"]).join(by_model, ["h_path", "type"])
    checked = checked.select("path", "call", F.lit(3).alias("way"), "o", F.explode("fields").alias("name"), F.lit("unknown").alias("type"), F.lit("body").alias("source"), F.lit(True).alias("validated"), F.col("library").alias("validator"))
    every = reduce(DataFrame.unionByName, [seeds, from_text, plain, whole, checked])
    first = F.struct("way", "o", "type", "source", "validated", "validator")
    names = every.groupBy("path", "call", "name").agg(F.min(first).alias("x"), F.min(F.when(F.col("validated"), F.struct("way", "o", "validator"))).alias("v"))
    out = names.select("path", "call", "name", "x.type", "x.source", F.col("v").isNotNull().alias("validated"), F.coalesce("x.validator", "v.validator").alias("validator"), "x.way", "x.o")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("path", "call").orderBy("way", "o", "name")) - 1).drop("way", "o")


def data_layers(ix: Index, found: DataFrame) -> DataFrame:
    """(path, call, layer) of the endpoints found (handlers()) that touch the data layer of the file their handler stands in.

    The layer is that of the file's imports, or, if they name none, of a local module that the file imports from. It is
    touched where the handler names something imported from there or made from that; Django's also by `.objects.`.
    """
    specs = ix.imports.groupBy("path").agg(F.collect_set("spec").alias("specs")).select("path", endpoints.data_layer(F.col("specs")).alias("layer")).where("layer <> 'none'")
    own = ix.imports.join(specs, "path").where(endpoints.data_layer(F.array("spec")) == F.col("layer")).select("path", "layer", F.col("local").alias("name"))
    hop = ix.imports.where("target is not null").join(specs.select("path"), "path", "left_anti").join(specs.withColumnRenamed("path", "target"), "target")
    only = hop.groupBy("path").agg(F.min("layer").alias("layer"))
    names = own.unionByName(hop.join(only, ["path", "layer"]).select("path", "layer", F.col("local").alias("name")))
    made = ix.toks.where("p1 = '=' or (p1 = 'new' and p2 = '=')").select("path", F.when(F.col("p1") == "=", F.col("p2")).otherwise(F.col("p3")).alias("new"), F.col("text").alias("name"))
    names = written(names.unionByName(names.join(made, ["path", "name"]).select("path", "layer", F.col("new").alias("name"))).distinct(), "data-names")
    bodies = ix.fns.select("path", "first", "last", "fn")
    used = S.enclosing(ix.names.where("root is not null").select("path", "at", F.col("root").alias("name"), "text"), bodies, ["fn"]).where("in_fn is not null")
    django = used.join(specs.where("layer = 'django-orm'"), "path").where("text like '%.objects.%'").select("path", "in_fn", "layer")
    hits = used.join(names, ["path", "name"]).select("path", "in_fn", "layer").unionByName(django)
    around = written(S.scopes(ix.fns), "scopes")
    hits = hits.join(around.select("path", F.col("fn").alias("in_fn"), "up"), ["path", "in_fn"]).select(F.col("path").alias("h_path"), F.col("up").alias("fn"), "layer").distinct()
    return found.join(hits, ["h_path", "fn"]).groupBy("path", "call").agg(F.min("layer").alias("layer"))


# ---- endpoints


def project_endpoints(ix: Index, edge: DataFrame | None = None) -> DataFrame:
    """The endpoints of a project: (id, method, route, mounted, handler, path, line, framework, params, validator, data_layer, middleware, auth, response, calls, path_sure, sure).

    Guards are the middleware registered before the mount of the file, that of the file itself whose prefix the route begins
    with, and that of the route. auth is the first scheme other than none, in this order: an edge matcher (edge: matcher,
    auth) that covers the route; decorators of the view; FastAPI dependencies, of the router and the function; inherited
    middleware, from the outermost file on; that of the file, then of the route; `unknown` if a guard is an expression
    that can't be told; else that of the file. sure is the least confidence of all that is said.
    """
    found = written(handlers(ix, routes(ix)).unionByName(_file_routes(ix)), "drafts")
    found = written(found.withColumn("id", F.concat_ws(":", "path", F.col("line").cast("string"), "method", "route")), "endpoints")
    key = ["path", "call"]

    # guards, in order: (far, line, place)
    above = found.select(*key, "id").join(inherited(ix).withColumnRenamed("line", "g_line"), "path").select("path", "call", F.col("m_path").alias("g_path"), (1000 - F.col("far")).alias("o1"), F.col("g_line").alias("o2"), F.col("place").alias("o3"), "name", "base", "kind", "sure")
    covers = F.col("prefix").isNull() | (F.col("route") == "?") | F.col("route").startswith(F.col("prefix"))
    uses = middleware(ix).join(ix.calls.where(F.col("receiver").isin(ROUTERS)).select(F.col("path").alias("_t")).distinct(), F.col("target").eqNullSafe(F.col("_t")), "left_anti")
    here = found.where("framework in ('express', 'fastapi')").select(*key, "route").join(uses.withColumnsRenamed({"call": "g_call", "line": "g_line"}), "path").where(covers).select("path", "call", F.col("path").alias("g_path"), F.lit(2000).alias("o1"), F.col("g_line").alias("o2"), F.col("place").alias("o3"), "name", "base", "kind", "sure")
    taken = ix.imports.select("path", F.col("local").alias("base")).distinct().withColumn("known", F.lit(True))
    own = found.where("framework = 'express'").select(*key, "n_args").join(ix.args.select("path", "call", "place", "text", "kind"), key).where("place > 0 and place < n_args - 1")
    own = own.withColumn("base", F.regexp_extract("text", r"^([A-Za-z_$][\w$]*)", 1)).join(taken, ["path", "base"], "left")
    own = own.select("path", "call", F.col("path").alias("g_path"), F.lit(3000).alias("o1"), F.lit(0).alias("o2"), F.col("place").alias("o3"), F.col("text").alias("name"), "base", "kind", F.when(F.col("known"), LITERAL).otherwise(CONSTANT).alias("sure"))
    guards = written(above.unionByName(here).unionByName(own), "endpoint-guards")
    schemes = auth_of(ix, guards.select(F.col("g_path").alias("path"), "base")).distinct().withColumnRenamed("path", "g_path")
    guards = guards.join(schemes, ["g_path", "base"], "left")
    dynamic = ~F.col("kind").isin("name", "member", "call", "function")
    ranked = guards.select(*key, F.struct(F.when(F.col("o1") < 2000, 4).otherwise(5).alias("rank"), "o1", "o2", "o3").alias("order"), F.when(~dynamic, F.col("scheme")).alias("scheme"))
    unknown = guards.where(dynamic).select(*key, F.struct(F.lit(6).alias("rank"), F.lit(0).alias("o1"), F.lit(0).alias("o2"), F.lit(0).alias("o3")).alias("order"), F.lit("unknown").alias("scheme"))

    # what decorators and dependencies say
    fixed = lambda rank: F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("o1"), F.lit(0).alias("o2"), F.lit(0).alias("o3")).alias("order")
    signed = found.join(decorators(ix).select(F.col("path").alias("h_path"), "fn", F.col("text").alias("said")), ["h_path", "fn"])
    decorated = signed.where(reduce(lambda a, b: a | b, [F.col("said").contains(d) for d in SESSION_DECORATORS]) & (F.col("framework") == "django")).select(*key, fixed(2), F.lit("session").alias("scheme"))
    depends = ix.calls.where("receiver = '' and method = 'Depends'").select("path", F.col("first").alias("call"), F.col("start").alias("at")).join(_argument(ix, 0, "arg"), ["path", "call"]).select("path", "at", F.col("arg.text").alias("base"))
    by_fn = S.enclosing(depends, ix.fns.select("path", "first", "last", "fn"), ["fn"]).where("in_fn is not null").select(F.col("path").alias("h_path"), F.col("in_fn").alias("fn"), "at", "base")
    near = S.enclosing(depends, ix.calls.where("method in ('APIRouter', 'FastAPI')").select("path", "first", "last", "start"), ["start"]).where("in_start is not null")
    assigned = ix.toks.where("p1 = '='").select("path", F.col("at").alias("in_start"), F.col("p2").alias("receiver"))
    by_router = near.join(assigned, ["path", "in_start"]).select("path", "receiver", "at", "base")
    wanted = found.join(by_fn, ["h_path", "fn"]).select(*key, F.col("h_path").alias("g_path"), "at", "base", F.lit(1).alias("o1")).unionByName(found.where("receiver is not null").join(by_router, ["path", "receiver"]).select(*key, F.col("path").alias("g_path"), "at", "base", F.lit(0).alias("o1")))
    dep_schemes = auth_of(ix, wanted.select(F.col("g_path").alias("path"), "base")).distinct().withColumnRenamed("path", "g_path")
    needed = wanted.join(dep_schemes, ["g_path", "base"], "left").select(*key, F.struct(F.lit(3).alias("rank"), "o1", F.lit(0).alias("o2"), F.col("at").alias("o3")).alias("order"), "scheme")
    every = ranked.unionByName(unknown).unionByName(decorated).unionByName(needed)
    if edge is not None:
        every = every.unionByName(found.join(edge, endpoints.matcher_covers(F.col("route"), F.col("matcher"))).select(*key, fixed(1), F.col("auth").alias("scheme"), F.lit(True).alias("edge")).drop("edge"))
    every = every.unionByName(found.join(file_auths(ix), "path").select(*key, fixed(7), F.col("auth").alias("scheme")))
    auth = every.where("scheme <> 'none' or order.rank = 1").groupBy(*key).agg(F.min_by("scheme", "order").alias("auth"))

    # handlers
    texts = function_texts(ix).select(F.col("path").alias("h_path"), "fn", "text")
    shape = found.join(texts, ["h_path", "fn"]).select(*key, endpoints.response_shape(F.col("text")).alias("response"))
    bodies = ix.fns.select("path", "first", "last", "fn")
    calls = S.enclosing(ix.calls.where(~F.col("receiver").isin(RESPONSE_RECEIVERS + FRAMEWORKS) & ~((F.col("receiver") == "") & F.col("method").isin(RESPONSE_BUILDERS))).select("path", F.col("start").alias("at"), "receiver", "method", "line"), bodies, ["fn"])
    around = written(S.scopes(ix.fns), "scopes")  # calls of functions inside count too
    calls = calls.where("in_fn is not null").join(around.select("path", F.col("fn").alias("in_fn"), "up"), ["path", "in_fn"]).join(ix.fns.select("path", F.col("fn").alias("up"), "head"), ["path", "up"])
    heads = ix.pairs.select("path", F.col("first").alias("head"), F.col("last").alias("head_end"))
    calls = calls.join(heads, ["path", "head"], "left").where("head_end is null or at > head_end or at < head")
    name = F.concat_ws(".", F.when(F.col("receiver") != "", F.col("receiver")), "method")
    graph = calls.select(F.col("path").alias("h_path"), F.col("up").alias("fn"), name.alias("name"), "at").groupBy("h_path", "fn", "name").agg(F.min("at").alias("at"))
    graph = graph.groupBy("h_path", "fn").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("calls"))
    listed = guards.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o1", "o2", "o3", "name"))), lambda x: x["name"]).alias("middleware"), F.min("sure").alias("guards_sure"))
    took = parameters(ix, found)
    took = took.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "name", "source", "validated", "validator"))).alias("x"))
    took = took.select(*key, F.transform("x", lambda p: F.struct(p["name"].alias("name"), p["source"].alias("source"), p["validated"].alias("validated"))).alias("params"), F.get(F.filter(F.transform("x", lambda p: p["validator"]), lambda v: v.isNotNull()), F.lit(0)).alias("validator"))
    layers = data_layers(ix, found)
    under = mounts(ix).groupBy("path").agg(F.min("prefix").alias("prefix"))
    out = found.join(listed, key, "left").join(auth, key, "left").join(shape, key, "left").join(graph, ["h_path", "fn"], "left").join(under, "path", "left").join(took, key, "left").join(layers, key, "left")
    view = signed.where("framework = 'django'").groupBy(*key).agg(F.max(_django_method(F.col("said"))).alias("verb"))
    out = out.join(view, key, "left")
    mounted = endpoints.mounted(F.col("prefix"), F.col("route"))
    answer = F.when((F.col("framework") == "fastapi") & F.coalesce(F.col("response") == "unknown", F.lit(True)), "json").otherwise(F.coalesce("response", F.lit("unknown")))
    method = F.when(F.col("framework") == "django", F.coalesce("verb", F.lit("GET"))).otherwise(F.col("method"))
    none = F.array().cast("array<string>")
    return out.select(
        F.concat_ws(":", "path", F.col("line").cast("string"), method, "route").alias("id"), method.alias("method"), "route", F.when((F.coalesce("prefix", F.lit("")) != "") & (mounted != F.col("route")), mounted).alias("mounted"), "handler", "path", "line", "framework",
        F.coalesce("params", F.array().cast("array<struct<name:string,source:string,validated:boolean>>")).alias("params"), F.coalesce("validator", F.lit("none")).alias("validator"), F.coalesce("layer", F.lit("none")).alias("data_layer"),
        F.coalesce("middleware", none).alias("middleware"), F.coalesce("auth", F.lit("none")).alias("auth"), answer.alias("response"), F.coalesce("calls", none).alias("calls"), F.col("sure").alias("path_sure"), F.least("sure", F.coalesce("guards_sure", F.lit(LITERAL))).alias("sure"),
    )


def _django_method(said: Column) -> Column:
    """The method that a decorator restricts a view to: null if it doesn't."""
    listed = F.regexp_extract_all(F.regexp_extract(said, r"@require_http_methods\(\s*\[([^\]]*)\]", 1), F.lit(r"['\"](\w+)['\"]"), F.lit(1))
    return F.when(said.rlike(r"@require_POST\b"), "POST").when(said.rlike(r"@require_(GET|safe)\b"), "GET").when(F.size(listed) == 1, F.upper(listed[0])).when(F.size(listed) > 1, "ALL")


def _file_routes(ix: Index) -> DataFrame:
    """Routes that a file's place and its exported functions make."""
    exported = ix.toks.where("text = 'export' and fresh").select("path", "line")
    rows = ix.fns.where(F.col("name").isin(NEXT_METHODS)).join(exported, ["path", "line"], "left_semi").withColumn("route", endpoints.file_route(F.col("path"))).where("route is not null and path rlike '(^|/)app/'")
    return rows.select(
        "path", (-F.col("fn") - 1).alias("call"), "line", F.lit("nextjs").alias("framework"), F.col("name").alias("method"), "route", F.lit(LITERAL).alias("sure"), F.lit(None).cast("string").alias("receiver"), F.lit(False).alias("decorated"), F.lit(0).cast("long").alias("n_args"),
        F.col("path").alias("h_path"), "fn", F.col("name").alias("handler"),
    )


def language(path: Column) -> Column:
    """Language of a path by its extension; null for others."""
    ext = F.lower(F.regexp_extract(path, "[.]([A-Za-z]+)$", 1))
    return F.coalesce(*[F.when(ext == k, F.lit(v)) for k, v in rules.LANGUAGES.items()])


# ---- registered on a project that the pages' addresses make


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A router file for every ten pages, a statement for each page; file f mounts the files 2f + 1 and 2f + 2."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 10).alias("f"), F.concat(F.lit("/u"), F.col("page_id").cast("string"), F.regexp_replace(F.regexp_extract("url", "^https?://[^/]*(/.*)$", 1), "[^A-Za-z0-9/_-]", "_")).alias("p"))
    k = F.col("page_id").cast("string")
    forms = [
        F.concat(F.lit("router.get('"), "p", F.lit("', (req, res) => { res.json(load"), k, F.lit("()); });")), F.lit("router.post(BASE, save);"), F.concat(F.lit("router.use('/~x"), k, F.lit("', guard);")),
        F.concat(F.lit("router.put(`"), "p", F.lit("`, function h"), k, F.lit("(q, r) { r.send(a.b()); });")),
    ]
    body = pages.select("f", F.struct("page_id", F.element_at(F.array(*forms), (F.col("page_id") % 4 + 1).cast("int")).alias("x")).alias("x")).groupBy("f").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["x"]), "\n").alias("body"))
    f, a, b = (x.cast("string") for x in (F.col("f"), F.col("f") * 2 + 1, F.col("f") * 2 + 2))
    head = [F.concat(F.lit("const BASE = '/base"), f, F.lit("';")), *[F.concat(F.lit("import r"), c, F.lit(" from './r"), c, F.lit("';")) for c in (a, b)], *[F.concat(F.lit("router.use('/p"), c, F.lit("', r"), c, F.lit(");")) for c in (a, b)]]
    return body.select(F.concat(F.lit("src/r"), f, F.lit(".js")).alias("path"), F.concat_ws("\n", *head, "body").alias("text"), F.lit("javascript").alias("lang"))


_PAGES = "g AS (SELECT page_id, page_id // 10 AS f, '/u' || page_id || regexp_replace(regexp_extract(url, '^https?://[^/]*(/.*)$', 1), '[^A-Za-z0-9/_-]', '_', 'g') AS p, 5 + row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS line FROM pages)"
_TREE = "t(f, prefix, above) AS (SELECT 0::BIGINT, '', NULL::BIGINT UNION ALL SELECT n.f, t.prefix || '/p' || n.f, t.f FROM t JOIN (SELECT DISTINCT f FROM g) n ON n.f IN (2 * t.f + 1, 2 * t.f + 2))"
_ROUTES = "r AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, CASE page_id % 4 WHEN 1 THEN '/base' || f ELSE p END AS route, CASE page_id % 4 WHEN 1 THEN 6e-1 ELSE 1e0 END AS sure FROM g WHERE page_id % 4 <> 2)"


@R.frame(f"WITH RECURSIVE {_PAGES}, {_TREE} SELECT 'src/r' || f || '.js' AS path, prefix, 'src/r' || above || '.js' AS by_, CAST(CASE WHEN f % 2 = 1 THEN 4 ELSE 5 END AS INT) AS line FROM t WHERE f > 0")
def project_mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mounts(index(project_files(spark, sf_dir))).withColumnRenamed("by", "by_")


@R.frame(f"WITH {_PAGES}, {_ROUTES} SELECT 'src/r' || f || '.js' AS path, CAST(line AS INT) AS line, method, route, CAST(sure AS DOUBLE) AS sure FROM r")
def project_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes(index(project_files(spark, sf_dir))).select("path", "line", "method", "route", "sure")


@R.frame(f"""WITH RECURSIVE {_PAGES}, {_TREE}, {_ROUTES} SELECT 'src/r' || r.f || '.js:' || line || ':' || method || ':' || route AS id, CASE WHEN prefix <> '' THEN prefix || route END AS mounted,
 CASE page_id % 4 WHEN 0 THEN '<anonymous>' WHEN 1 THEN 'save' ELSE 'h' || page_id END AS handler, CASE page_id % 4 WHEN 0 THEN 'json' ELSE 'unknown' END AS response, CASE page_id % 4 WHEN 0 THEN 'load' || page_id WHEN 1 THEN '' ELSE 'r.send,a.b' END AS calls, 'none' AS auth FROM r JOIN t ON t.f = r.f""")
def project_endpoint_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_endpoints(index(project_files(spark, sf_dir))).select("id", "mounted", "handler", "response", F.array_join("calls", ",").alias("calls"), "auth")


@R.frame(f"WITH {_PAGES} SELECT 'src/r' || f || '.js' AS path, 'h' || page_id AS caller, unnest(['send', 'b']) AS callee, CAST(line AS INT) AS line FROM g WHERE page_id % 4 = 3")
def project_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_graph(index(project_files(spark, sf_dir)))
