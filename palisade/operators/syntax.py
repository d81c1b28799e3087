"""A structural index of source files as tables: tokens, brackets, functions, try blocks, calls and what encloses what.

Everything is engine expressions over rows: one pattern cuts a text into tokens, running sums give the depth, and an
interval join by sweep finds the innermost interval around a place. Files meet no other file, so the one shuffle is by path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.plans.scratch import written

_DOUBLE, _SINGLE = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
_WORD = r"[A-Za-z_$][A-Za-z0-9_$]*+|[0-9][A-Za-z0-9_.]*+|\n[ \t]*+|[ \t\r\f\x0B]++"
#: Tokens of a text, every sign in just one of them. Repetitions are possessive: a long string costs no stack.
SCRIPT = r"//[^\n]*+|/\*(?s:.*?)\*/|`[^`\\$]*+(?:(?:\\(?s:.)|\$\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}|\$)[^`\\$]*+)*+`|" + f"{_SINGLE}|{_DOUBLE}|{_WORD}" + r"|=>|[=!]==?|[<>]=?|&&|\|\||\?\.|\+=|(?s:.)"
PYTHON = r"#[^\n]*+|\\\n|[A-Za-z]{0,2}(?:'''(?s:.*?)'''|" + '"""(?s:.*?)"""' + f"|{_SINGLE}|{_DOUBLE})|{_WORD}" + r"|==|!=|[<>]=?|\+=|:=|(?s:.)"
SKIPPED = r"^(//|/\*|[ \t\r\f\x0B]|\\\n)"
#: Words that a bracket may follow without a call, and signs after or before which a line goes on.
NO_CALLS = ["if", "for", "while", "switch", "catch", "return", "with", "elif", "and", "or", "not", "in", "is", "function", "async", "await", "typeof", "yield", "lambda", "except", "del", "assert", "new", "def", "class", "else", "do", "try", "finally", "throw", "raise"]
GOES_ON = ["=", "+=", "+", "-", "*", "/", "%", "?", ":", "&&", "||", "(", "[", "{", ",", ".", "?.", "=>", "!", "<", ">", "<=", ">=", "==", "===", "!=", "!==", "`(", "${"]
LED_ON = [".", "?.", "+", "?", ":", "&&", "||", ")", "]", "}", ",", "=", "==", "===", ")`", "}$"]
LANGUAGES = ["javascript", "typescript", "tsx", "python"]
OPEN, CLOSE = ["(", "[", "{", "`(", "${"], [")", "]", "}", ")`", "}$"]
#: After every place of a file.
FAR = 1 << 60
NAME = "^[A-Za-z_$][A-Za-z0-9_$]*$"


def _by(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def tokens(files: DataFrame) -> DataFrame:
    """(path, lang, at, text, line, depth, p1, p2, p3, p1_at, p2_at, n1, n1_at, p_line, fresh, column) for every token of files (path, text, lang).

    at: ascending place; depth: brackets around the token; p1 to p3: the tokens before, n1: the one after; fresh: a new
    statement begins with it, by its line; column: its indentation, where it is the first of a line. White space and comments are no tokens. A template (or f-string) that holds
    expressions becomes the bracket `( ... )` with a bracket ${ ... }$ for each, so that what they use can be seen; one
    within another stays a token. Null
    texts and other languages have none; rows that repeat a path must not be: a path is a file. Other columns are ignored.
    """
    t, lang = F.col("text"), F.col("lang")

    def cut(x: Column) -> Column:
        return F.when(lang == "python", F.regexp_extract_all(x, F.lit(PYTHON), F.lit(0))).otherwise(F.regexp_extract_all(x, F.lit(SCRIPT), F.lit(0)))

    part = lambda text, lines: F.struct(text.alias("t"), lines.cast("int").alias("n"))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def opened(x: Column) -> Column:
        held = F.when(lang == "python", F.regexp_extract_all(x, F.lit(r"\{([^{}]+)\}"), F.lit(1))).otherwise(F.regexp_extract_all(x, F.lit(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}"), F.lit(1)))
        inner = F.flatten(F.transform(held, lambda e: F.concat(F.array(part(F.lit("${"), F.lit(0))), F.transform(cut(e), lambda y: part(y, F.lit(0))), F.array(part(F.lit("}$"), F.lit(0))))))
        return F.concat(F.array(part(F.lit("`("), F.lit(0))), inner, F.array(part(F.lit(")`"), breaks(x))))

    template = lambda x: F.when(lang == "python", x.rlike("^(?i:f|fr|rf)['\"]") & x.contains("{")).otherwise(x.startswith("`") & x.contains("${"))
    every = F.flatten(F.transform(cut(t), lambda x: F.when(template(x), opened(x)).otherwise(F.array(part(x, breaks(x))))))
    comment = lambda x: x["t"].rlike(SKIPPED) | (lang == "python") & x["t"].startswith("#")
    kept = F.filter(every, lambda x: ~comment(x) | (x["n"] > 0))
    rows = files.where(t.isNotNull() & lang.isin(LANGUAGES)).select("path", "lang", kept.alias("_kept")).select("path", "lang", F.posexplode("_kept").alias("at", "x")).select("path", "lang", "at", F.col("x.t").alias("text"), F.col("x.n").alias("n"))
    order = _by("path").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("text").isin(OPEN), 1).when(F.col("text").isin(CLOSE), -1).otherwise(0)
    rows = rows.select("*", (1 + F.coalesce(F.sum("n").over(before), F.lit(0))).cast("int").alias("line"), F.lag("text").over(order).alias("_raw"))
    comment_ = F.col("text").rlike(SKIPPED) | (F.col("lang") == "python") & F.col("text").startswith("#")
    rows = rows.where(~comment_ & ~F.col("text").startswith("\n")).drop("n")
    depth = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.when(step > 0, 1).otherwise(0)
    lag, lead = (lambda c, k: F.lag(c, k).over(order)), (lambda c: F.lead(c).over(order))
    rows = rows.select(
        "*", depth.cast("int").alias("depth"), *[lag("text", k).alias(f"p{k}") for k in (1, 2, 3)], lag("at", 1).alias("p1_at"), lag("at", 2).alias("p2_at"), lead("text").alias("n1"), lead("at").alias("n1_at"), lag("line", 1).alias("p_line"),
    )
    led = F.col("_raw").isNull() | F.col("_raw").startswith("\n")
    goes_on = F.coalesce(F.col("p1").isin(GOES_ON), F.lit(False)) | F.col("text").isin(LED_ON)
    fresh = F.when(F.col("lang") == "python", led & (F.col("depth") == 0)).otherwise(F.col("p_line").isNull() | (F.col("line") > F.col("p_line")) & ~goes_on)
    column = F.when(led, F.greatest(F.length(F.coalesce("_raw", F.lit("\n"))) - 1, F.lit(0)))
    return rows.withColumn("fresh", fresh).withColumn("column", column).drop("_raw")


def enclosing(points: DataFrame, intervals: DataFrame, columns: list[str], at: str = "at", first: str = "first", last: str = "last", key: str = "path") -> DataFrame:
    """points with `columns` of the innermost interval around them (first < at < last, of the same key); nulls where there is none.

    Intervals of a key must lie inside or beside each other. A sweep: the running number of open intervals tells at each
    place how deep it is, and of the intervals that begin at this depth the last one is the innermost. One shuffle by key and
    two sorts, however many intervals lie around a place; no pair is formed.
    """
    held, of = F.struct(*points.columns), F.struct(*columns)
    events = reduce(DataFrame.unionByName, [
        points.select(F.col(key).alias("_k"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_o"), F.lit(0).cast("long").alias("_t"), F.lit(0).alias("_d"), held.alias("_p"), F.lit(None).alias("_v")),
        intervals.select(F.col(key).alias("_k"), F.col(first).cast("long").alias("_at"), F.lit(2).alias("_o"), (-F.col(last)).cast("long").alias("_t"), F.lit(1).alias("_d"), F.lit(None).alias("_p"), of.alias("_v")),
        intervals.select(F.col(key).alias("_k"), F.col(last).cast("long").alias("_at"), F.lit(0).alias("_o"), F.lit(0).cast("long").alias("_t"), F.lit(-1).alias("_d"), F.lit(None).alias("_p"), F.lit(None).alias("_v")),
    ])
    order = ["_at", "_o", "_t"]
    running = lambda keys: _by(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    deep = events.withColumn("_deep", F.sum("_d").over(running(["_k"])))
    inner = deep.withColumn("_in", F.when(F.col("_deep") > 0, F.last("_v", ignorenulls=True).over(running(["_k", "_deep"]))))
    found = inner.where("_p is not null")
    return found.select(*[F.col(f"_p.`{c}`").alias(c) for c in points.columns], *[F.col(f"_in.`{c}`").alias(f"in_{c}") for c in columns])


def brackets(toks: DataFrame) -> DataFrame:
    """(path, lang, kind, first, last, line, end_line, p1, p2, p3, p1_at, p2_at, n1, depth): matched brackets, with the tokens before and after; those that match nothing are left out."""
    order = _by("path", "depth").orderBy("at")
    rows = toks.where(F.col("text").isin(OPEN + CLOSE))
    # at one depth brackets open and close in turn; a closing one is as deep as what stands outside of it
    paired = rows.select("*", F.lead("at").over(order).alias("last"), F.lead("text").over(order).alias("end"), F.lead("n1").over(order).alias("after"), F.lead("line").over(order).alias("end_line"))
    fits = reduce(lambda a, b: a | b, [(F.col("text") == o) & (F.col("end") == c) for o, c in zip(OPEN, CLOSE, strict=True)])
    return paired.where(fits).select("path", "lang", F.col("text").alias("kind"), F.col("at").alias("first"), "last", "line", "end_line", "p1", "p2", "p3", "p1_at", "p2_at", F.col("after").alias("n1"), "depth")


def functions(toks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, fn, name, first, last, line, end_line, head): functions with their bodies as intervals; head is the place of the bracket of the parameters, or of the one parameter.

    fn is the body's place. Scripts: declarations, methods, function expressions and arrows, whose body is a block or an
    expression; the name is the declared one, else that of the variable or property it is assigned to. Python: def, to the last line before one that is
    indented as little or less.
    """
    round_ = pairs.where("kind = '('").select("path", F.col("first").alias("head"), F.col("last").alias("_close"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("p3").alias("q3"))
    block = pairs.where("kind = '{' and lang <> 'python'")
    plain = block.where("p1 = ')'").join(round_.withColumnRenamed("_close", "p1_at"), ["path", "p1_at"])
    named = F.when(F.col("q1") == "function", F.when(F.col("q2").isin("=", ":"), F.col("q3"))).when(F.col("q1").rlike(NAME) & ~F.col("q1").isin(NO_CALLS) & ~F.coalesce(F.col("q2").isin(".", "new"), F.lit(False)), F.col("q1"))
    plain = plain.where((F.col("q1") == "function") | F.col("q2").eqNullSafe("function") | named.isNotNull()).select("path", F.col("first"), "last", "line", "end_line", "head", named.alias("name"))
    arrow = block.where("p1 = '=>'")
    ends = toks.where("text = '=>'").select("path", F.col("at").alias("p1_at"), F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("p3").alias("a3"), F.col("p1_at").alias("a1_at"))
    arrow = arrow.join(ends, ["path", "p1_at"]).join(round_.withColumnRenamed("_close", "a1_at"), ["path", "a1_at"], "left")
    skip = lambda one, two, three: F.when(F.col(one) == "async", F.when(F.col(two).isin("=", ":"), F.col(three))).when(F.col(one).isin("=", ":"), F.col(two))
    names = F.when(F.col("head").isNotNull(), skip("q1", "q2", "q3")).otherwise(F.when(F.col("a2").isin("=", ":"), F.col("a3")))
    arrow = arrow.select("path", F.col("first"), "last", "line", "end_line", F.coalesce("head", "a1_at").alias("head"), names.alias("name"))
    short = until(toks, pairs, "=>").where("n1 <> '{'").select("path", F.col("at").alias("first"), "until", "line", F.col("p1_at").alias("a1_at"), F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("p3").alias("a3"))
    short = short.join(round_.withColumnRenamed("_close", "a1_at"), ["path", "a1_at"], "left")
    lines = toks.select("path", F.col("at").alias("until"), F.col("p_line").alias("_line"))
    length = toks.groupBy("path").agg(F.max("line").alias("_lines"))
    short = short.join(lines, ["path", "until"], "left").join(length, "path").withColumns({"last": F.col("until"), "end_line": F.coalesce("_line", "_lines")})
    short = short.select("path", "first", "last", "line", "end_line", F.coalesce("head", "a1_at").alias("head"), names.alias("name"))
    heads = pairs.where("lang = 'python' and kind = '(' and p2 = 'def'").select("path", F.col("first").alias("head"), F.col("p1").alias("name"), F.col("p2_at").alias("word_at"))
    py = indented(toks, "def").join(heads, ["path", "word_at"])
    every = reduce(DataFrame.unionByName, [x.select("path", "first", "last", "line", "end_line", "head", "name") for x in (plain, arrow, short, py)])
    return every.select("path", F.col("first").alias("fn"), "name", "first", "last", "line", "end_line", "head")


def until(toks: DataFrame, pairs: DataFrame, *words: str) -> DataFrame:
    """Tokens of these texts with `until`, the place where what follows them ends, and the bracket around (in_kind, in_first, in_last).

    It ends with the statement or the next comma within the same bracket (in Python a comma ends nothing), or with the
    bracket; FAR if nothing follows in the file.
    """
    marks = toks.where(F.col("text").isin(*words, ";", ",") | F.col("fresh"))
    inside = enclosing(marks, pairs, ["kind", "first", "last"])
    stop = F.when(F.col("fresh") | (F.col("text") == ";") | (F.col("text") == ",") & (F.col("lang") != "python"), F.col("at"))
    ahead = F.last(stop, ignorenulls=True).over(_by("path", "in_first").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1))
    return inside.withColumn("until", F.coalesce(ahead, "in_last", F.lit(FAR))).where(F.col("text").isin(*words))


def indented(toks: DataFrame, *words: str) -> DataFrame:
    """(path, word, word_at, first, last, line, end_line) of Python blocks that begin with one of the words, found by indentation.

    Each line closes the blocks indented as far or farther; so it is put once under every indentation, of those at which
    such blocks begin in its file, that is not less than its own, and the next row under the same one ends a block.
    """
    toks = toks.where("lang = 'python'")
    led = F.col("text") == "async"
    starts = toks.where("fresh").select("path", "at", "line", "column", "p_line", F.when(led, F.col("n1")).otherwise(F.col("text")).alias("word"), F.when(led, F.col("n1_at")).otherwise(F.col("at")).alias("word_at"))
    levels = starts.where(F.col("word").isin(*words)).groupBy("path").agg(F.collect_set("column").alias("_levels"))
    under = starts.join(levels, "path").withColumn("_level", F.explode(F.filter("_levels", lambda x: x >= F.col("column"))))
    order = _by("path", "_level").orderBy("at")
    ended = under.select("*", F.lead("at").over(order).alias("last"), F.lead("p_line").over(order).alias("end_line"))
    ended = ended.where((F.col("column") == F.col("_level")) & F.col("word").isin(*words)).select("path", "word", "word_at", F.col("at").alias("first"), "last", "line", "end_line")
    length = toks.groupBy("path").agg((F.max("at") + 1).alias("_last"), F.max("line").alias("_line"))
    return ended.join(length, "path").withColumns({"last": F.coalesce("last", "_last"), "end_line": F.coalesce("end_line", "_line")}).drop("_last", "_line")


def tries(toks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, first, last): the blocks of try statements, those of their handlers included."""
    block = pairs.where("kind = '{' and lang <> 'python'")
    caught = pairs.where("kind = '(' and p1 = 'catch'").select("path", F.col("last").alias("p1_at"))
    handlers = block.where("p1 = ')'").join(caught, ["path", "p1_at"])
    blocks = block.where("p1 in ('try', 'catch', 'finally')").select("path", "first", "last").union(handlers.select("path", "first", "last"))
    return blocks.union(indented(toks, "try", "except", "finally").select("path", "first", "last"))


def chains(toks: DataFrame) -> DataFrame:
    """(path, lang, at, first, text, root, p1, p1_at, n1, n1_at, line): dotted names, a row for each name that ends one.

    text: all of it, ?. as a dot; root: its first name, null where the chain goes on from a bracket; at: its last name's place.
    """
    dot = F.col("text").isin(".", "?.")
    some = toks.where(dot | F.col("text").rlike(NAME))
    begins = F.when(dot, ~F.coalesce(F.col("p1").rlike(NAME), F.lit(False))).otherwise(~F.coalesce(F.col("p1").isin(".", "?."), F.lit(False)))
    some = some.withColumn("_chain", F.sum(begins.cast("int")).over(_by("path").orderBy("at")))
    whole = some.groupBy("path", "lang", "_chain").agg(F.array_sort(F.collect_list(F.struct("at", F.when(dot, ".").otherwise(F.col("text")).alias("t"), "line", "p1", "p1_at", "n1", "n1_at"))).alias("x"))
    first, last = F.col("x")[0], F.element_at("x", -1)
    text = F.array_join(F.transform("x", lambda y: y["t"]), "")
    out = whole.select("path", "lang", last["at"].alias("at"), first["at"].alias("first"), text.alias("text"), F.when(first["t"] != ".", first["t"]).alias("root"), first["p1"].alias("p1"), first["p1_at"].alias("p1_at"), last["n1"].alias("n1"), last["n1_at"].alias("n1_at"), first["line"].alias("line"))
    return out.where(~F.col("text").isin(NO_CALLS + [".", "const", "let", "var", "export", "import", "from", "static", "public", "private", "void", "null", "true", "false", "undefined", "None", "True", "False", "this", "self", "pass", "break", "continue", "as"]))


def calls(names: DataFrame, pairs: DataFrame, fns: DataFrame) -> DataFrame:
    """(path, lang, first, last, receiver, method, line, depth, start): calls; first and last are the places of the brackets, start that of the callee.

    receiver: the dotted text before the method, `()` for what a call or an index gives, empty for none.
    """
    dotted = F.substring_index("text", ".", -1)
    receiver = F.when(F.col("root").isNull(), F.regexp_replace(F.concat(F.lit("()"), "text"), r"\.[^.]*$", "")).otherwise(F.regexp_replace("text", r"(^|\.)[^.]*$", ""))
    of = names.where("n1 = '('").select("path", "lang", F.col("n1_at").alias("first"), dotted.alias("method"), receiver.alias("receiver"), F.col("first").alias("start"), "line")
    round_ = pairs.where("kind = '('").select("path", "first", "last", "depth", "p2")
    heads = fns.select("path", F.col("head").alias("first"))
    found = of.join(round_, ["path", "first"]).join(heads, ["path", "first"], "left_anti")
    return found.where(~F.coalesce(F.col("p2").isin("function", "def", "class"), F.lit(False)) & ~F.col("method").isin(NO_CALLS)).drop("p2")


def scopes(fns: DataFrame) -> DataFrame:
    """(path, fn, up, far): for each function itself and those around it, far counting from 0; the module, fn 0 below all, is left to the caller."""
    inner = enclosing(fns, fns.select("path", "first", "last", F.col("fn").alias("fn_")), ["fn_"], at="first").select("path", "fn", F.col("in_fn_").alias("up")).where("up is not null")
    parent = written(inner, "parents")
    reach = [fns.select("path", "fn", F.col("fn").alias("up"), F.lit(0).alias("far"))]
    front, far = parent, 1
    while not front.isEmpty():  # as many rounds as functions are nested
        reach.append(front.select("path", "fn", "up", F.lit(far).alias("far")))
        front = written(front.withColumnRenamed("up", "_mid").join(parent.select("path", F.col("fn").alias("_mid"), "up"), ["path", "_mid"]).select("path", "fn", "up"), "ancestors")
        far += 1
    return reduce(DataFrame.unionByName, reach)


def sites(points: DataFrame, fns: DataFrame, blocks: DataFrame) -> DataFrame:
    """points (path, at, ...) with `function`, the name of the innermost function around them (`<anonymous>` if it has none, null outside), and `in_try`."""
    named = fns.select("path", "first", "last", F.coalesce("name", F.lit("<anonymous>")).alias("name"))
    inside = enclosing(points, named, ["name"]).withColumnRenamed("in_name", "function")
    return enclosing(inside, blocks.select("path", "first", "last", F.lit(True).alias("hit")), ["hit"]).withColumn("in_try", F.coalesce("in_hit", F.lit(False))).drop("in_hit")
