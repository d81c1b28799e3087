"""Scans over text: secrets and personal data, search, redaction, listing, discovery, licences, fingerprints."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import scoring
from palisade.functions import text as T
from palisade.plans.registry import Registry, table

R = Registry()
_q = lambda s: s.replace("'", "''")
_LINES = "lines AS (SELECT doc_id, CAST(i AS INTEGER) AS line, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"
_SNIPPET = "CASE WHEN length(trim(l)) > 120 THEN left(trim(l), 120) || '...' ELSE trim(l) END AS snippet"
_LUHN = f"AND (SELECT sum(CASE WHEN i % 2 = 1 THEN (CAST(d AS INT) * 2) // 10 + (CAST(d AS INT) * 2) % 10 ELSE CAST(d AS INT) END) FROM (SELECT unnest(string_split(c, '')) AS d, generate_subscripts(string_split(c, ''), 1) AS i FROM (SELECT regexp_replace(regexp_extract(l, '{T.CARD}'), '[^0-9]', '', 'g') AS c))) % 10 = 0"
_RULE_SQL = " UNION ALL ".join(f"SELECT doc_id, line, {o} AS rule, '{t}' AS type, '{s}' AS severity, {_SNIPPET} FROM lines WHERE regexp_matches(l, '{_q(p)}') {_LUHN if t == 'credit_card' else ''}" for o, t, s, p in T.SECRET_RULES)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, l): lines numbered from 1."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l")).select("doc_id", (F.col("p") + 1).alias("line"), "l")


def secret_findings(docs: DataFrame, rules=T.SECRET_RULES) -> DataFrame:
    """(doc_id, line, rule, type, severity, snippet) of every rule that a line matches; numbers of cards must pass the Luhn check.

    One pass, no join. Plain searches for the texts that a rule needs choose the texts, then the lines, that are worth a
    pattern; most are never cut into lines, and a line sees only the patterns it may match.
    """
    def may(x: Column, order: int) -> Column:
        needs = T.SECRET_NEEDS.get(order, [""])
        of, needs = (F.lower(x), needs[:-1]) if needs[-1] == "i" else (x, needs)
        found = reduce(lambda a, b: a | b, [of.contains(n) for n in needs])
        if order == 8:  # a value in quotes is needed too
            return (x.contains("'") | x.contains('"')) & found
        return found & x.rlike("[0-9]{4}") if order == 10 else found & x.rlike("[0-9][.][0-9]") if order == 12 else found

    def matches(x: Column, order: int, kind: str, pattern: str) -> Column:
        hit = may(x, order) & x.rlike(pattern)
        return hit & T.luhn(F.regexp_replace(F.regexp_extract(x, T.CARD, 0), "[^0-9]", "")) if kind == "credit_card" else hit

    worth = lambda x: reduce(lambda a, b: a | b, [may(x, o) for o, *_ in rules])
    hits = F.filter(F.array(*[F.when(matches(F.col("l"), o, t, p), F.struct(F.lit(o).alias("rule"), F.lit(t).alias("type"), F.lit(s).alias("severity"))) for o, t, s, p in rules]), lambda h: h.isNotNull())
    some = lines(docs.where(worth(F.col("text")))).where(worth(F.col("l")))
    snippet = T.truncated(F.trim("l"), 120)
    return some.select("doc_id", "line", snippet.alias("snippet"), F.explode(hits).alias("h")).select("doc_id", "line", "h.rule", "h.type", "h.severity", "snippet")


@R.frame(f"WITH {_LINES} {_RULE_SQL}")
def secret_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(table(spark, sf_dir, "documents"))


@R.frame(f"WITH {_LINES} SELECT type, severity, count(*) AS findings, count(DISTINCT doc_id) AS files FROM ({_RULE_SQL}) GROUP BY type, severity")
def secret_pii_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(table(spark, sf_dir, "documents")).groupBy("type", "severity").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("files"))


@R.frame(f"SELECT doc_id, left(sha256({T.replaced_sql('text', T.REDACT_A)}), 16) AS redacted FROM documents")
def redact_text_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.sha16(T.replaced(F.col("text"), T.REDACT_A)).alias("redacted"))


@R.frame(f"SELECT doc_id, left(sha256({T.replaced_sql('text', T.REDACT_B)}), 16) AS redacted FROM documents")
def redact_text_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.sha16(T.replaced(F.col("text"), T.REDACT_B)).alias("redacted"))


def globbed(path: Column, glob: str) -> Column:
    """Whether a path matches a glob: ** any folders, * and ? within a name, {a,b} either; a glob without a slash is for names in any folder."""
    out, braces, k = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        braces += (c == "{") - (c == "}")
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c, "|" if c == "," and braces else re.escape(c))
        k += 1
    return path.rlike(f"^{'' if '/' in glob else '(?:.*/)?'}{out.lstrip('/')}$")


def searched(files: DataFrame, pattern: str, glob: str | None = None, most: int = 50, longest: int = 500) -> DataFrame:
    """(path, line, text, total, truncated): lines of files (path, text) that match a pattern in any case; the first `most` by path and line (the limit is the feature).

    Of one file at most `most` count. Texts are trimmed and cut; null texts have no lines. total is the number of lines that
    count, truncated whether there are more than are listed.
    """
    some = files if glob is None else files.where(globbed(F.col("path"), glob))
    hit = lambda x: x.rlike(f"(?i)(?:{pattern})")
    rows = some.select("path", F.posexplode(F.split("text", "\n")).alias("p", "l")).where(hit(F.col("l")))
    kept = rows.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("p"))).where(F.col("n") <= most)
    total = kept.agg(F.count("*").alias("total"))
    text = T.truncated(F.regexp_replace("l", "^\\s+|\\s+$", ""), longest, "…")
    return kept.orderBy("path", "p").limit(most).crossJoin(F.broadcast(total)).select("path", (F.col("p") + 1).alias("line"), text.alias("text"), "total", (F.col("total") > most).alias("truncated"))


@R.frame(
    f"WITH {_LINES}, hits AS (SELECT doc_id, line, l, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS rn FROM lines WHERE regexp_matches(l, '(?i)licen[sc]e|token')), "
    "kept AS (SELECT * FROM hits WHERE rn <= 50) SELECT doc_id, line, CASE WHEN length(l) > 500 THEN left(l, 500) || '...' ELSE l END AS snippet, (SELECT count(*) FROM kept) AS total, (SELECT count(*) > 50 FROM kept) AS truncated FROM kept ORDER BY doc_id, line LIMIT 50"
)
def regex_search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search with at most 50 hits a file and 50 in all (the limit is the feature), with the total before it."""
    hits = lines(table(spark, sf_dir, "documents")).where(F.col("l").rlike("(?i)licen[sc]e|token"))
    kept = hits.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))).where("rn <= 50")
    total = kept.agg(F.count("*").alias("total"), (F.count("*") > 50).alias("truncated"))
    return kept.orderBy("doc_id", "line").limit(50).crossJoin(F.broadcast(total)).select("doc_id", "line", T.truncated(F.col("l"), 500).alias("snippet"), "total", "truncated")


@R.frame("SELECT doc_id, strlen(text) AS bytes, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line_count FROM documents")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.size(F.split("text", "\n")).alias("line_count"))


@R.frame(
    "SELECT page_id, url, CASE WHEN contains(url, '/static/') OR contains(url, '/vendor/') THEN 'ignored' WHEN regexp_matches(url, '[.](env|pem|key)$') THEN 'secret' "
    "WHEN regexp_matches(url, '(^|/)(test|tests|__tests__)/|[.](test|spec)[.]') THEN 'test_file' WHEN html IS NULL OR html = '' THEN 'empty' WHEN strlen(html) > 1048576 THEN 'too_large' END AS reason FROM pages"
)
def reason_coded_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    reason = scoring.first_reason([
        (url.contains("/static/") | url.contains("/vendor/"), "ignored"), (url.rlike("[.](env|pem|key)$"), "secret"),
        (url.rlike("(^|/)(test|tests|__tests__)/|[.](test|spec)[.]"), "test_file"), (F.col("html").isNull() | (F.col("html") == ""), "empty"), (F.octet_length("html") > 1048576, "too_large"),
    ])
    return table(spark, sf_dir, "pages").select("page_id", "url", reason.alias("reason"))


#: Prefixes of copyleft licence ids.
COPYLEFT = ["GPL-", "AGPL-", "LGPL-", "MPL-", "EPL-", "CDDL-", "CPL-", "CC-BY-NC", "CC-BY-SA", "CC-BY-ND", "COMMONS-CLAUSE", "BUSL-", "SSPL-", "RSAL-", "JSON", "EUPL-"]
_LICENSES = [("Apache License, Version 2.0", "Apache-2.0"), ("MIT License", "MIT"), ("GNU General Public License, version 3", "GPL-3.0"), ("CC BY-NC 4.0", "CC-BY-NC-4.0")]
_LICENSE_CASE = "CASE " + " ".join(f"WHEN contains(l, '{a}') THEN '{b}'" for a, b in _LICENSES) + " END"


def license_lines(docs: DataFrame) -> DataFrame:
    return lines(docs).withColumn("spdx", scoring.first_reason([(F.col("l").contains(a), b) for a, b in _LICENSES])).where("spdx is not null").select("doc_id", "line", "spdx")


@R.frame(f"WITH {_LINES} SELECT doc_id, line, {_LICENSE_CASE} AS spdx FROM lines WHERE {_LICENSE_CASE} IS NOT NULL")
def license_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_lines(table(spark, sf_dir, "documents"))


@R.frame(
    f"WITH {_LINES}, f AS (SELECT doc_id, {_LICENSE_CASE} AS spdx FROM lines), p AS (SELECT unnest({COPYLEFT!r}) AS prefix) "
    "SELECT f.doc_id, f.spdx, bool_or(p.prefix IS NOT NULL) AS copyleft, CASE WHEN bool_or(p.prefix IS NOT NULL) THEN 'error' ELSE 'off' END AS policy FROM f LEFT JOIN p ON starts_with(upper(f.spdx), p.prefix) WHERE f.spdx IS NOT NULL GROUP BY f.doc_id, f.spdx"
)
def license_policy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copyleft by prefix: a broadcast theta join with the prefix table."""
    prefixes = F.broadcast(spark.createDataFrame([(p,) for p in COPYLEFT], "prefix string"))
    hit = license_lines(table(spark, sf_dir, "documents")).join(prefixes, F.upper("spdx").startswith(F.col("prefix")), "left")
    return hit.groupBy("doc_id", "spdx").agg(F.bool_or(F.col("prefix").isNotNull()).alias("copyleft")).withColumn("policy", F.when(F.col("copyleft"), "error").otherwise("off"))


@R.frame("SELECT fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, left(sha256(lower(trim(text))), 16) AS fingerprint FROM documents) GROUP BY fingerprint")
def fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.sha16(F.lower(F.trim("text"))).alias("fingerprint")).groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@R.frame("SELECT doc_id, left(sha256(text), 16) AS hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def cache_miss_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed cache: keys of which the cache (here: labelled good) has none."""
    cached = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(cached, "doc_id", "left_anti").select("doc_id", T.sha16(F.col("text")).alias("hash"))


@R.frame("SELECT doc_id, source FROM documents WHERE CAST(('0x' || left(sha256(source || ':' || CAST(doc_id AS VARCHAR)), 8)) AS BIGINT) / 4294967295e0 < 25e-2")
def hash_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic sampling (a sampling operator) by hash."""
    return table(spark, sf_dir, "documents").where(T.sampled(F.concat_ws(":", "source", F.col("doc_id").cast("string")), 0.25)).select("doc_id", "source")


@R.frame("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages")
def route_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


@R.frame("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*(/.*)$', 1) AS p FROM pages), w AS (SELECT page_id, list_distinct(regexp_extract_all(p, '[A-Za-z]+')) AS ws FROM p)
 SELECT page_id, param, validated FROM (SELECT page_id, unnest(ws) AS param, page_id % 2 = 1 AS validated FROM w)""")
def path_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of routes whose segments are the words of the pages' addresses: [word] for even pages, <str:word> for odd ones."""
    from palisade.operators.endpoints import path_params as named

    path = F.regexp_extract("url", "^https?://[^/]*(/.*)$", 1)
    route = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(path, "[A-Za-z]+", "[$0]")).otherwise(F.regexp_replace(path, "[A-Za-z]+", "<str:$0>"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(named(route)).alias("p")).select("page_id", F.col("p.name").alias("param"), F.col("p.validated").alias("validated"))


@R.frame(
    "WITH u AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*(/.*)$', 1) AS path FROM pages), g AS (SELECT DISTINCT regexp_extract(path, '^(/[^/]*)', 1) AS prefix FROM u) SELECT u.page_id, g.prefix FROM u JOIN g ON starts_with(u.path, g.prefix) WHERE g.prefix <> ''"
)
def prefix_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global middleware applies by string prefix. First segments give the join an equality; only shorter prefixes are compared beside it."""
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]*(/.*)$", 1).alias("path"))
    g = u.select(F.regexp_extract("path", "^(/[^/]*)", 1).alias("prefix")).where("prefix <> ''").distinct()
    # a prefix of the path that is a first segment itself starts with the path's own first segment or is shorter than it
    cuts = u.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(F.regexp_extract("path", "^(/[^/]*)", 1)), F.lit(1))), lambda n: F.substring(F.col("path"), F.lit(1), n))))
    return cuts.join(g, "prefix").select("page_id", "prefix").distinct()


_FIRST = [(1, "email", T.EMAIL), (2, "token", "[0-9a-f]{40}"), (3, "digits", "[0-9]{4}")]


@R.frame("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN {o}" for o, _, p in _FIRST) + " END AS rule FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for _, _, p in _FIRST))
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(o)) for o, _, p in _FIRST])
    return table(spark, sf_dir, "documents").select("doc_id", rule.alias("rule")).where("rule is not null")


@R.frame(
    f"WITH {_LINES}, s AS (SELECT doc_id, line FROM lines WHERE regexp_matches(l, '[0-9]{{4}}')), f AS (SELECT doc_id, line FROM lines WHERE regexp_matches(l, '[=:]')), "
    "c AS (SELECT doc_id FROM f GROUP BY doc_id) SELECT s.doc_id, s.line FROM s WHERE (s.doc_id, s.line) IN (SELECT doc_id, line FROM f) OR s.doc_id NOT IN (SELECT doc_id FROM c)"
)
def taint_gate_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks pass if a flow reaches their line, or if their file has no flows at all."""
    ln = lines(table(spark, sf_dir, "documents"))
    flows = ln.where(F.col("l").rlike("[=:]")).select("doc_id", "line")
    sinks = ln.where(F.col("l").rlike("[0-9]{4}")).select("doc_id", "line")
    return sinks.join(flows, ["doc_id", "line"], "left_semi").unionByName(sinks.join(flows, "doc_id", "left_anti"))
