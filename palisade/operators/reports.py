"""Reports over findings, hits and inventories: messages, ranked lists, grouped hits, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import scoring
from palisade.functions import text as T
from palisade.plans.registry import Registry, table

R = Registry()


def upgrade(name: Column, version: Column, to: Column) -> Column:
    return F.concat(F.lit("Upgrade "), name, F.lit(" "), version, F.lit(" -> "), to)


def dependency_message(name: Column, version: Column, min_safe: Column, ids: Column, sources: Column, kev: Column, exploit: Column, label: Column) -> Column:
    """What a finding about a package says: the upgrade or that there is none, up to five advisories, sources, exploits, priority."""
    n = F.size(ids)
    count = F.concat(n.cast("string"), F.lit(" vulnerable "), F.when(n == 1, "advisory").otherwise("advisories"))
    listed = F.array_join(F.slice(ids, 1, 5), ", ")
    tags = F.concat(
        F.when(sources >= 2, F.concat(F.lit(" [confirmed by "), sources.cast("string"), F.lit(" sources]"))).otherwise(""),
        F.when(F.coalesce(kev, F.lit(False)), " [KEV — known exploited]").when(F.coalesce(exploit, F.lit(False)), " [exploit available]").otherwise(""),
        F.lit(" [priority: "), label, F.lit("]"),
    )
    fixed = F.concat(upgrade(name, version, min_safe), F.lit(" — "), count, F.lit(": "), listed, tags)
    return F.coalesce(fixed, F.concat(name, F.lit("@"), version, F.lit(" has "), count, F.lit(" with NO known fix: "), listed, tags))


def most_urgent(findings: DataFrame, n: int = 20) -> DataFrame:
    """The n findings (name, version, priority, ...) of the highest priority (the limit is the feature), with their label and how many there are."""
    of = findings.agg(F.count("*").alias("total"))
    top = findings.orderBy(F.desc("priority"), "name", "version").limit(n)
    return top.crossJoin(F.broadcast(of)).withColumn("label", F.upper(scoring.priority_label(F.col("priority"))))


def hits_by_file(hits: DataFrame, most: int = 5, width: int = 200) -> DataFrame:
    """(file, lines, previews): the first `most` hits (file, line, text) of each file (the limit is the feature), previews cut.

    Each side of the shuffle keeps `most` rows of a file, so a file with very many hits is never gathered.
    """
    from pyspark.sql import Window

    ranked = hits.withColumn("_rank", F.row_number().over(Window.partitionBy("file").orderBy("line"))).where(F.col("_rank") <= most)
    got = F.array_sort(F.collect_list(F.struct("line", F.substring("text", 1, width).alias("text"))))
    return ranked.groupBy("file").agg(got.alias("_h")).select("file", F.transform("_h", lambda h: h["line"]).alias("lines"), F.transform("_h", lambda h: h["text"]).alias("previews"))


def inventory(files: DataFrame, group: str, language: str, size: str) -> DataFrame:
    """One row: files, their size, and the distinct groups and languages in order."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return files.agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("size"), names(group).alias("groups"), names(language).alias("languages"))


#: Lockfiles of which the first that there is counts.
HASHED = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "requirements.txt", "pyproject.toml"]


def workspace_hash(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hash): hashes of the package file and the first lockfile (name, text) of each workspace, of 65,536 characters at most; 'none' for one that is missing."""
    digest = T.sha16(F.substring("text", 1, 65536))
    one = lambda n: F.max(F.when(F.col("name") == n, digest))
    got = files.where(F.col("name").isin("package.json", *HASHED)).groupBy(*keys).agg(one("package.json").alias("_p"), F.coalesce(*[one(n) for n in HASHED]).alias("_l"))
    return got.select(*keys, F.concat_ws(":", F.coalesce("_p", F.lit("none")), F.coalesce("_l", F.lit("none"))).alias("hash"))


#: Fixed values.
UNRESOLVED, META, CONFIRMED = 0.2, 0.15, 0.8


def runtime_confirmed(middleware: Column) -> Column:
    """Confidences of an array of middleware (confidence, ...) after a trace has confirmed the endpoint: what was unresolved counts as confirmed."""
    return F.transform(middleware, lambda m: m.withField("confidence", F.when(m["confidence"].isin(UNRESOLVED, META), F.lit(CONFIRMED)).otherwise(m["confidence"])))


def marked_unresolved(middleware: Column) -> Column:
    """An array of middleware (source_file, confidence, ...): entries without a file have the least confidence."""
    lost = lambda m: m["source_file"].isin("", "?")
    return F.transform(middleware, lambda m: F.when(lost(m), m.withField("source_file", F.lit("")).withField("confidence", F.lit(UNRESOLVED))).otherwise(m))


def tools_used(steps: DataFrame, run: str, action: str, tools: dict[str, list[str]]) -> DataFrame:
    """(run, <tool> ...): whether a run has a step of any of each tool's actions."""
    return steps.groupBy(run).agg(*[F.bool_or(F.col(action).isin(actions)).alias(t) for t, actions in tools.items()])


#: What a recorded scan answers, in either of its dialects.
SCAN_RESPONSE = (
    "scanType string, findings array<{f}>, finalFindings array<{f}>".replace(
        "{f}",
        "struct<type:string,check_id:string,severity:string,extra:struct<severity:string,message:string>,location:struct<line_start:int,line_end:int>,start:struct<line:int>,end:struct<line:int>,"
        "message:string,evidence_snippet:string,confidence:double,why_real:string,fix_strategy:string,fix_snippet:string>",
    )
)


def normalised(responses: DataFrame) -> DataFrame:
    """One row for each finding of recorded scan responses (..., text): type, severity, line_start, line_end, message, evidence, confidence, why, fix_strategy, fix_snippet.

    Scans of type advanced or fast report their final findings, where they have any list of them, others their findings. Empty
    texts count as missing; answers that can't be read have no findings. Other columns stay.
    """
    keys = [c for c in responses.columns if c != "text"]
    r = responses.select(*keys, F.from_json("text", SCAN_RESPONSE).alias("_r"))
    final = F.col("_r.scanType").isin("advanced", "fast") & F.col("_r.finalFindings").isNotNull()
    each = r.select(*keys, F.explode(F.when(final, F.col("_r.finalFindings")).otherwise(F.col("_r.findings"))).alias("f"))
    said = lambda *names: F.coalesce(*[F.nullif(F.col(f"f.{n}"), F.lit("")) for n in names])
    place = F.col("f.location").isNotNull()
    first, last = F.col("f.start.line"), F.coalesce("f.end.line", "f.start.line")
    return each.select(
        *keys, said("type", "check_id").alias("type"), said("severity", "extra.severity").alias("severity"), F.when(place, F.col("f.location.line_start")).otherwise(first).alias("line_start"), F.when(place, F.col("f.location.line_end")).otherwise(last).alias("line_end"),
        said("message", "extra.message").alias("message"), F.col("f.evidence_snippet").alias("evidence"), F.col("f.confidence").alias("confidence"), F.col("f.why_real").alias("why"), F.col("f.fix_strategy").alias("fix_strategy"), F.col("f.fix_snippet").alias("fix_snippet"),
    )


def worth_proving(severity: Column) -> Column:
    """Findings of any severity but low are proved."""
    return F.coalesce(severity.isin("critical", "high", "medium"), F.lit(False))


# ---- registered

_IDS = "list_sort(list('A-' || CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR)))"


@R.frame(f"""WITH g AS (SELECT l_partkey, {_IDS} AS ids, count(DISTINCT l_suppkey) AS sources, bool_or(l_returnflag = 'R') AS kev, bool_or(l_linestatus = 'F') AS exploit, max(l_linenumber) AS top FROM lineitem WHERE l_discount >= 9e-2 GROUP BY l_partkey),
 m AS (SELECT l_partkey, CAST(len(ids) AS VARCHAR) || ' vulnerable ' || CASE WHEN len(ids) = 1 THEN 'advisory' ELSE 'advisories' END AS c, array_to_string(ids[1:5], ', ') AS listed, CASE WHEN top % 2 = 0 THEN '2.0.' || CAST(top AS VARCHAR) END AS safe,
 CASE WHEN sources >= 2 THEN ' [confirmed by ' || CAST(sources AS VARCHAR) || ' sources]' ELSE '' END || CASE WHEN kev THEN ' [KEV — known exploited]' WHEN exploit THEN ' [exploit available]' ELSE '' END || ' [priority: high]' AS tags FROM g)
 SELECT l_partkey, CASE WHEN safe IS NOT NULL THEN 'Upgrade p' || CAST(l_partkey AS VARCHAR) || ' 1.0 -> ' || safe || ' — ' || c || ': ' || listed || tags ELSE 'p' || CAST(l_partkey AS VARCHAR) || '@1.0 has ' || c || ' with NO known fix: ' || listed || tags END AS message FROM m""")
def dependency_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    id_ = F.concat(F.lit("A-"), c("l_orderkey").cast("string"), F.lit("."), c("l_linenumber").cast("string"))
    g = table(spark, sf_dir, "lineitem").where("l_discount >= 9e-2").groupBy("l_partkey").agg(F.array_sort(F.collect_list(id_)).alias("ids"), F.countDistinct("l_suppkey").alias("sources"), F.bool_or(c("l_returnflag") == "R").alias("kev"), F.bool_or(c("l_linestatus") == "F").alias("exploit"), F.max("l_linenumber").alias("top"))
    safe = F.when(c("top") % 2 == 0, F.concat(F.lit("2.0."), c("top").cast("string")))
    return g.select("l_partkey", dependency_message(F.concat(F.lit("p"), c("l_partkey").cast("string")), F.lit("1.0"), safe, c("ids"), c("sources"), c("kev"), c("exploit"), F.lit("high")).alias("message"))


@R.frame("""WITH h AS (SELECT source AS file, doc_id AS line, substr(text, 1, 200) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
 SELECT file, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines, left(sha256(string_agg(t, chr(10) ORDER BY line)), 16) AS previews FROM h WHERE rn <= 5 GROUP BY file""")
def grouped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("line"), "text")
    return hits_by_file(hits).select("file", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"), T.sha16(F.array_join("previews", "\n")).alias("previews"))


@R.frame("SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source AS s FROM documents)) AS groups, (SELECT string_agg(l, ',' ORDER BY l) FROM (SELECT DISTINCT lang AS l FROM documents)) AS languages FROM documents")
def architecture_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(table(spark, sf_dir, "documents"), "source", "lang", "n_chars")


@R.frame("""WITH f AS (SELECT page_id // 4 AS ws, ['package.json', 'yarn.lock', 'requirements.txt', 'readme'][page_id % 4 + 1] AS name, left(sha256(substr(html, 1, 65536)), 16) AS h FROM pages WHERE page_id % 7 > 0)
 SELECT ws, coalesce(max(CASE WHEN name = 'package.json' THEN h END), 'none') || ':' || coalesce(max(CASE WHEN name = 'yarn.lock' THEN h END), max(CASE WHEN name = 'requirements.txt' THEN h END), 'none') AS hash FROM f WHERE name <> 'readme' GROUP BY ws""")
def workspace_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in ("package.json", "yarn.lock", "requirements.txt", "readme")]), (F.col("page_id") % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").where("page_id % 7 > 0").select(F.floor(F.col("page_id") / 4).alias("ws"), name.alias("name"), F.col("html").alias("text"))
    return workspace_hash(files, ["ws"])


@R.frame("SELECT o_orderkey, p AS priority, CASE WHEN p >= 75 THEN 'CRITICAL' WHEN p >= 50 THEN 'HIGH' WHEN p >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS label, (SELECT count(*) FROM orders) AS total FROM (SELECT o_orderkey, o_orderkey % 101 AS p, CAST(o_orderkey AS VARCHAR) AS name FROM orders) ORDER BY p DESC, name LIMIT 20")
def urgent_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 101).alias("priority"), F.col("o_orderkey").cast("string").alias("name"), F.lit("1").alias("version"))
    return most_urgent(findings).select("o_orderkey", "priority", "label", "total")


@R.frame("SELECT conv_id, bool_or(role = 'assistant') AS answered, bool_or(role IN ('system', 'tool')) AS guided FROM conversations GROUP BY conv_id")
def tools_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools_used(table(spark, sf_dir, "conversations"), "conv_id", "role", {"answered": ["assistant"], "guided": ["system", "tool"]})
