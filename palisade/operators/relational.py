"""Aggregations, joins, windows, graphs and keyed state, on the test tables as stand-ins for scan telemetry and inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions.rules import ATTACKS, GUARD_STOPS, GUARDS
from palisade.functions import scoring as S
from palisade.plans.registry import Registry, table
from palisade.plans.scratch import written

R = Registry()

R.sql("audit_summary", """SELECT count(*) AS total, count(DISTINCT user_id) AS users, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors,
 CASE WHEN count(*) = 0 THEN 0e0 ELSE CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) END AS error_rate,
 CAST(min(ts) AS STRING) AS first_ts, CAST(max(ts) AS STRING) AS last_ts FROM {events}""".replace("AS STRING", "AS DATE"))
R.sql("audit_grouping_sets", """SELECT event_type, CAST(user_id % 10 AS BIGINT) AS user_group, count(*) AS n, CAST(sum(floor(value * 100)) AS BIGINT) AS cents FROM {events}
 GROUP BY GROUPING SETS ((event_type, CAST(user_id % 10 AS BIGINT)), (event_type), ())""")
R.sql("action_histogram", "SELECT conv_id, role, count(*) AS n FROM {conversations} GROUP BY conv_id, role")
R.sql("props_map_merge", "SELECT event_type, CAST(sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM {events} GROUP BY event_type", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
R.sql("run_replay_steps", """SELECT conv_id, turn, role, CAST(sum(CASE WHEN before IS NULL OR before <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step
 FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations}) x""")
R.sql("related_topk_budget", """SELECT doc_id, source, used FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn,
 CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM {documents}) x WHERE rn <= 10 AND used <= 49152""")
R.sql("eval_case_score", """SELECT d.doc_id, l.quality = 0 AS positive, d.n_chars < 400 AS found, l.toxic = 1 AS strict FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""")
R.sql("severity_tally", "SELECT count(CASE WHEN lower(o_orderpriority) LIKE '1-%' THEN 1 END) AS critical, count(CASE WHEN lower(o_orderpriority) LIKE '2-%' THEN 1 END) AS high, count(CASE WHEN lower(o_orderpriority) LIKE '3-%' THEN 1 END) AS medium, count(CASE WHEN lower(o_orderpriority) LIKE '4-%' OR lower(o_orderpriority) LIKE '5-%' THEN 1 END) AS low FROM {orders}")
R.sql("files_by_language", "SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM {documents} GROUP BY lang")
R.sql("package_dedup", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM {lineitem}) x WHERE rn = 1")
R.sql("resolved_split", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'unresolved' ELSE 'queryable' END AS kind FROM {lineitem}")
R.sql("advisory_semi_join", "SELECT p_partkey, p_name FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_discount >= 9e-2)")
R.sql("advisory_full_outer_merge", """SELECT coalesce(s.k, c.k) AS nation, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers, CASE WHEN s.k IS NOT NULL AND c.k IS NOT NULL THEN 2 ELSE 1 END AS sources
 FROM (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY s_nationkey) s FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal > 0 GROUP BY c_nationkey) c ON s.k = c.k""")
R.sql("package_advisory_join", """SELECT l_partkey, p_name, l_orderkey, l_linenumber, l_discount FROM (SELECT l.l_partkey, p.p_name, l.l_orderkey, l.l_linenumber, l.l_discount, row_number() OVER (PARTITION BY l.l_partkey ORDER BY l.l_discount DESC, l.l_orderkey, l.l_linenumber) AS rn
 FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey) x WHERE rn = 1""")
R.sql("stale_invalidation", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'open' WHEN d.n_chars % 10 <> l.quality THEN 'stale' ELSE 'open' END AS status FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
R.sql("topk_importance", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
R.sql("set_difference_fix", """SELECT 'removed' AS kind, p AS partkey, s AS suppkey FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM {lineitem} WHERE l_orderkey % 2 = 0 EXCEPT SELECT l_partkey, l_suppkey FROM {lineitem} WHERE l_orderkey % 2 = 1) a
 UNION ALL SELECT 'added' AS kind, p AS partkey, s AS suppkey FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM {lineitem} WHERE l_orderkey % 2 = 1 EXCEPT SELECT l_partkey, l_suppkey FROM {lineitem} WHERE l_orderkey % 2 = 0) b""")
R.sql("intersect_steps", "SELECT l_suppkey FROM {lineitem} WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM {lineitem} WHERE l_returnflag = 'R'")
R.sql("dismissed_antijoin", "SELECT l.l_orderkey, l.l_linenumber FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
R.sql("union_findings", "SELECT 'supplier' AS kind, count(*) AS n FROM {supplier} UNION ALL SELECT 'customer' AS kind, count(*) AS n FROM {customer} UNION ALL SELECT 'part' AS kind, count(*) AS n FROM {part}")
R.sql("known_facts_insert", "SELECT fact, min(event_id) AS event_id FROM (SELECT lower(trim(event_type)) AS fact, event_id FROM {events}) x GROUP BY fact")
R.sql("regroup_by_status", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
R.sql("cube_flags", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")


def _half(x: str) -> str:
    return f"CAST(floor({x} + 5e-1) AS INTEGER)"


_VERDICT = "CASE l_returnflag WHEN 'A' THEN 'PROVEN' WHEN 'R' THEN 'UNPROVEN' ELSE 'INCONCLUSIVE' END"
_TIER = "CASE WHEN l_linenumber = 7 THEN 'fallback' ELSE 'deep' END"


@R.frame(f"SELECT l_orderkey, l_linenumber, CASE WHEN v = 'PROVEN' THEN {_half('greatest(c, 80e0)')} WHEN v = 'UNPROVEN' THEN {_half('least(c, 25e0)')} WHEN t = 'fallback' THEN {_half('least(c, 55e0)')} WHEN k = 0 THEN {_half('least(c, 40e0)')} WHEN k = 1 THEN {_half('least(c, 60e0)')} ELSE {_half('least(c, 75e0)')} END AS confidence FROM (SELECT l_orderkey, l_linenumber, {_VERDICT} AS v, {_TIER} AS t, l_linenumber % 3 AS k, l_quantity * 2e0 AS c FROM lineitem)")
def confidence_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("l_returnflag") == "A", "PROVEN").when(F.col("l_returnflag") == "R", "UNPROVEN").otherwise("INCONCLUSIVE")
    t = F.when(F.col("l_linenumber") == 7, "fallback").otherwise("deep")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.clamped(F.col("l_quantity") * 2.0, v, t, F.col("l_linenumber") % 3).alias("confidence"))


_GATES = [
    ("synthetic-source", "l_linenumber = 6"), ("extracted-logic-source", "l_linenumber = 5 AND l_quantity < 25"), ("mock-vulnerable-path", "l_linestatus = 'F' AND l_linenumber = 4"), ("target-not-reached", "l_quantity < 10"),
    ("baseline-failed", "l_discount >= 9e-2"), ("exploit-failed", "l_tax >= 8e-2"), ("impact-not-observed", "l_linenumber = 7"), ("non-deterministic-assertion", "l_returnflag = 'R'"), ("insufficient-repeats", "l_suppkey % 5 + 1 < 3"), ("flaky-proof", "l_orderkey % 3 = 0"),
]


@R.frame(
    "WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 1 THEN list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _GATES) + "], lambda x: x IS NOT NULL) ELSE ['proof-marker-missing'] END AS failed FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, array_to_string(failed, ',') AS failed, CASE WHEN len(failed) = 0 THEN 'PROVEN' WHEN list_contains(failed, 'exploit-failed') OR list_contains(failed, 'impact-not-observed') THEN 'UNPROVEN' ELSE 'INCONCLUSIVE' END AS verdict FROM f"
)
def proof_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.operators import policy

    bad = {n: F.expr(c) for n, c in _GATES}
    marker = {
        "sourceMode": F.when(bad["synthetic-source"], "synthetic").when(bad["extracted-logic-source"], "extracted-logic").otherwise("project"), "mockedVulnerablePath": F.when(bad["mock-vulnerable-path"], True),
        "targetReached": ~bad["target-not-reached"], "baseline": F.when(~bad["baseline-failed"], "pass"), "exploit": F.when(bad["exploit-failed"], "fail").otherwise("pass"),
        "impact": F.when(~bad["impact-not-observed"], "observed"), "assertion": F.when(bad["non-deterministic-assertion"], "random").otherwise("deterministic"),
    }
    runs = F.col("l_suppkey") % 5 + 1
    failed = policy.proof_gates(F.col("l_quantity") > 1, marker, runs, F.when(bad["flaky-proof"], runs - 1).otherwise(runs))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", failed.alias("f"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join("f", ",").alias("failed"), policy.proof_verdict(F.col("f")).alias("verdict"))


@R.frame("SELECT l_orderkey, l_linenumber, ['static', 'reachable', 'triggered', 'demonstrated', 'verified'][greatest(l_linenumber % 5, CAST(l_quantity AS INTEGER) % 5) + 1] AS level FROM lineitem")
def verification_level_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.array(*[F.lit(x) for x in S.LEVELS])
    at = lambda c: F.element_at(rank, (c % 5 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.level_max(at(F.col("l_linenumber")), at(F.col("l_quantity").cast("int"))).alias("level"))


@R.frame("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'unproven' WHEN l_discount > 8e-2 THEN 'low_confidence' WHEN l_linestatus = 'O' AND l_tax > 6e-2 THEN 'high_severity' END AS reason FROM lineitem")
def human_review_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    reason = S.first_reason([(c("l_returnflag") == "R", "unproven"), (c("l_discount") > 8e-2, "low_confidence"), ((c("l_linestatus") == "O") & (c("l_tax") > 6e-2), "high_severity")])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"))


_P = "least(CAST(floor(least(l_quantity / 5e0 / 1e1 * 4e1, 4e1) + least(l_tax * 1000e0 / 1e2 * 25e0, 25e0) + CASE WHEN l_returnflag = 'R' THEN 20 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 10 ELSE 0 END + CASE WHEN l_linenumber = 1 THEN 5 ELSE 0 END + 5e-1) AS INTEGER), 100)"


@R.frame(f"SELECT l_orderkey, l_linenumber, p AS priority, CASE WHEN p >= 75 THEN 'critical' WHEN p >= 50 THEN 'high' WHEN p >= 25 THEN 'medium' ELSE 'low' END AS label FROM (SELECT l_orderkey, l_linenumber, {_P} AS p FROM lineitem)")
def exploit_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    p = S.priority(c("l_quantity") / 5.0, c("l_tax") * 1000.0, c("l_returnflag") == "R", c("l_linestatus") == "F", c("l_linenumber") == 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p.alias("priority"), S.priority_label(p).alias("label"))


@R.frame("SELECT p_brand, min(p_size * 1000000 + p_partkey) AS key_, arg_min(CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey AS VARCHAR), p_size * 1000000 + p_partkey) AS version FROM part GROUP BY p_brand")
def min_safe_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least fixed version by numeric components, not by text."""
    from palisade.functions.text import version_key

    version = F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min(F.col("p_size") * 1000000 + F.col("p_partkey")).alias("key_"), F.min_by(version, version_key(version)).alias("version"))


def guard_cells(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(GUARD_STOPS, "guard string, attack string, stops boolean"))


@R.frame(
    f"WITH g AS (SELECT n_nationkey, {GUARDS!r}[n_nationkey % {len(GUARDS)} + 1] AS guard FROM nation), a AS (SELECT r_regionkey, {ATTACKS!r}[r_regionkey * 2 + 1] AS attack FROM region), c(guard, attack, stops) AS (VALUES "
    + ", ".join(f"('{g}', '{a}', {str(s).lower()})" for g, a, s in GUARD_STOPS) + ") SELECT n_nationkey, g.guard, a.attack, c.stops FROM g CROSS JOIN a LEFT JOIN c ON c.guard = g.guard AND c.attack = a.attack"
)
def guard_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards against attacks, three-valued; the attack side is a fixed table of ten rows at most."""
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    guards = table(spark, sf_dir, "nation").select("n_nationkey", pick(GUARDS, F.col("n_nationkey") % len(GUARDS)).alias("guard"))
    attacks = table(spark, sf_dir, "region").select(pick(ATTACKS, F.col("r_regionkey") * 2).alias("attack"))
    return guards.crossJoin(F.broadcast(attacks)).join(guard_cells(spark), ["guard", "attack"], "left").select("n_nationkey", "guard", "attack", "stops")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse edges of three kinds, distinct and without loops: nation <- customer <- order <- part."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    parts = [
        t("customer").select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst")),
        t("orders").select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst")),
        t("lineitem").select(node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst")),
    ]
    return reduce(DataFrame.unionByName, parts).where("src <> dst").distinct()


_EDGES = "edges AS (SELECT DISTINCT * FROM (SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem) WHERE src <> dst)"


@R.frame(f"WITH {_EDGES} SELECT src, count(*) AS dependents FROM edges GROUP BY src")
def reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("src").agg(F.count("*").alias("dependents"))


def blast(graph: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(node, depth): least number of steps from the seeds, at most `depth`.

    The edges are written once; a round joins them with the nodes that the last one reached for the first time, and leaves out
    those that are known, so that no node is followed twice.
    """
    graph = written(graph.select("src", "dst"), "edges")
    known = front = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "reached")
    for d in range(1, depth + 1):
        new = graph.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = written(new.join(known, "node", "left_anti").withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


@R.frame(f"WITH RECURSIVE {_EDGES}, walk(node, depth) AS (SELECT 'n1', 0 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 3) SELECT node, min(depth) AS depth FROM walk GROUP BY node")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blast(edges(spark, sf_dir), spark.createDataFrame([("n1",)], "node string"))


@R.frame("SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over the event stream, batch form (palisade.streaming.windows has the streaming one)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.window("ts", "1 hour")
    return e.groupBy("event_type", w).agg(F.count("*").alias("n")).select("event_type", F.unix_timestamp(F.col("window.start")).alias("window_start"), "n")


R.sql("related_files_rank", "SELECT src, dst, min(rank_) AS rank_ FROM (SELECT o_custkey AS src, o_orderkey % 97 AS dst, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS rank_ FROM {orders}) x GROUP BY src, dst")
R.sql("checklist_incomplete", """SELECT r.conv_id, r.step FROM (SELECT DISTINCT c.conv_id, s.step FROM {conversations} c CROSS JOIN (SELECT 'user' AS step UNION ALL SELECT 'assistant' UNION ALL SELECT 'system') s) r
 LEFT JOIN (SELECT DISTINCT conv_id, role FROM {conversations}) d ON d.conv_id = r.conv_id AND d.role = r.step WHERE d.role IS NULL""")


def mutual_substrings(targets: DataFrame, risks: DataFrame, shortest: int = 3) -> DataFrame:
    """(target, risk): pairs of names of which one holds the other, in any case; names shorter than `shortest` meet only as a whole.

    A name holds another one only if it has all of its pieces of `shortest` signs. So the names are indexed by their pieces,
    as many as they have signs, and each looks up just its rarest one; what is found is verified. Null names meet nothing.
    """
    def pieces(df: DataFrame) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.length("low") - (shortest - 1)), lambda i: F.substring("low", i, F.lit(shortest)))
        return df.where(F.length("low") >= shortest).select("name", "low", F.explode(F.array_distinct(cut)).alias("piece"))

    def held(outer: DataFrame, inner: DataFrame) -> DataFrame:
        """(outer, inner) where the inner name stands in the outer one."""
        index = pieces(outer)
        often = index.groupBy("piece").agg(F.count("*").alias("n"))
        rare = pieces(inner).join(often, "piece", "left").groupBy("name", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("x")).where("x.n > 0")
        rare = rare.select(F.col("name").alias("inner"), F.col("low").alias("inner_low"), F.col("x.piece").alias("piece"))
        return index.join(rare, "piece").where(F.contains("low", "inner_low")).select(F.col("name").alias("outer"), "inner")

    t, r = (df.select(F.col(c).alias("name"), F.lower(c).alias("low")).distinct() for df, c in ((targets, "target"), (risks, "risk")))
    whole = t.select(F.col("name").alias("target"), "low").join(r.select(F.col("name").alias("risk"), "low"), "low").select("target", "risk")
    inside = held(t, r).select(F.col("outer").alias("target"), F.col("inner").alias("risk"))
    around = held(r, t).select(F.col("inner").alias("target"), F.col("outer").alias("risk"))
    return whole.union(inside).union(around).distinct()


@R.frame("""WITH t AS (SELECT DISTINCT p_type AS target FROM part), r AS (SELECT DISTINCT string_split(p_type, ' ')[1] AS risk FROM part UNION SELECT DISTINCT p_type || ' x' FROM part WHERE p_partkey % 5 = 0)
 SELECT target, risk FROM t JOIN r ON contains(lower(target), lower(risk)) OR contains(lower(risk), lower(target))""")
def mutual_substring_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    risks = part.select(F.split("p_type", " ")[0].alias("risk")).union(part.where("p_partkey % 5 = 0").select(F.concat("p_type", F.lit(" x"))))
    return mutual_substrings(part.select(F.col("p_type").alias("target")), risks)


R.sql("cache_validity", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'version' WHEN o_orderdate < (SELECT max(o_orderdate) FROM {orders}) - INTERVAL '7' DAY THEN 'expired' ELSE 'valid' END AS status FROM {orders}")
R.sql("guarded_sink_first_rule", "SELECT l_orderkey, l_linenumber, min(rule) AS rule FROM (SELECT l.l_orderkey, l.l_linenumber, p.p_size % 5 AS rule FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey WHERE p.p_size % 5 <> 0 OR l.l_discount > 5e-2) x GROUP BY l_orderkey, l_linenumber")
R.sql("line_type_dedup", "SELECT doc_type, line, min(id) AS id FROM (SELECT l_returnflag AS doc_type, l_linenumber AS line, l_orderkey AS id FROM {lineitem}) x GROUP BY doc_type, line")
