"""Operators on telemetry, reads and findings of any table: ranges, budgets, throttles, retention, review queues, metrics, gates.

Each works on the columns it is told; the registered queries apply them to the test tables, and their oracles say the
same in SQL of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.functions.scoring import ratio
from palisade.plans.registry import Registry, table

R = Registry()


def _ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


# ---- ranges


def merged_ranges(df: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """(keys, island, start_, end_, n): closed ranges joined where they overlap or touch (end + 1 = start); islands counted from 1 by start."""
    w = _ordered(keys, [start, end, tie])
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0)
    islands = df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min(start).alias("start_"), F.max(end).alias("end_"), F.count("*").alias("n"))


def range_gaps(df: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """(keys, gap_start, gap_end): what lies between merged ranges."""
    m = merged_ranges(df, keys, start, end, tie)
    after = F.lead("start_").over(_ordered(keys, ["start_"]))
    return m.withColumn("_next", after).where(F.col("_next").isNotNull()).select(*keys, (F.col("end_") + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_end"))


def overlap_fractions(df: DataFrame, keys: list[str], id_: str, start: str, end: str, width: int) -> DataFrame:
    """(id, fraction): the largest share of a range that an earlier one (smaller id) of the same keys covers; only ranges that have one.

    Ranges meet in buckets of `width` places, so a key with many of them is dealt over its buckets; a range longer than
    that stands in several.
    """
    buckets = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_bucket")
    new = df.select(*keys, F.col(id_).alias("id"), F.col(start).alias("_s"), F.col(end).alias("_e"), buckets)
    old = new.select(*keys, "_bucket", F.col("id").alias("_id"), F.col("_s").alias("_os"), F.col("_e").alias("_oe"))
    met = new.join(old, [*keys, "_bucket"]).where((F.col("_id") < F.col("id")) & (F.col("_os") <= F.col("_e")) & (F.col("_s") <= F.col("_oe")))
    share = (F.least("_e", "_oe") - F.greatest("_s", "_os") + 1).cast("double") / (F.col("_e") - F.col("_s") + 1)
    return met.groupBy("id").agg(F.max(share).alias("fraction"))


def covered(df: DataFrame, ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """df with `covered`: whether one of the ranges (keys, start_, end_) holds the whole range; every row gets an answer.

    Among the ranges that begin at or before a row, one holds it just if the farthest end does: a running maximum over both,
    in the order of their starts. No row meets the ranges of its key one by one. Null bounds are held by nothing.
    """
    both = df.select(*df.columns, F.col(start).alias("_at"), F.lit(1).alias("_row"), F.lit(None).cast("long").alias("_reach")).unionByName(
        ranges.where("start_ is not null and end_ is not null").select(*keys, F.col("start_").alias("_at"), F.lit(0).alias("_row"), F.col("end_").cast("long").alias("_reach")), allowMissingColumns=True
    )
    reach = F.max("_reach").over(Window.partitionBy(*keys).orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("covered", F.coalesce((reach >= F.col(end)) & F.col(start).isNotNull(), F.lit(False))).where("_row = 1").select(*df.columns, "covered")


# ---- steps in order


def throttled(df: DataFrame, keys: list[str], what: str, order: list[str], most: int) -> DataFrame:
    """df with `nth` (how often its action had come up to here) and `blocked` (more often than `most`)."""
    nth = F.row_number().over(_ordered([*keys, what], order))
    return df.withColumn("nth", nth).withColumn("blocked", F.col("nth") > most)


def runs(df: DataFrame, keys: list[str], what: str, order: list[str]) -> DataFrame:
    """(keys, what, run, length): maximal runs of equal actions in order."""
    run = F.row_number().over(_ordered(keys, order)) - F.row_number().over(_ordered([*keys, what], order))
    return df.withColumn("run", run).groupBy(*keys, what, "run").agg(F.count("*").alias("length"))


def within_budget(df: DataFrame, keys: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """The rows whose costs up to and with them stay within the budget, with what was `spent`."""
    spent = F.sum(cost).over(_ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("spent", spent).where(F.col("spent") <= budget)


def read_caps(df: DataFrame, keys: list[str], order: list[str], is_read: Column, least: int, share: Column) -> DataFrame:
    """df with `seen` reads and `steps` so far, and `capped`: more than `least` reads that make more than `share` of the steps."""
    w = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("seen", F.count(F.when(is_read, 1)).over(w)).withColumn("steps", F.count(F.lit(1)).over(w))
    return out.withColumn("capped", (F.col("seen") > least) & (F.col("seen") > F.col("steps") * share))


# ---- kept state


def retained(df: DataFrame, ts: str, tie: str, last: int, days: int) -> DataFrame:
    """All rows where there are at most `last`; else the last `last`, without those older than `days` before the newest.

    (The limits are the feature.) A top-n and one aggregate: no window over the whole table.
    """
    of = df.agg(F.count("*").alias("_n"), F.max(ts).alias("_newest"))
    top = df.orderBy(F.desc(ts), F.desc(tie)).limit(last)
    return top.crossJoin(F.broadcast(of)).where((F.col("_n") <= last) | (F.col(ts) >= F.col("_newest") - F.make_interval(days=F.lit(days)))).select(*df.columns)


def upserted(df: DataFrame, keys: list[str], order: list[str], carry: list[str], cap: int) -> DataFrame:
    """(keys, carry, times): the latest row for each key and how often it came, the `cap` latest keys (the limit is the feature)."""
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*dict.fromkeys([*order, *carry])), F.struct(*order)).alias("_r"), F.count("*").alias("times"))
    top = latest.orderBy(*[F.desc(f"_r.{c}") for c in order], *keys).limit(cap)
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in carry], "times")


def decided(queue: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """A queue with the last decision (keys, decision, reason, at) for each item; 'pending' where there is none."""
    last = decisions.groupBy(*keys).agg(F.max_by(F.struct("decision", "reason", "at"), F.struct("at", "decision")).alias("_d"))
    out = queue.join(last, keys, "left")
    return out.withColumn("decision", F.coalesce("_d.decision", F.lit("pending"))).withColumn("decision_reason", F.col("_d.reason")).withColumn("decided_at", F.col("_d.at")).drop("_d")


def cleared(queue: DataFrame, resolved_only: bool) -> DataFrame:
    """What is left of a decided queue when it is cleared: nothing, or the pending items."""
    return queue.where(F.col("decision") == "pending") if resolved_only else queue.where(F.lit(False))


def false_positives(queue: DataFrame, keys: list[str], finding: str, evidence: str) -> DataFrame:
    """Rejected reviews as false positives: (keys, fingerprint): the hash of the finding and the evidence's hash."""
    return queue.where(F.col("decision") == "rejected").select(*keys, T.sha16(F.concat_ws(":", finding, T.sha16(F.col(evidence)))).alias("fingerprint")).distinct()


def approvals(events: DataFrame, id_: str, ts: str, kind: str, timeout: str = "5 minutes") -> DataFrame:
    """(id, status, settled_at): requests of recorded approval events (requested, approved, denied) with how they ended: the
    first answer in time settles one; without any it has expired."""
    asked = events.where(F.col(kind) == "requested").groupBy(F.col(id_).alias("id")).agg(F.min(ts).alias("asked"))
    answers = events.where(F.col(kind).isin("approved", "denied")).select(F.col(id_).alias("id"), F.col(ts).alias("at"), F.col(kind).alias("kind"))
    in_time = asked.join(answers, "id").where((F.col("at") >= F.col("asked")) & (F.col("at") <= F.col("asked") + F.expr(f"INTERVAL {timeout}")))
    first = in_time.groupBy("id").agg(F.min_by(F.struct("kind", "at"), F.struct("at", "kind")).alias("f"))
    return asked.join(first, "id", "left").select("id", F.coalesce("f.kind", F.lit("expired")).alias("status"), F.col("f.at").alias("settled_at"))


def with_ttl(df: DataFrame, keys: list[str], ts: str, id_: str, days: int) -> DataFrame:
    """(keys, first_id, last_id) of the keys last seen within `days` of the newest row."""
    newest = df.agg(F.max(ts).alias("_newest"))
    seen = df.groupBy(*keys).agg(F.min(id_).alias("first_id"), F.max(id_).alias("last_id"), F.max(ts).alias("_seen"))
    return seen.crossJoin(F.broadcast(newest)).where(F.col("_seen") >= F.col("_newest") - F.make_interval(days=F.lit(days))).select(*keys, "first_id", "last_id")


# ---- evaluation


def confusion(cases: DataFrame, keys: list[str], positive: Column, found: Column, failed: Column | None = None) -> DataFrame:
    """(keys, cases, tp, fp, fn, tn, recall, precision, fpr, f1, completion): failed cases count for completion alone.

    recall and fpr are 0 where nothing could be found, precision is 1 where nothing was.
    """
    failed = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    count = lambda c: F.count(F.when(c & ~failed, 1))
    n = cases.groupBy(*keys).agg(F.count("*").alias("cases"), F.count(F.when(~failed, 1)).alias("completed"), count(positive & found).alias("tp"), count(~positive & found).alias("fp"), count(positive & ~found).alias("fn"), count(~positive & ~found).alias("tn"))
    c = lambda x: F.col(x).cast("double")
    out = n.withColumn("recall", ratio(c("tp"), c("tp") + c("fn"))).withColumn("precision", ratio(c("tp"), c("tp") + c("fp"), 1.0)).withColumn("fpr", ratio(c("fp"), c("fp") + c("tn")))
    f1 = ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).withColumn("completion", ratio(c("completed"), c("cases"))).drop("completed")


#: How far a candidate's metrics may drop.
MAX_DROP = {"precision": 0.02, "recall": 0.02, "completion": 0.03}


def regression(baseline: DataFrame, candidate: DataFrame, same: list[str] = ("cases",)) -> DataFrame:
    """One row (verdict, reasons, <metric>_delta): a candidate's metrics against a baseline's, both of one row.

    A drop beyond MAX_DROP, and any column of `same` that differs, is a reason; any reason fails.
    """
    cols = [*MAX_DROP, *same]
    b, c = (x.select([F.col(n).alias(f"{side}_{n}") for n in cols]) for side, x in (("b", baseline), ("c", candidate)))
    both = b.crossJoin(c)  # one row by one row
    reasons = [F.when(F.col(f"c_{m}") - F.col(f"b_{m}") < -d, F.lit(f"{m} dropped")) for m, d in MAX_DROP.items()] + [F.when(~F.col(f"c_{n}").eqNullSafe(F.col(f"b_{n}")), F.lit(f"{n} mismatch")) for n in same]
    why = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    return both.select(F.when(F.size(why) == 0, "pass").otherwise("fail").alias("verdict"), F.array_join(why, ", ").alias("reasons"), *[(F.col(f"c_{m}") - F.col(f"b_{m}")).alias(f"{m}_delta") for m in MAX_DROP])


def rollup(samples: DataFrame, verdict: str, root_cause: str, level: str, gates: str) -> DataFrame:
    """One row over audit samples: counts by the five verdicts, distinct root causes, samples by level and failures by gate (arrays of name:count in order)."""
    #: Fixed values.
    verdicts = ["PROVEN", "UNPROVEN", "INCONCLUSIVE", "NOT_REPRODUCIBLE", "SKIPPED"]
    one = samples.agg(F.count("*").alias("total"), *[F.count(F.when(F.col(verdict) == v, 1)).alias(v.lower()) for v in verdicts], F.countDistinct(root_cause).alias("root_causes"))
    # both histograms are aggregated before they are gathered: as many entries as there are names
    tally = lambda df, name, out: df.groupBy(name).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.concat_ws(":", name, F.col("n").cast("string")))).alias(out))
    levels = tally(samples.select(F.coalesce(F.col(level), F.lit("unspecified")).alias("_level")), "_level", "levels")
    failures = tally(samples.select(F.explode(gates).alias("_gate")), "_gate", "gate_failures")
    return one.crossJoin(levels).crossJoin(failures)  # one row each


def fingerprint(df: DataFrame, keys: list[str], line: Column, groups: DataFrame | None = None) -> DataFrame:
    """(keys, fingerprint): the first 16 hexadecimal digits of the SHA-256 of a group's lines, sorted and joined by line breaks.

    Null lines don't count. groups (keys): groups that are to have a row in any case, with an empty fingerprint where
    there are no lines. The digest of an ordered sequence can't be taken in parts, so a group is hashed by one task, but
    as a stream over sorted rows: none is held as a whole.
    """
    rows = df.select(F.to_json(F.struct(*[F.col(k) for k in keys])).alias("_key"), line.cast("string").alias("_line"), *keys).where("_line is not null")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for batch in batches:
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("_line").to_pylist(), strict=True):
                if digest is None or key != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()[:16]))
                    now, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"\n" + text.encode())
        if digest is not None:
            out.append((now, digest.hexdigest()[:16]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["_key", "fingerprint"])

    hashed = rows.select("_key", "_line").repartition("_key").sortWithinPartitions("_key", "_line").mapInArrow(digests, "_key string, fingerprint string")
    names = (rows if groups is None else groups).select(F.to_json(F.struct(*[F.col(k) for k in keys])).alias("_key"), *keys).dropDuplicates(["_key"])
    return names.join(hashed, "_key", "left").select(*keys, F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


# ---- registered

_t = lambda spark, sf_dir, name: table(spark, sf_dir, name)
_ROWS = "r AS (SELECT user_id, event_id AS id, CAST(floor(value * 10) AS BIGINT) AS s, CAST(floor(value * 10) AS BIGINT) + event_id % 7 AS e FROM events)"


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.col("value") * 10).cast("long")
    return _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), s.alias("s"), (s + F.col("event_id") % 7).alias("e"))


@R.frame(f"""WITH {_ROWS}, b AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
 c AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM b)
 SELECT user_id, island, min(s) AS start_, max(e) AS end_, count(*) AS n FROM c GROUP BY user_id, island""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_ranges(ranges(spark, sf_dir), ["user_id"], "s", "e", "id")


@R.frame(f"""WITH {_ROWS} SELECT user_id, e + 1 AS gap_start, next_ - 1 AS gap_end FROM (SELECT user_id, max(e) OVER (PARTITION BY user_id ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS e,
 lead(s) OVER (PARTITION BY user_id ORDER BY s, e, id) AS next_ FROM r) WHERE next_ > e + 1""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_gaps(ranges(spark, sf_dir), ["user_id"], "s", "e", "id")


@R.frame(f"WITH {_ROWS} SELECT n.id, max(CAST(least(n.e, o.e) - greatest(n.s, o.s) + 1 AS DOUBLE) / (n.e - n.s + 1)) AS fraction FROM r n JOIN r o ON n.user_id = o.user_id AND o.id < n.id AND o.s <= n.e AND n.s <= o.e GROUP BY n.id")
def overlap_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_fractions(ranges(spark, sf_dir), ["user_id"], "id", "s", "e", 8)


@R.frame(f"WITH {_ROWS} SELECT n.id, count(o.id) > 0 AS covered FROM r n LEFT JOIN (SELECT user_id, id, s, e FROM r WHERE id % 3 = 0) o ON n.user_id = o.user_id AND o.s <= n.s AND n.e <= o.e GROUP BY n.id")
def range_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any single read of every third event holds the range."""
    rows = ranges(spark, sf_dir)
    reads = rows.where("id % 3 = 0").select("user_id", F.col("s").alias("start_"), F.col("e").alias("end_"))
    return covered(rows, reads, ["user_id"], "s", "e").select("id", "covered")


@R.frame("SELECT event_id, user_id, event_type, rn > 2 AS blocked, rn AS nth FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)")
def repeat_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttled(_t(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"], 2).select("event_id", "user_id", "event_type", "blocked", "nth")


@R.frame("""SELECT user_id, max(length_) AS longest FROM (SELECT user_id, event_type, grp, count(*) AS length_ FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS grp FROM events) x
 GROUP BY user_id, event_type, grp) y WHERE event_type = 'error' GROUP BY user_id""")
def retry_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(_t(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"]).where("event_type = 'error'").groupBy("user_id").agg(F.max("length").alias("longest"))


@R.frame("SELECT event_id, user_id, spent FROM (SELECT event_id, user_id, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM events) x WHERE spent <= 20000")
def running_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within_budget(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.floor(F.col("value") * 100).cast("long"), 20000).select("event_id", "user_id", "spent")


@R.frame("""SELECT event_id, user_id, seen, steps, seen > 5 AND seen * 10 > steps * 4 AS capped FROM (SELECT event_id, user_id, count(CASE WHEN event_type = 'view' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen,
 count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS steps FROM events) x""")
def read_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_caps(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", 5, F.lit("0.4").cast("decimal(3,1)")).select("event_id", "user_id", "seen", "steps", "capped")


@R.frame("""SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER () AS n, ts, max(ts) OVER () AS last FROM events) x
 WHERE n <= 1000 OR (rn <= 1000 AND ts >= last - INTERVAL '90' DAY)""")
def retention_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained(_t(spark, sf_dir, "events"), "ts", "event_id", 1000, 90).select("event_id")


@R.frame("""SELECT user_id, event_type, event_id, reopened FROM (SELECT user_id, event_type, event_id, n > 1 AS reopened, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS age FROM (SELECT user_id, event_type, event_id, ts,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) x WHERE rn = 1) y WHERE age <= 500""")
def review_queue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted(_t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id"], 500).select("user_id", "event_type", "event_id", (F.col("times") > 1).alias("reopened"))


@R.frame("""SELECT finding, evidence, event_id FROM (SELECT finding, evidence, event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS age FROM (SELECT event_type AS finding, user_id % 20 AS evidence, event_id, ts,
 row_number() OVER (PARTITION BY event_type, user_id % 20 ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1) y WHERE age <= 100""")
def false_positive_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("ts", "event_id", F.col("event_type").alias("finding"), (F.col("user_id") % 20).alias("evidence"))
    return upserted(rows, ["finding", "evidence"], ["ts", "event_id"], ["event_id"], 100).drop("times")


@R.frame("""WITH q AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'signup'), d AS (SELECT user_id, event_type, CASE WHEN event_id % 3 = 0 THEN 'accepted' ELSE 'rejected' END AS decision, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, CASE WHEN event_id % 3 = 0 THEN 'accepted' ELSE 'rejected' END DESC, event_id DESC) AS rn FROM events WHERE event_id % 2 = 0)
 SELECT q.user_id, q.event_type, coalesce(d.decision, 'pending') AS decision FROM q LEFT JOIN d ON d.user_id = q.user_id AND d.event_type = q.event_type AND d.rn = 1""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    queue = e.where("event_type <> 'signup'").select("user_id", "event_type").distinct()
    said = e.where("event_id % 2 = 0").select("user_id", "event_type", F.when(F.col("event_id") % 3 == 0, "accepted").otherwise("rejected").alias("decision"), F.lit("").alias("reason"), F.col("ts").alias("at"))
    return decided(queue, said, ["user_id", "event_type"]).select("user_id", "event_type", "decision")


@R.frame("""WITH a AS (SELECT user_id AS id, min(ts) AS asked FROM events WHERE event_type = 'signup' GROUP BY user_id), n AS (SELECT user_id AS id, ts AS answered, CASE event_type WHEN 'purchase' THEN 'approved' ELSE 'denied' END AS kind FROM events WHERE event_type IN ('purchase', 'error')),
 f AS (SELECT a.id, arg_min(kind, strftime(answered, '%Y%m%d%H%M%S.%f') || kind) AS kind FROM a JOIN n ON n.id = a.id AND answered >= asked AND answered <= asked + INTERVAL '10' DAY GROUP BY a.id) SELECT a.id, coalesce(f.kind, 'expired') AS status FROM a LEFT JOIN f ON f.id = a.id""")
def approval_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "requested").when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "denied")
    return approvals(_t(spark, sf_dir, "events").withColumn("kind", kind), "user_id", "ts", "kind", "10 days").select("id", "status")


@R.frame("""SELECT user_id, event_type, first_id, last_id FROM (SELECT user_id, event_type, min(event_id) AS first_id, max(event_id) AS last_id, max(ts) AS seen FROM events GROUP BY user_id, event_type) x
 WHERE seen >= (SELECT max(ts) FROM events) - INTERVAL '10' DAY""")
def notes_with_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ttl(_t(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 10)


_CONFUSION = """SELECT fold, n AS cases, tp, fp, fn, tn, CASE WHEN tp + fn = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall, CASE WHEN tp + fp = 0 THEN 1e0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
 CASE WHEN fp + tn = 0 THEN 0e0 ELSE CAST(fp AS DOUBLE) / (fp + tn) END AS fpr, CASE WHEN n = 0 THEN 0e0 ELSE CAST(tp + fp + fn + tn AS DOUBLE) / n END AS completion FROM (SELECT CAST(d.doc_id % 2 AS BIGINT) AS fold, count(*) AS n,
 count(CASE WHEN l.quality = 0 AND d.n_chars < 400 AND d.doc_id % 11 > 0 THEN 1 END) AS tp, count(CASE WHEN l.quality = 1 AND d.n_chars < 400 AND d.doc_id % 11 > 0 THEN 1 END) AS fp,
 count(CASE WHEN l.quality = 0 AND d.n_chars >= 400 AND d.doc_id % 11 > 0 THEN 1 END) AS fn, count(CASE WHEN l.quality = 1 AND d.n_chars >= 400 AND d.doc_id % 11 > 0 THEN 1 END) AS tn FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1) x"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").withColumn("fold", (F.col("doc_id") % 2).cast("long"))
    return confusion(cases, ["fold"], F.col("quality") == 0, F.col("n_chars") < 400, F.col("doc_id") % 11 == 0)


@R.frame(_CONFUSION)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).drop("f1")


@R.frame(f"""WITH m AS ({_CONFUSION}), d AS (SELECT b.precision - a.precision AS p, b.recall - a.recall AS r, b.completion - a.completion AS c, a.cases <> b.cases AS other FROM m a JOIN m b ON a.fold = 0 AND b.fold = 1)
 SELECT p AS precision_delta, r AS recall_delta, c AS completion_delta, CASE WHEN p < -2e-2 OR r < -2e-2 OR c < -3e-2 OR other THEN 'fail' ELSE 'pass' END AS verdict,
 array_to_string(list_filter([CASE WHEN p < -2e-2 THEN 'precision dropped' END, CASE WHEN r < -2e-2 THEN 'recall dropped' END, CASE WHEN c < -3e-2 THEN 'completion dropped' END, CASE WHEN other THEN 'cases mismatch' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM d""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    return regression(m.where("fold = 0"), m.where("fold = 1"))


@R.frame("""WITH s AS (SELECT CASE event_id % 5 WHEN 0 THEN 'PROVEN' WHEN 1 THEN 'UNPROVEN' WHEN 2 THEN 'INCONCLUSIVE' WHEN 3 THEN 'NOT_REPRODUCIBLE' ELSE 'SKIPPED' END AS v, user_id, CASE WHEN event_id % 4 > 0 THEN event_type END AS level, list_filter([CASE WHEN event_id % 2 = 0 THEN 'exploit' END, CASE WHEN event_id % 7 = 0 THEN 'impact' END], lambda x: x IS NOT NULL) AS gates FROM events)
 SELECT count(*) AS total, count(CASE WHEN v = 'PROVEN' THEN 1 END) AS proven, count(CASE WHEN v = 'UNPROVEN' THEN 1 END) AS unproven, count(CASE WHEN v = 'INCONCLUSIVE' THEN 1 END) AS inconclusive, count(CASE WHEN v = 'NOT_REPRODUCIBLE' THEN 1 END) AS not_reproducible, count(CASE WHEN v = 'SKIPPED' THEN 1 END) AS skipped,
 count(DISTINCT user_id) AS root_causes, (SELECT string_agg(l || ':' || n, ',' ORDER BY l) FROM (SELECT coalesce(level, 'unspecified') AS l, CAST(count(*) AS VARCHAR) AS n FROM s GROUP BY 1)) AS levels,
 (SELECT string_agg(g || ':' || n, ',' ORDER BY g) FROM (SELECT g, CAST(count(*) AS VARCHAR) AS n FROM (SELECT unnest(gates) AS g FROM s) GROUP BY g)) AS gate_failures FROM s""")
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    v = F.element_at(F.array(*[F.lit(x) for x in ("PROVEN", "UNPROVEN", "INCONCLUSIVE", "NOT_REPRODUCIBLE", "SKIPPED")]), (i % 5 + 1).cast("int"))
    gates = F.filter(F.array(F.when(i % 2 == 0, "exploit"), F.when(i % 7 == 0, "impact")), lambda x: x.isNotNull())
    samples = _t(spark, sf_dir, "events").select(v.alias("v"), "user_id", F.when(i % 4 > 0, F.col("event_type")).alias("level"), gates.alias("gates"))
    return rollup(samples, "v", "user_id", "level", "gates").withColumn("levels", F.array_join("levels", ",")).withColumn("gate_failures", F.array_join("gate_failures", ","))


@R.frame("""SELECT quality, left(sha256(string_agg(CAST(toxic AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(toxic AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR))), 16) AS fingerprint FROM labels GROUP BY quality""")
def memory_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("|", F.col("toxic").cast("string"), F.col("doc_id").cast("string"))
    return fingerprint(_t(spark, sf_dir, "labels"), ["quality"], line)
