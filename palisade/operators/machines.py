"""State machines over runs of steps, without folding a run in one place.

A step is a map from each state to the next one; maps compose associatively, so neighbours are composed in blocks of steps,
blocks in blocks of blocks, until a run is one map. A group holds a block of `width` at most, however long the run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.plans.registry import Registry, table
from palisade.plans.scratch import written

R = Registry()


@dataclass(frozen=True)
class Machine:
    """States 0 to n - 1 and, for each symbol, the state that follows each of them; final states are never left."""

    states: int
    moves: dict[str, list[int]]
    final: frozenset[int]

    def __post_init__(self):
        for symbol, to in self.moves.items():
            if len(to) != self.states or any(to[s] != s for s in self.final):
                raise ValueError(f"moves of {symbol!r} must name a state for each state and keep final ones")


def consecutive(most: int, hit: str, miss: str) -> Machine:
    """Counts hits in a row, a miss starts anew; it ends when there are `most`."""
    return Machine(most + 1, {hit: [min(k + 1, most) for k in range(most + 1)], miss: [0] * most + [most]}, frozenset([most]))


def rounds(most: int, success: str, other: str) -> Machine:
    """Ends in state `most` + 1 at a success, in state `most` when that many rounds went without."""
    last = [most, most + 1]
    return Machine(most + 2, {success: [most + 1] * most + last, other: [k + 1 for k in range(most)] + last}, frozenset(last))


def run(steps: DataFrame, keys: list[str], seq: str, symbol: str, machine: Machine, start: int = 0, width: int = 1024) -> DataFrame:
    """(keys, state, at): the state in which each run of steps (keys, seq, symbol) ends, and the seq at which it became final (null if it didn't).

    seq orders a run and is unique in it (a long of any size, gaps are fine); null symbols and those that the machine doesn't
    know change nothing. Runs without steps have no row.
    """
    final = F.array(*[F.lit(k in machine.final) for k in range(machine.states)])
    ident = list(range(machine.states))
    known = F.create_map(*[x for s, to in machine.moves.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in to]))])
    to = F.coalesce(F.try_element_at(known, F.col(symbol)), F.array(*[F.lit(k) for k in ident]))
    position = F.col(seq).cast("long")
    # for each state: where the block leads, and where a final state was entered on the way
    moves = F.transform(to, lambda t, k: F.struct(t.alias("state"), F.when(F.element_at(final, t + 1) & ~F.element_at(final, k + 1), position).alias("at")))
    blocks = steps.select(*keys, position.alias("_seq"), moves.alias("_map"))
    step = lambda a, b: F.transform(a, lambda x: F.struct(F.element_at(b, x["state"] + 1)["state"].alias("state"), F.coalesce(x["at"], F.element_at(b, x["state"] + 1)["at"]).alias("at")))
    none = F.array(*[F.struct(F.lit(k).alias("state"), F.lit(None).cast("long").alias("at")) for k in ident])

    def composed(rows: DataFrame, names: list[str]) -> DataFrame:
        block = rows.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("_seq", "_map"))).alias("x"))
        return block.withColumn("_map", F.aggregate("x", none, lambda a, x: step(a, x["_map"]))).drop("x")

    span = steps.agg(F.max(position), F.min(position)).first()
    most = max(abs(int(v)) for v in span) if span[0] is not None else 0
    while most >= width:  # a level for each factor of `width` in the numbers
        blocks = composed(blocks.withColumn("_block", F.floor(F.col("_seq") / width)), [*keys, "_block"]).withColumnRenamed("_block", "_seq")
        most = -(-most // width)
    whole = composed(blocks, keys)
    return whole.select(*keys, F.element_at("_map", start + 1)["state"].alias("state"), F.element_at("_map", start + 1)["at"].alias("at"))


def first_over(steps: DataFrame, keys: list[str], seq: str, cost: Column, budget: float, width: int = 1024) -> DataFrame:
    """(keys, at): the seq of the first step with which a run's costs pass the budget. Costs are not negative; null costs nothing.

    Sums of blocks are added up first, then the steps of the one block in which the budget is passed.
    """
    rows = steps.select(*keys, F.col(seq).cast("long").alias("_seq"), F.coalesce(cost, F.lit(0)).alias("_cost")).withColumn("_block", F.floor(F.col("_seq") / width))
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_cost").alias("_sum"))
    upto = Window.partitionBy(*keys).orderBy("_block")
    before = sums.withColumn("_before", F.sum("_sum").over(upto) - F.col("_sum")).where((F.col("_before") <= budget) & (F.col("_before") + F.col("_sum") > budget))
    inside = rows.join(before.drop("_sum"), [*keys, "_block"]).withColumn("_spent", F.col("_before") + F.sum("_cost").over(Window.partitionBy(*keys, "_block").orderBy("_seq")))
    return inside.where(F.col("_spent") > budget).groupBy(*keys).agg(F.min("_seq").alias("at"))


#: The budgets of an investigation.
BLOCKED_IN_A_ROW, HARD_MAX_STEPS, COST_USD, WALL_CLOCK_S, ROUNDS = 5, 80, 1.20, 720, 12


def terminations(steps: DataFrame, keys: list[str], seq: str, blocked: Column, cost: Column, seconds: Column, finished: Column) -> DataFrame:
    """(keys, reason, at): how each run ended, and with which step: wall_clock, cost_cap, hard_cap, blocked_read_recovery or finish; null if it goes on.

    The first step that meets a condition counts, of several conditions the first in this order. seconds: the time since
    the run began. Blocked steps are counted in a row; any other step starts anew.
    """
    rows = steps.withColumn("_symbol", F.when(F.coalesce(blocked, F.lit(False)), "blocked").otherwise("other")).withColumn("_done", F.coalesce(finished, F.lit(False))).withColumn("_late", F.coalesce(seconds > WALL_CLOCK_S, F.lit(False)))
    first = lambda flag: rows.where(flag).groupBy(*keys).agg(F.min(F.col(seq).cast("long")).alias("at"))
    stuck = run(rows, keys, seq, "_symbol", consecutive(BLOCKED_IN_A_ROW, "blocked", "other")).where("at is not null").select(*keys, "at")
    parts = [
        (first("_late"), "wall_clock"), (first_over(rows, keys, seq, cost, COST_USD), "cost_cap"), (first_over(rows, keys, seq, F.lit(1), HARD_MAX_STEPS), "hard_cap"),
        (stuck, "blocked_read_recovery"), (first("_done"), "finish"),
    ]
    every = reduce(DataFrame.unionByName, [p.select(*keys, F.struct("at", F.lit(k).alias("rank"), F.lit(name).alias("reason")).alias("x")) for k, (p, name) in enumerate(parts)])
    ends = every.groupBy(*keys).agg(F.min("x").alias("x"))
    return rows.select(*keys).distinct().join(ends, keys, "left").select(*keys, F.col("x.reason").alias("reason"), F.col("x.at").alias("at"))


def verdicts(tries: DataFrame, keys: list[str], seq: str, proven: Column) -> DataFrame:
    """(keys, verdict, at): findings by their verification rounds: PROVEN with the first round that proves one, INCONCLUSIVE when 12 rounds didn't, else UNPROVEN so far."""
    rows = tries.withColumn("_symbol", F.when(F.coalesce(proven, F.lit(False)), "proven").otherwise("other"))
    out = run(rows, keys, seq, "_symbol", rounds(ROUNDS, "proven", "other"))
    return out.select(*keys, F.when(F.col("state") == ROUNDS + 1, "PROVEN").when(F.col("state") == ROUNDS, "INCONCLUSIVE").otherwise("UNPROVEN").alias("verdict"), "at")


# ---- greedy matching by rounds


def matched(pairs: DataFrame, keys: list[str], left: str, right: str, score: str) -> DataFrame:
    """(keys, left, right, score): pairs chosen greedily, best score first, ties by left then right; nothing stands in two of them.

    The same as taking pairs one after the other, but in rounds: a pair that is the best one of both its sides is taken
    whatever happens elsewhere; then what stands in it leaves. Each round is two aggregates and two anti joins over the pairs
    that are left, so no group is folded in one place.
    """
    order = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    rest = written(pairs.select(*keys, left, right, score, order.alias("_o")), "pairs")
    chosen = []
    while not rest.isEmpty():
        by = lambda side: rest.groupBy(*keys, side).agg(F.min("_o").alias("_o"))
        best = by(left).select(*keys, left, "_o").join(by(right).select(*keys, F.col(right).alias("_r"), "_o"), [*keys, "_o"])
        taken = written(best.select(*keys, F.col("_o.l").alias(left), F.col("_o.r").alias(right), (-F.col("_o.s")).alias(score)).distinct(), "matched")
        chosen.append(taken)
        rest = written(rest.join(taken.select(*keys, left), [*keys, left], "left_anti").join(taken.select(*keys, right), [*keys, right], "left_anti"), "pairs")
    return reduce(DataFrame.unionByName, chosen) if chosen else rest.drop("_o")


# ---- registered


@R.frame("""WITH e AS (SELECT user_id, event_id, event_type = 'click' AS hit, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
 c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, g, hit ORDER BY event_id) AS n FROM e WHERE hit)
 SELECT user_id, min(event_id) AS at_ FROM c WHERE n = 3 GROUP BY user_id""")
def blocked_in_a_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with three clicks in a row, and the first event that made three: the machine over each user's events."""
    steps = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", "hit").otherwise("miss").alias("symbol"))
    return run(steps, ["user_id"], "event_id", "symbol", consecutive(3, "hit", "miss")).where("at is not null").select("user_id", F.col("at").alias("at_"))


@R.frame("""WITH e AS (SELECT user_id, event_id, event_type = 'click' AS b, event_type = 'purchase' AND event_id % 5 = 0 AS done, sum(1) OVER w AS n, sum(CAST(event_id % 3 AS BIGINT)) OVER w AS c,
  sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) OVER w AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id, g, b ORDER BY event_id) AS in_row FROM e),
 x AS (SELECT user_id, event_id, CASE WHEN event_id % 997 > 990 THEN 0 WHEN c > 120 THEN 1 WHEN n > 80 THEN 2 WHEN b AND in_row >= 5 THEN 3 WHEN done THEN 4 END AS r FROM k)
 SELECT user_id, min_by(CASE r WHEN 0 THEN 'wall_clock' WHEN 1 THEN 'cost_cap' WHEN 2 THEN 'hard_cap' WHEN 3 THEN 'blocked_read_recovery' ELSE 'finish' END, event_id) FILTER (r IS NOT NULL) AS reason, min(event_id) FILTER (r IS NOT NULL) AS at_ FROM x GROUP BY user_id""")
def run_terminations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each user's events would have ended as an investigation; costs are whole hundredths."""
    e = table(spark, sf_dir, "events")
    late = F.when(F.col("event_id") % 997 > 990, WALL_CLOCK_S + 1).otherwise(0)
    ends = terminations(e, ["user_id"], "event_id", F.col("event_type") == "click", (F.col("event_id") % 3).cast("decimal(20,2)") / 100, late, (F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0))
    return ends.withColumnRenamed("at", "at_")


def _line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    return li.groupBy("l_suppkey", "l_partkey").agg(F.max("q").alias("score"))


@R.frame()
def greedy_line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts matched one to one, largest quantity first."""
    return matched(_line_pairs(spark, sf_dir).withColumn("k", F.lit(1)), ["k"], "l_suppkey", "l_partkey", "score").drop("k")
