"""Machines composed in blocks, and matching in rounds, against sequential folds."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import machines as M


def folded(machine, steps, start=0):
    state, at = start, None
    for seq, symbol in sorted(steps):
        new = machine.moves[symbol][state] if symbol in machine.moves else state
        if new in machine.final and state not in machine.final:
            at = seq
        state = new
    return state, at


@pytest.mark.parametrize("width", [2, 7, 1024])
def test_runs_of_any_length(spark, width):
    rng = random.Random(width)
    machines = [M.consecutive(5, "x", "y"), M.rounds(12, "x", "y"), M.Machine(4, {"x": [1, 2, 3, 3], "y": [2, 0, 1, 3], "z": [0, 0, 0, 3]}, frozenset([3]))]
    runs = {f"r{k}": [(s, rng.choice("xxyzq") if k % 2 else rng.choice(["x", "x", "x", "y", None])) for s in rng.sample(range(-50, 3000), n)] for k, n in enumerate([1, 3, 40, 200, 700])}
    rows = [(r, s, x) for r, steps in runs.items() for s, x in steps]
    df = spark.createDataFrame(rows, "run string, seq long, symbol string").repartition(3)
    for machine in machines:
        got = {r.run: (r.state, r.at) for r in M.run(df, ["run"], "seq", "symbol", machine, width=width).collect()}
        assert got == {r: folded(machine, steps) for r, steps in runs.items()}


def test_no_steps_no_rows(spark):
    df = spark.createDataFrame([], "run string, seq long, symbol string")
    assert M.run(df, ["run"], "seq", "symbol", M.consecutive(2, "x", "y")).count() == 0
    with pytest.raises(ValueError):
        M.Machine(2, {"x": [1, 0]}, frozenset([1]))


def test_terminations_in_order_of_the_steps(spark):
    blocked = [("blocked", k, k in (2, 3, 4, 6, 7, 8, 9, 10, 11), 1, 0, False) for k in range(20)]
    rows = blocked + [("cost", k, False, 7, 0, False) for k in range(40)] + [("steps", k, False, 0, 0, False) for k in range(200)] + [("late", k, False, 0, 100 * k, k == 9) for k in range(12)]
    rows += [("done", 1, False, 0, 0, True), ("open", 1, None, None, None, None), ("both", 0, False, 121, 721, True)]
    df = spark.createDataFrame(rows, "run string, seq long, blocked boolean, cents int, seconds int, done boolean")
    got = {r.run: (r.reason, r.at) for r in M.terminations(df, ["run"], "seq", F.col("blocked"), F.col("cents") / F.lit(100).cast("decimal(10,0)"), F.col("seconds"), F.col("done")).collect()}
    assert got == {"blocked": ("blocked_read_recovery", 10), "cost": ("cost_cap", 17), "steps": ("hard_cap", 80), "late": ("wall_clock", 8), "done": ("finish", 1), "open": (None, None), "both": ("wall_clock", 0)}


def test_verdicts_by_rounds(spark):
    rows = [("a", k, k == 11) for k in range(30)] + [("b", k, k == 12) for k in range(30)] + [("c", k, False) for k in range(4)] + [("d", 5, True), ("d", 6, None)]
    got = {r.f: (r.verdict, r.at) for r in M.verdicts(spark.createDataFrame(rows, "f string, n long, ok boolean"), ["f"], "n", F.col("ok")).collect()}
    assert got == {"a": ("PROVEN", 11), "b": ("INCONCLUSIVE", 11), "c": ("UNPROVEN", None), "d": ("PROVEN", 5)}


def test_first_over_a_budget(spark):
    rng = random.Random(8)
    runs = {k: [(s, rng.randrange(4)) for s in sorted(rng.sample(range(5000), 300))] for k in range(6)}
    df = spark.createDataFrame([(k, s, c) for k, steps in runs.items() for s, c in steps], "run int, seq long, cost int")
    want = {}
    for k, steps in runs.items():
        spent = 0
        for s, c in steps:
            spent += c
            if spent > 400:
                want[k] = s
                break
    assert {r.run: r.at for r in M.first_over(df, ["run"], "seq", F.col("cost"), 400, width=16).collect()} == want


def test_matching_in_rounds_is_the_greedy_one(spark):
    rng = random.Random(5)
    rows = list({(rng.choice("abc"), rng.randrange(12), rng.randrange(12)): rng.randrange(6) for _ in range(220)}.items())
    rows = [(*k, s) for k, s in rows] + [("chain", k, k + d, 100 - 2 * k - d) for k in range(15) for d in (0, 1)]
    want, seen = set(), set()
    for g, a, b, s in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if (g, "l", a) not in seen and (g, "r", b) not in seen:
            seen |= {(g, "l", a), (g, "r", b)}
            want.add((g, a, b, s))
    df = spark.createDataFrame(rows, "g string, a int, b int, s int")
    assert {tuple(r) for r in M.matched(df, ["g"], "a", "b", "s").collect()} == want
    assert M.matched(df.limit(0), ["g"], "a", "b", "s").count() == 0


def test_line_matches_are_maximal(spark):
    sf = "/root/testdata/sf0.001"
    pairs = [(r.l_suppkey, r.l_partkey, r.score) for r in M._line_pairs(spark, sf).collect()]
    want, left, right = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((a, b, s))
    assert {tuple(r) for r in M.greedy_line_matches(spark, sf).select("l_suppkey", "l_partkey", "score").collect()} == want
