"""Keyed state over streams: late and repeated events, timers, and a restart from the checkpoint."""

import datetime as dt

import pytest

from palisade.streaming import keyed

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, keyed.STATE_STORE)
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ran(spark, make, schema, base, batches, out_schema):
    """Writes each batch as a file, runs the stream until nothing is new, and so again: each run starts from the checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(base / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(base / "in"))
        q = make(stream).writeStream.format("parquet").option("path", str(base / "out")).option("checkpointLocation", str(base / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    return spark.read.schema(out_schema).parquet(str(base / "out")).collect()


def test_approvals_settle_once(spark, tmp_path, rocks):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    ask = lambda id_, s, ws="w": (ws, id_, "requested", f"t-{id_}", "fix", at(s))
    say = lambda id_, kind, s, token=None, ws="w": (ws, id_, kind, token or f"t-{id_}", None, at(s))
    batches = [
        [ask("a", 0), ask("b", 1), ask("c", 2), say("a", "approved", 5), say("a", "approved", 6), say("b", "approved", 7, "wrong"), say("zz", "denied", 8), *[ask(f"m{k}", 10, "many") for k in range(18)]],
        [ask("b", 1), say("b", "denied", 20), say("a", "denied", 21), ask("d", 30)],  # after a restart; b repeats
        [ask("later", 500)], [ask("last", 900), say("c", "approved", 901)],
    ]
    rows = ran(spark, keyed.approvals, "workspace string, id string, kind string, token string, tool string, at timestamp", tmp_path, batches, keyed.AUDIT)
    got = sorted((r.id, r.reason, r.approved) for r in rows if r.workspace == "w")
    assert got == sorted([
        ("a", "approved", True), ("a", "replayed", False), ("b", "invalid-token", False), ("zz", "expired", False), ("b", "denied", False), ("a", "replayed", False),
        ("c", "timeout", False), ("d", "timeout", False), ("later", "timeout", False), ("c", "expired", False),
    ])
    many = [r.reason for r in rows if r.workspace == "many"]
    assert many.count("too-many-pending") == 2 and many.count("timeout") == 16
    assert {r.duration_ms for r in rows if r.id == "a" and r.approved} == {5000}


def test_coverage_over_restarts(spark, tmp_path, rocks):
    batches = [[("r", "f", 0, 1, 100, False), ("r", "f", 1, 90, 120, False), ("r", "f", 2, None, None, True), ("r", "g", 0, 1, 10, False)], [("r", "f", 2, None, None, True), ("r", "f", 3, 1, 100, False), ("r", "f", 4, 300, 310, False)]]
    rows = ran(spark, keyed.coverage, "run string, file string, seq long, start_line long, end_line long, blocked boolean", tmp_path, batches, keyed.COVERAGE)
    got = sorted((r.file, r.seq, r.blocked, round(r.overlap, 3), r.overlapping, r.covered, r.reads, r.blocked_reads) for r in rows)
    assert got == [("f", 0, False, 0.0, False, 100, 1, 0), ("f", 1, False, 0.355, False, 120, 2, 0), ("f", 2, True, 0.0, False, 120, 2, 1), ("f", 3, False, 1.0, True, 120, 3, 1), ("f", 4, False, 0.0, False, 131, 4, 1), ("g", 0, False, 0.0, False, 10, 1, 0)]
