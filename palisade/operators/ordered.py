"""What needs order within a key: exact interval admission, matching of findings, byte budgets, capped breadth-first search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.operators.machines import matched


def merged(ranges: list[list[int]], a: int, b: int) -> list[list[int]]:
    """Closed ranges with one more, touching ones (end + 1 = start) joined."""
    out: list[list[int]] = []
    for s, e in sorted([*ranges, [a, b]]):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def read_admission(reads: DataFrame) -> DataFrame:
    """(run, file, seq, admitted, overlap, covered) for reads (run, file, seq, start_line, end_line).

    In order of seq a read is refused if it repeats one, or if more than half of it overlaps a range read before;
    covered counts the file's lines read after it.
    """

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        ranges: list[list[int]] = []
        seen, out = set(), []
        for r in df.sort_values("seq").itertuples():
            over = max((max(0, min(e, r.end_line) - max(s, r.start_line) + 1) for s, e in ranges), default=0) / (r.end_line - r.start_line + 1)
            ok = (r.start_line, r.end_line) not in seen and over <= 0.5
            if ok:
                seen.add((r.start_line, r.end_line))
                ranges = merged(ranges, r.start_line, r.end_line)
            out.append((r.run, r.file, r.seq, ok, over, sum(e - s + 1 for s, e in ranges)))
        return pd.DataFrame(out, columns=["run", "file", "seq", "admitted", "overlap", "covered"])

    return reads.groupBy("run", "file").applyInPandas(fold, "run string, file string, seq long, admitted boolean, overlap double, covered long")


def greedy_matches(findings: DataFrame, expected: DataFrame, tolerance: int = 5) -> DataFrame:
    """(file, found, expected, score): one-to-one, best score first: ten for the type, five to ten for a line within the tolerance.

    Both: file, id, line, type. Pairs meet by file and a bucket of lines, never all with all.
    """
    bucket = F.floor(F.col("line") / (tolerance + 1))
    a = findings.select("file", F.col("id").alias("found"), F.col("line").alias("la"), F.col("type").alias("ta"), bucket.alias("b"))
    b = expected.select("file", F.col("id").alias("expected"), F.col("line").alias("lb"), F.col("type").alias("tb"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    near = a.join(b, ["file", "b"]).where(F.abs(F.col("la") - F.col("lb")) <= tolerance)
    near = near.withColumn("score", F.when(F.col("ta") == F.col("tb"), 10).otherwise(0) + 10 - F.abs(F.col("la") - F.col("lb"))).where("score >= 5")

    return matched(near, ["file"], "found", "expected", "score").select("file", "found", "expected", F.col("score").cast("long").alias("score"))


def capped_blast(spark: SparkSession, edges: DataFrame, seeds: list[str], depth: int = 3, most: int = 100) -> tuple[list[tuple[str, int]], int, bool]:
    """(nodes with depths in order of visit, depth reached, truncated): breadth-first over edges (src, dst), `most` nodes, seeds included.

    Only a front of at most `most` nodes and its neighbours' first `most` new ones come to the driver in each of `depth` rounds.
    """
    visited = {s: 0 for s in seeds[:most]}
    front, reached, truncated = list(visited), 0, len(seeds) > most
    for d in range(1, depth + 1):
        if not front or truncated:
            break
        reached = d
        order = spark.createDataFrame([(s, i) for i, s in enumerate(front)], "src string, rank int")
        known = spark.createDataFrame([(v,) for v in visited], "dst string")
        new = edges.join(F.broadcast(order), "src").join(F.broadcast(known), "dst", "left_anti").groupBy("dst").agg(F.min("rank").alias("rank"))
        room = most - len(visited)
        got = [r.dst for r in new.orderBy("rank", "dst").limit(room + 1).collect()]
        truncated = len(got) > room
        front = got[:room]
        visited |= {v: d for v in front}
    return list(visited.items()), reached, truncated


def budgeted(files: DataFrame, most: int = 10, budget: int = 48 * 1024, least: int = 2048) -> DataFrame:
    """(run, path, taken): files (run, path, rank, bytes) in order of rank until the byte budget has less than `least` left; the last may be cut."""

    w = Window.partitionBy("run").orderBy("rank", "path")
    before = F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = files.withColumn("_n", F.row_number().over(w)).withColumn("_left", F.lit(budget) - before)
    return rows.where((F.col("_n") <= most) & (F.col("_left") >= least)).select("run", "path", F.least("bytes", "_left").cast("long").alias("taken"))
