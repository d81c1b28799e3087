"""Source files, logs and version-control output as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.paths import ignored, secret_file
from palisade.functions.rules import LANGUAGES, SKIP_DIRS


def workspace(spark: SparkSession, root: str, limit: int = 5000, largest: int = 1 << 20, ignore: list[str] | None = None) -> DataFrame:
    """(path, text, lang, bytes, mtime, skip_reason) of source files under root: the first `limit` by path (the limit is the feature).

    Folders that no scan enters, paths that the `ignore` patterns name and files that hold secrets are left out. Paths
    are chosen first, on the driver (at most `limit` of them); contents are read after, by the executors, and only
    of files small enough. Empty files don't appear (the file source leaves them out).
    """
    from palisade.operators.project import language

    at = root.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("mtime"))
    rel = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    inside = F.lit(True)
    for d in SKIP_DIRS:
        inside = inside & ~rel.contains(f"/{d}/")
    below = F.regexp_replace(F.expr(f"substring(path, instr(path, '{at.rpartition(':')[2].lstrip('/')}/') + {len(at.rpartition(':')[2].lstrip('/')) + 1})"), "^/+", "")
    wanted = inside & F.lower(rel).rlike("[.](" + "|".join(LANGUAGES) + ")$") & ~ignored(below, ignore or []) & ~secret_file(rel)
    chosen = listed.where(wanted).orderBy("path").limit(limit).collect()
    named = spark.createDataFrame([(r.path, r.length, r.mtime) for r in chosen], "at string, bytes long, mtime timestamp")
    small = [r.path for r in chosen if r.length <= largest]
    texts = spark.read.format("binaryFile").load([_escaped(p) for p in small]).select("path", F.decode("content", "UTF-8").alias("text")) if small else spark.createDataFrame([], "path string, text string")
    path = F.regexp_replace(F.col("at"), "^[a-z]+:/*", "/")
    reason = F.when(F.col("bytes") > largest, "too_large")
    return named.join(texts, F.col("at") == F.col("path"), "left").select(path.alias("path"), "text", language(path).alias("lang"), "bytes", "mtime", reason.alias("skip_reason"))


def _escaped(path: str) -> str:
    """A path as a glob that matches nothing else."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)


def json_lines_tail(spark: SparkSession, path: str, schema: str, n: int = 100, strict: bool = False) -> DataFrame:
    """The last n records of a JSON-lines log (by `timestamp`). Lines that can't be read are dropped; strict: one of them voids all."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    if strict:
        bad = lines.where("_corrupt is not null").limit(1).select(F.lit(1).alias("_bad"))
        lines = lines.join(F.broadcast(bad), F.lit(True), "left_anti")
    return lines.where("_corrupt is null").drop("_corrupt").orderBy(F.desc("timestamp")).limit(n)


def git_log(lines: DataFrame) -> DataFrame:
    """hash|date|author|subject lines (column value) as columns, addresses redacted."""
    from palisade.functions.text import REDACT_B, replaced

    p = F.split("value", "[|]", 4)
    return lines.where(F.size(p) == 4).select(p[0].alias("hash"), F.substring(p[1], 1, 10).alias("date"), replaced(p[2], REDACT_B).alias("author"), replaced(p[3], REDACT_B).alias("subject"))
