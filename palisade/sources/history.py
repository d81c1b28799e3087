"""Recorded output of version control: blame records of several lines, and lists of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import text as T

_HEADER = r"^[0-9a-f]{8,40} \d+ \d+"
#: Fixed value: changed files that are listed.
MOST_CHANGED = 500


def blame(spark: SparkSession, path: str | list[str], fill: bool = False) -> DataFrame:
    """(file, line, hash, author, date, summary, text): recorded porcelain blames, a row for each line.

    A record ends where a line begins with a tab, so that is where the reader splits: files are read in parts like any text,
    and none has to fit a task. A part holds a line's text and the next one's header; numbers bring them together. A
    commit is described at its first line alone: later ones have empty fields, or with `fill` the same as the first.
    Names and summaries are redacted. Files must blame consecutive lines.
    """
    parts = spark.read.option("lineSep", "\n\t").text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("x"))
    second, first = F.get("x", F.lit(1)), F.col("x")[0]
    at = F.when(F.coalesce(second.rlike(_HEADER), F.lit(False)), 1).when(first.rlike(_HEADER) & F.coalesce(second.startswith("author "), F.lit(False)), 0)
    parts = parts.withColumn("at", at).withColumn("head", F.expr("get(x, at)")).withColumn("number", F.split("head", " ")[2].cast("int"))
    said = lambda name: F.coalesce(F.expr(f"substring(get(filter(x, (y, i) -> i > at and startswith(y, '{name} ')), 0), {len(name) + 2})"), F.lit(""))
    heads = parts.where("at is not null").select("file", F.col("number").alias("line"), F.substring("head", 1, 8).alias("hash"), said("author").alias("author"), said("author-mail").alias("mail"), said("committer-time").alias("time"), said("summary").alias("summary"))
    texts = parts.where("at is null or at = 1").select("file", (F.col("number") - 1).alias("line"), F.col("x")[0].alias("text"))
    ends = heads.groupBy("file").agg(F.max("line").alias("last"))
    texts = texts.join(ends, "file").select("file", F.coalesce("line", "last").alias("line"), "text")
    rows = heads.join(texts, ["file", "line"])
    if fill:
        known = heads.groupBy("file", "hash").agg(*[F.max(c).alias(c) for c in ("author", "mail", "time", "summary")])
        rows = rows.drop("author", "mail", "time", "summary").join(known, ["file", "hash"])
    clean = lambda c: T.replaced(F.col(c), T.REDACT_B)
    author = F.when(F.col("mail") == "", clean("author")).otherwise(F.concat(clean("author"), F.lit(" "), clean("mail")))
    date = F.coalesce(F.date_format(F.timestamp_seconds(F.col("time").try_cast("long")), "yyyy-MM-dd"), F.lit(""))
    return rows.select("file", "line", "hash", author.alias("author"), date.alias("date"), clean("summary").alias("summary"), "text")


def changed_files(outputs: DataFrame, most: int = MOST_CHANGED) -> DataFrame:
    """(*keys, file, truncated) of recorded lists of changed files, outputs (..., text): the first `most` each, in order (the limit is the feature)."""
    keys = [c for c in outputs.columns if c != "text"]
    lines = F.filter(F.transform(F.split(F.trim("text"), "\n"), lambda x: F.replace(x, F.lit("\\"), F.lit("/"))), lambda x: (x != "") & ~x.startswith(" "))
    each = outputs.select(*keys, lines.alias("_x"))
    return each.select(*keys, F.explode(F.slice("_x", 1, most)).alias("file"), (F.size("_x") > most).alias("truncated"))
