"""Versioned tables: data is written first, then published by renaming a manifest into place, which only one writer can do."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import text as T


class Conflict(Exception):
    """Another writer has published this version."""


class Store:
    """Snapshots of one table in a folder that all executors share.

    data/<id> holds a snapshot as Parquet, manifests/<version>.json names it. A snapshot without a manifest was never
    published: a crash between the two leaves nothing that a reader could see, and vacuum() takes it away. Snapshots never
    change, so readers aren't disturbed by writers. A manifest of another format counts as no table.
    """

    def __init__(self, spark: SparkSession, folder: str, form: int = 1):
        self.spark, self.folder, self.form = spark, folder.rstrip("/"), form
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _listed(self, name: str) -> list[str]:
        fs, at = self._fs(), self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._listed("manifests") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if not known or version is not None and version not in known:
            return None
        found = json.loads(self.spark.read.text(f"{self.folder}/manifests/{known[-1] if version is None else version:010d}.json", wholetext=True).first().value)
        return found if found["form"] == self.form else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The latest snapshot, or that of a version; None where there is none of this format."""
        found = self.manifest(version)
        return None if found is None else self.spark.read.parquet(f"{self.folder}/{found['data']}")

    def write(self, df: DataFrame) -> str:
        """Writes a snapshot that nobody sees yet, and returns its place."""
        place = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{place}")
        return place

    def publish(self, place: str, base: int) -> int:
        """Makes a written snapshot the version after `base`. Raises Conflict if that version is there already."""
        version = base + 1
        fs, target = self._fs(), self._path("manifests", f"{version:010d}.json")
        temporary = self._path("manifests", f".{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": version, "form": self.form, "data": place}).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self._conf)
        never = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwriting
        try:
            files.rename(fs.makeQualified(temporary), fs.makeQualified(target), never)
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            raise Conflict(f"version {version}") from e
        finally:
            if fs.exists(temporary):
                fs.delete(temporary, False)
        return version

    def update(self, change: Callable[[DataFrame | None], DataFrame], attempts: int = 10) -> int:
        """Publishes change(latest snapshot), or None's change for an empty store; begins anew when another writer was faster."""
        for _ in range(attempts):
            known = self.versions()
            base = known[-1] if known else 0
            try:
                return self.publish(self.write(change(self.read(base) if known else None)), base)
            except Conflict:
                continue
        raise Conflict(f"{attempts} attempts")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last `keep` versions, and snapshots that none of these names; returns the folders deleted. Not for use beside a writer."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs().delete(self._path("manifests", f"{v:010d}.json"), False)
        used = {json.loads(r.value)["data"].rpartition("/")[2] for r in self.spark.read.text(f"{self.folder}/manifests", wholetext=True).collect()} if known else set()  # `keep` rows at most
        gone = [n for n in self._listed("data") if n not in used]
        for n in gone:
            self._fs().delete(self._path("data", n), True)
        return gone


# ---- what is kept in stores

#: Fixed value: days that a recorded scan counts.
TTL_DAYS = 7


def scan_key(path: Column, content: Column) -> Column:
    """What a scan is found by: the path and a hash of the content."""
    return F.concat(path, F.lit(":"), T.sha16(content))


def valid(entries: DataFrame, now: Column, version: int, days: int = TTL_DAYS) -> DataFrame:
    """The entries (version, at) of this version that aren't older than `days`."""
    return entries.where((F.col("version") == version) & (F.col("at") >= now - F.make_interval(days=F.lit(days))))


def remembered(store: Store, scans: DataFrame, now: Column, version: int, days: int = TTL_DAYS) -> int:
    """Adds scans (path, content, ...) under their keys: what was there of the same key is replaced, what has expired or is of another version leaves."""
    new = scans.select(scan_key(F.col("path"), F.col("content")).alias("key"), *[c for c in scans.columns if c != "content"], F.lit(version).alias("version"), now.alias("at"))
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*[c for c in new.columns if c != "key"]))).where("_n = 1").drop("_n")
    return store.update(lambda old: new if old is None else valid(old, now, version, days).join(new.select("key"), "key", "left_anti").unionByName(new, allowMissingColumns=True))


def recalled(store: Store, files: DataFrame, now: Column, version: int, days: int = TTL_DAYS) -> DataFrame | None:
    """The valid entries for files (path, content) as they are now; None from an empty store."""
    held = store.read()
    if held is None:
        return None
    return valid(held, now, version, days).join(files.select(scan_key(F.col("path"), F.col("content")).alias("key")).distinct(), "key", "left_semi")


def not_dismissed(findings: DataFrame, dismissed: DataFrame) -> DataFrame:
    """findings (type, evidence, ...) without those whose (finding_type, evidence_hash) has been dismissed; findings without type or evidence stay."""
    key = F.coalesce(F.concat(F.nullif("type", F.lit("")), F.lit("|"), T.sha16(F.nullif("evidence", F.lit("")))), F.lit(""))
    gone = dismissed.select(F.concat_ws("|", "finding_type", "evidence_hash").alias("_key")).distinct()
    return findings.withColumn("_key", key).join(gone, "_key", "left_anti").drop("_key")


def resolved(entries: DataFrame, id_: str, ids: list[str]) -> DataFrame:
    """entries with `resolved` true for these ids."""
    return entries.withColumn("resolved", F.coalesce(F.col("resolved"), F.lit(False)) | F.coalesce(F.col(id_).isin(ids), F.lit(False)))
