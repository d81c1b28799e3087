"""Lockfile parsers: (ecosystem, name, version, direct, unresolved, manifest) rows from files of five formats."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "requirements.txt"]
SCHEMA = "ecosystem string, name string, version string, direct boolean, unresolved boolean, manifest string"
Row = tuple[str, str, str | None, bool, bool]


def npm(text: str) -> list[Row]:
    """Version 2 and 3 `packages` (links and the root left out), or version 1 nested `dependencies`.

    The name is what follows the last node_modules/, so nested packages keep names that advisories know; direct means
    not nested.
    """
    spec = json.loads(text)
    if isinstance(spec.get("packages"), dict):
        out = []
        for key, p in spec["packages"].items():
            if key and not p.get("link") and "node_modules/" in key:
                out.append(("npm", p.get("name") or key.rpartition("node_modules/")[2], p.get("version"), key.count("node_modules/") == 1, False))
        return out
    out, todo = [], [(spec.get("dependencies") or {}, True)]
    while todo:
        level, direct = todo.pop()
        for name, p in level.items():
            out.append(("npm", name, p.get("version"), direct, False))
            todo.append((p.get("dependencies") or {}, False))
    return out


def yarn(text: str) -> list[Row]:
    """Classic lockfiles; the newer format (which starts with metadata) gives nothing."""
    if re.search(r"^__metadata:", text, re.M):
        return []
    out, name = [], None
    for line in text.splitlines():
        if line and not line[0].isspace() and not line.startswith("#") and line.endswith(":"):
            name = line.rstrip(":").split(",")[0].strip().strip('"').rpartition("@")[0]
        elif name and (m := re.match(r'\s+version "?([^"\s]+)', line)):
            out.append(("npm", name, m[1], True, False))
            name = None
    return out


def pnpm(text: str) -> list[Row]:
    spec = yaml.safe_load(text) or {}
    roots = [spec, *(spec.get("importers") or {}).values()]
    direct = {n for r in roots for k in ("dependencies", "devDependencies", "optionalDependencies") for n in r.get(k) or {}}
    out = []
    for key in spec.get("packages") or {}:
        name, _, version = re.sub(r"\(.*$", "", key).lstrip("/").rpartition("@")
        if not name:  # older files: name/version
            name, _, version = re.sub(r"\(.*$", "", key).lstrip("/").rpartition("/")
        out.append(("npm", name, version, name in direct, False))
    return out


def pipfile(text: str) -> list[Row]:
    spec = json.loads(text)
    return [("pypi", n, (p.get("version") or "").removeprefix("==") or None, True, not p.get("version")) for k in ("default", "develop") for n, p in (spec.get(k) or {}).items()]


def requirements(text: str) -> list[Row]:
    """One requirement a line; comments, options, addresses and markers dropped; only == resolves."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).split(";")[0].strip()
        if not line or line.startswith("-") or "://" in line:
            continue
        if m := re.match(r"([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(.*)$", line):
            pin = re.fullmatch(r"===?\s*([^\s,]+)", m[2].strip())
            out.append(("pypi", re.sub(r"[-_.]+", "-", m[1].lower()), pin[1] if pin else None, True, not pin))
    return out


PARSERS = dict(zip(NAMES, (npm, yarn, pnpm, pipfile, requirements), strict=True))


def packages(files: DataFrame) -> DataFrame:
    """All packages of lockfiles among files (path, text). Files that can't be read, and null texts, give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    rows += [(*r, path) for r in PARSERS[path.rpartition("/")[2]](text or "")]
                except (ValueError, AttributeError, TypeError, yaml.YAMLError):
                    continue
            kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    depth = F.size(F.split("path", "/")) - 1
    wanted = files.where(F.regexp_extract("path", "([^/]+)$", 1).isin(NAMES) & (depth <= 8)).dropDuplicates(["path"])
    return wanted.select("path", "text").mapInArrow(run, SCHEMA)


def deduplicated(found: DataFrame) -> DataFrame:
    """First of each (ecosystem, name, version), by manifest; pypi names in lower case."""
    key = F.struct("ecosystem", F.when(F.col("ecosystem") == "pypi", F.lower("name")).otherwise(F.col("name")).alias("name"), F.coalesce("version", F.lit("unknown")).alias("version"))
    rest = F.min(F.struct("manifest", "direct", "unresolved")).alias("f")
    return found.groupBy(key.alias("k")).agg(rest).select("k.*", "f.direct", "f.unresolved", "f.manifest")


def audited(found: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages with their advisories (source, id, ecosystem, name, version, cvss, epss, kev, exploit, fixed).

    Advisories of one id merge over sources, the highest score first; priority comes from the worst advisory alone.
    """
    from palisade.functions import scoring, text

    merged = advisories.groupBy("ecosystem", "name", "version", "id").agg(F.max("cvss").alias("cvss"), F.max("epss").alias("epss"), F.max("kev").alias("kev"), F.max("exploit").alias("exploit"), F.min_by("fixed", text.version_key(F.col("fixed"))).alias("fixed"), F.collect_set("source").alias("sources"))
    per = merged.groupBy("ecosystem", "name", "version").agg(
        F.max_by(F.struct("id", "cvss", "epss", "kev", "exploit"), F.struct(F.coalesce("cvss", F.lit(0.0)), "id")).alias("worst"),
        F.count("*").alias("advisories"), F.max(F.size("sources")).alias("sources"), F.min_by("fixed", text.version_key(F.col("fixed"))).alias("min_safe"),
    )
    p = scoring.priority(F.col("worst.cvss"), F.col("worst.epss"), F.col("worst.kev"), F.col("worst.exploit"), F.col("direct"))
    return deduplicated(found).join(per, ["ecosystem", "name", "version"]).select("ecosystem", "name", "version", "advisories", "sources", "min_safe", F.col("worst.id").alias("worst"), p.alias("priority"), scoring.priority_label(p).alias("label"))
