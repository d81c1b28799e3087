"""Advisories from recorded responses of three kinds of sources, as one table; no service is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OSV = """results array<struct<vulns: array<struct<id: string, summary: string, severity: array<struct<type: string, score: string>>, references: array<struct<url: string>>,
 affected: array<struct<package: struct<ecosystem: string>, ranges: array<struct<events: array<struct<introduced: string, fixed: string>>>>>>>>>>"""
_GHSA = """array<struct<ghsa_id: string, cve_id: string, summary: string, cvss: struct<score: double>, cvss_score: double, references: array<struct<url: string>>,
 vulnerabilities: array<struct<package: struct<name: string>, vulnerable_version_range: string, patched_version_range: string>>>>"""
_METRIC = "array<struct<cvssData: struct<baseScore: double>>>"
_NVD = f"vulnerabilities array<struct<cve: struct<metrics: struct<cvssMetricV31: {_METRIC}, cvssMetricV30: {_METRIC}, cvssMetricV2: {_METRIC}>, references: array<struct<url: string>>>>>"
COLUMNS = ["source", "id", "ecosystem", "name", "version", "summary", "cvss", "introduced", "fixed", "references"]


def _last(events: Column, name: str) -> Column:
    some = F.filter(F.transform(events, lambda e: e[name]), lambda v: v.isNotNull())
    return F.when(F.size(some) > 0, F.element_at(some, -1))


def from_batches(batches: DataFrame) -> DataFrame:
    """COLUMNS of batch responses: batches (packages: array of (ecosystem, name, version), response: JSON).

    Results belong to packages by position; a batch with another number of results, or none that can be read, is left out
    whole. A vulnerability has a row for each range (one without ranges has one, without versions); introduced and fixed
    are the last of the range's events. Only plain numbers count as scores.
    """
    read = batches.select("packages", F.from_json("response", _OSV).alias("r")).where(F.size("r.results") == F.size("packages"))
    each = read.select(F.explode(F.arrays_zip("packages", F.col("r.results").alias("results"))).alias("z")).select("z.packages.*", F.explode("z.results.vulns").alias("v"))
    ranges = F.flatten(F.transform(F.coalesce("v.affected", F.array()), lambda a: F.coalesce(a["ranges"], F.array())))
    each = each.withColumn("range", F.explode_outer(ranges))
    plain = F.filter(F.col("v.severity"), lambda s: (s["type"] == "CVSS_V3") & (F.length(F.trim(s["score"])) <= 5) & s["score"].try_cast("double").isNotNull())
    score = F.when(F.size(plain) > 0, F.element_at(plain, -1)["score"].try_cast("double"))
    refs = F.filter(F.transform(F.coalesce("v.references", F.array()), lambda r: r["url"]), lambda u: u.isNotNull())
    return each.select(F.lit("osv").alias("source"), "v.id", "ecosystem", "name", "version", F.coalesce("v.summary", F.lit("")).alias("summary"), score.alias("cvss"), _last(F.col("range.events"), "introduced").alias("introduced"), _last(F.col("range.events"), "fixed").alias("fixed"), refs.alias("references"))


def first_version(text: Column) -> Column:
    """The version after the first > or >= of a range; null where there is none."""
    v = F.regexp_extract(text, ">=?\\s*([0-9][0-9a-zA-Z.+-]*)", 1)
    return F.when(v != "", v)


def from_listings(listings: DataFrame) -> DataFrame:
    """COLUMNS of listings per package: listings (ecosystem, name, version, response: JSON array of advisories).

    An advisory counts if one of its packages has the name, in any case; it has a row for each of its ranges.
    """
    a = listings.select("ecosystem", "name", "version", F.explode(F.from_json("response", _GHSA)).alias("a"))
    mine = F.exists(F.col("a.vulnerabilities"), lambda v: F.lower(v["package"]["name"]) == F.lower("name"))
    a = a.where(F.coalesce(mine, F.lit(False))).withColumn("v", F.explode("a.vulnerabilities"))
    refs = F.filter(F.transform(F.coalesce("a.references", F.array()), lambda r: r["url"]), lambda u: u.isNotNull())
    refs = F.concat(refs, F.when(F.coalesce("a.cve_id", F.lit("")) != "", F.array(F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), "a.cve_id"))).otherwise(F.array().cast("array<string>")))
    return a.select(F.lit("ghsa").alias("source"), F.col("a.ghsa_id").alias("id"), "ecosystem", "name", "version", F.coalesce("a.summary", F.lit("")).alias("summary"), F.coalesce("a.cvss.score", "a.cvss_score").alias("cvss"), first_version(F.col("v.vulnerable_version_range")).alias("introduced"), first_version(F.col("v.patched_version_range")).alias("fixed"), refs.alias("references"))


def scored(advisories: DataFrame, lookups: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Advisories whose missing scores come from recorded look-ups (id, fetched: timestamp, response: JSON) no older than `hours` at `now`.

    The score is that of metric 3.1, else 3.0, else 2; only CVE ids are looked up. Where an advisory has no reference, it
    gets the look-up's first. Of several look-ups of an id the latest counts.
    """
    latest = lookups.where(F.col("fetched") > F.to_timestamp(F.lit(now)) - F.make_interval(hours=F.lit(hours))).groupBy("id").agg(F.max_by("response", "fetched").alias("response"))
    cve = F.from_json("response", _NVD)["vulnerabilities"][0]["cve"]
    metric = F.coalesce(*[cve["metrics"][m][0]["cvssData"]["baseScore"] for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])
    known = latest.select(F.upper("id").alias("_id"), metric.alias("_score"), cve["references"][0]["url"].alias("_url"))
    out = advisories.join(known, (F.upper("id") == F.col("_id")) & F.col("cvss").isNull() & F.col("id").rlike("(?i)^CVE-[0-9]{4}-[0-9]+$"), "left")
    refs = F.when(F.col("_score").isNotNull() & F.col("_url").isNotNull() & (F.coalesce(F.size("references"), F.lit(0)) == 0), F.array("_url")).otherwise(F.col("references"))
    return out.withColumn("references", refs).withColumn("cvss", F.coalesce("cvss", "_score")).drop("_id", "_score", "_url")
