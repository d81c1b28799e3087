"""Recorded advisory responses, and reports over findings."""

import json

from pyspark.sql import functions as F

from palisade.operators import reports
from palisade.sources import advisories


def test_batches_by_position(spark):
    two = [{"vulns": [{"id": "A-1", "summary": "s", "severity": [{"type": "CVSS_V3", "score": "7.5"}], "references": [{"url": "u"}, {}], "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.2"}]}, {"events": [{"introduced": "2.0"}]}]}]}]}, None]
    vector = [{"vulns": [{"id": "CVE-2024-1", "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N"}]}]}]
    packages = "array<struct<ecosystem: string, name: string, version: string>>"
    rows = [([("npm", "a", "1"), ("npm", "b", "2")], json.dumps({"results": two})), ([("npm", "c", "1")], json.dumps({"results": two})), ([("npm", "d", "1")], "broken"), ([("npm", "e", "1")], json.dumps({"results": vector})), ([("npm", "f", "1")], None)]
    df = advisories.from_batches(spark.createDataFrame(rows, f"packages {packages}, response string"))
    assert df.columns == advisories.COLUMNS
    got = sorted((r.id, r.name, r.cvss, r.introduced, r.fixed, r.references) for r in df.collect())
    assert got == [("A-1", "a", 7.5, "0", "1.2", ["u"]), ("A-1", "a", 7.5, "2.0", None, ["u"]), ("CVE-2024-1", "e", None, None, None, [])]
    nvd = lambda m, s: json.dumps({"vulnerabilities": [{"cve": {"metrics": {m: [{"cvssData": {"baseScore": s}}]}, "references": [{"url": "n"}]}}]})
    looks = [("CVE-2024-1", "2024-05-02 00:00:00", nvd("cvssMetricV30", 6.1)), ("CVE-2024-1", "2024-05-01 12:00:00", nvd("cvssMetricV2", 1.0)), ("A-1", "2024-05-02 00:00:00", nvd("cvssMetricV31", 9.9))]
    look = spark.createDataFrame(looks, "id string, fetched string, response string").withColumn("fetched", F.to_timestamp("fetched"))
    assert {(r.id, r.cvss, tuple(r.references)) for r in advisories.scored(df, look, "2024-05-02 01:00:00").collect()} == {("A-1", 7.5, ("u",)), ("CVE-2024-1", 6.1, ("n",))}
    assert {r.cvss for r in advisories.scored(df, look, "2024-05-04 00:00:00").collect()} == {7.5, None}


def test_listings_by_name(spark):
    listing = [{"ghsa_id": "G-1", "cve_id": "CVE-2020-5", "cvss": {"score": 7.2}, "vulnerabilities": [{"package": {"name": "Lodash"}, "vulnerable_version_range": ">= 4.0, < 4.17.21", "patched_version_range": ">= 4.17.21"}]}, {"ghsa_id": "G-2", "vulnerabilities": [{"package": {"name": "other"}}]}]
    df = spark.createDataFrame([("npm", "lodash", "4.17.4", json.dumps(listing)), ("npm", "x", "1", "nope")], "ecosystem string, name string, version string, response string")
    assert [(r.id, r.cvss, r.introduced, r.fixed, r.references) for r in advisories.from_listings(df).collect()] == [("G-1", 7.2, "4.0", "4.17.21", ["https://nvd.nist.gov/vuln/detail/CVE-2020-5"])]


def test_middleware_confidences(spark):
    df = spark.createDataFrame([([("a.ts", 1.0), ("?", 0.9), ("b.ts", 0.15)],)], "m array<struct<source_file: string, confidence: double>>")
    lost = df.select(reports.marked_unresolved(F.col("m")).alias("m"))
    assert [tuple(x) for x in lost.first().m] == [("a.ts", 1.0), ("", 0.2), ("b.ts", 0.15)]
    assert [x.confidence for x in lost.select(reports.runtime_confirmed(F.col("m")).alias("m")).first().m] == [1.0, 0.8, 0.8]
