"""Versioned stores, recorded version control, and runtimes by the nearest folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palisade.operators import runtime
from palisade.sources import history
from palisade.sources.store import Conflict, Store, not_dismissed, recalled, remembered, resolved


def test_versions_are_published_once(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    assert a.read() is None and a.versions() == []
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    first, second = a.write(one), b.write(two)  # both from an empty store
    assert a.publish(first, 0) == 1
    with pytest.raises(Conflict):
        b.publish(second, 0)
    assert [r.x for r in b.read().collect()] == [1]
    assert b.update(lambda old: old.union(two)) == 2 and sorted(r.x for r in a.read().collect()) == [1, 2]
    assert [r.x for r in a.read(1).collect()] == [1] and a.read(9) is None
    tried = []

    def slow(old):  # another writer comes between reading and publishing
        tried.append(old.count())
        if len(tried) == 1:
            a.update(lambda o: o.union(spark.createDataFrame([(3,)], "x int")))
        return old.union(spark.createDataFrame([(4,)], "x int"))

    assert b.update(slow) == 4 and tried == [2, 3] and sorted(r.x for r in a.read().collect()) == [1, 2, 3, 4]


def test_a_crash_before_the_manifest_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.update(lambda _: spark.createDataFrame([(1,)], "x int"))
    lost = store.write(spark.createDataFrame([(9,)], "x int"))  # and no publish
    assert [r.x for r in store.read().collect()] == [1] and store.versions() == [1]
    for k in range(3):
        store.update(lambda old, k=k: old.union(spark.createDataFrame([(10 + k,)], "x int")))
    gone = store.vacuum(keep=2)
    assert lost.rpartition("/")[2] in gone and store.versions() == [3, 4] and store.read().count() == 4 and store.read(3).count() == 3
    assert Store(spark, str(tmp_path / "s"), form=2).read() is None


def test_scans_are_remembered_by_content(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"))
    day = lambda n: F.lit(dt.datetime(2024, 1, n))
    scans = lambda *rows: spark.createDataFrame(rows, "path string, content string, status string")
    files = spark.createDataFrame([("a.ts", "x"), ("b.ts", "y"), ("c.ts", None)], "path string, content string")
    assert recalled(store, files, day(1), 3) is None
    remembered(store, scans(("a.ts", "x", "done"), ("b.ts", "old", "done"), ("a.ts", "x", "done")), day(1), 3)
    remembered(store, scans(("a.ts", "x", "again"), ("b.ts", "y", "done")), day(3), 3)
    got = lambda n, v=3: sorted((r.path, r.status) for r in recalled(store, files, day(n), v).collect())
    assert got(4) == [("a.ts", "again"), ("b.ts", "done")] and got(10) == got(4) and got(11) == [] and got(4, 4) == []
    remembered(store, scans(("z.ts", "z", "done")), day(12), 3)
    assert sorted(r.path for r in store.read().collect()) == ["z.ts"]


def test_dismissed_findings_and_resolved_entries(spark):
    import hashlib

    h = hashlib.sha256(b"e1").hexdigest()[:16]
    found = spark.createDataFrame([("xss", "e1"), ("xss", "e2"), ("sql", "e1"), (None, "e1"), ("xss", None), ("xss", "")], "type string, evidence string")
    gone = spark.createDataFrame([("xss", h), ("xss", h)], "finding_type string, evidence_hash string")
    assert sorted(map(str, ((r.type, r.evidence) for r in not_dismissed(found, gone).collect()))) == sorted(map(str, [("xss", "e2"), ("sql", "e1"), (None, "e1"), ("xss", None), ("xss", "")]))
    entries = spark.createDataFrame([("a", False), ("b", None), (None, True)], "id string, resolved boolean")
    assert {(r.id, r.resolved) for r in resolved(entries, "id", ["b"]).collect()} == {("a", False), ("b", True), (None, True)}


def porcelain(lines):
    out, seen = [], set()
    for n, (sha, who, text) in enumerate(lines, 1):
        out.append(f"{sha} {n} {n} 1")
        if sha not in seen:
            seen.add(sha)
            out += [f"author {who}", f"author-mail <{who}@x.org>", "author-time 1", "committer C", "committer-time 1700000000", f"summary fix by {who}", "filename f.py"]
        out.append("\t" + text)
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("split", [None, 4096])
def test_blame_records(spark, tmp_path, split):
    lines = [("ab" * 20, "Ann", "x = 1"), ("cd" * 20, "Bob", ""), ("ab" * 20, "Ann", "\ttabbed"), ("ef" * 20, "Cy", "cd" * 20 + " 7 7"), ("ab" * 20, "Ann", "author me"), ("cd" * 20, "Bob", "last")]
    if split:
        lines = lines * 400
    (tmp_path / "b.txt").write_text(porcelain(lines))
    (tmp_path / "one.txt").write_text(porcelain(lines[:1]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        rows = history.blame(spark, [str(tmp_path / "b.txt"), str(tmp_path / "one.txt")])
        assert not split or rows.sparkSession.read.option("lineSep", "\n\t").text(str(tmp_path / "b.txt")).rdd.getNumPartitions() > 5
        got = {(r.file.rpartition("/")[2], r.line): r for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(lines) + 1 and [got["b.txt", n].text for n in range(1, len(lines) + 1)] == [t for *_, t in lines]
    assert [got["b.txt", n].hash for n in range(1, 7)] == [s[:8] for s, *_ in lines[:6]]
    assert (got["b.txt", 1].author, got["b.txt", 1].date, got["b.txt", 1].summary) == ("Ann <redacted>", "2023-11-14", "fix by Ann") and got["b.txt", 3].author == ""
    filled = history.blame(spark, str(tmp_path / "b.txt"), fill=True).where("line = 3").first()
    assert filled.author == "Ann <redacted>" and got["one.txt", 1].text == "x = 1"


def test_changed_files(spark):
    df = spark.createDataFrame([(1, "a.ts\nb\\c.ts\n\n d.ts\n"), (2, ""), (3, "\n".join(f"f{k}" for k in range(7)))], "id int, text string")
    got = sorted((r.id, r.file, r.truncated) for r in history.changed_files(df, most=5).collect())
    assert got == [(1, "a.ts", False), (1, "b/c.ts", False)] + [(3, f"f{k}", True) for k in range(5)]


def test_runtimes(spark):
    files = [
        ("package.json", '{"dependencies": {"express": "^4.1"}, "packageManager": "pnpm@8"}'), ("web/package.json", '{"devDependencies": {"next": "14.0", "react": "18"}}'), ("web/yarn.lock", ""), ("web/x/y/package.json", "broken"), ("edge/deno.json", "{}"),
        ("bunny/package.json", '{"engines": {"bun": ">=1"}, "dependencies": {"react-native": "0.7"}}'), ("api/requirements.txt", "uvicorn\nFastAPI>=0.100\n"), ("api/v1/uv.lock", ""), ("lib/pyproject.toml", "django"), ("a/package.json", None),
    ]
    asked = ["src/a.ts", "web/pages/i.tsx", "web/x/y/z.js", "edge/m.ts", "bunny/r.tsx", "api/v1/main.py", "lib/m.pyx", "m.py", "a/b.js", "src/a.ts"]
    got = {r.path: (r.runtime, r.package_manager, r.framework, r.framework_version, r.tier) for r in runtime.detect(spark.createDataFrame([(p,) for p in asked], "path string"), spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {
        "src/a.ts": ("node", "pnpm", "express", "^4.1", 1), "web/pages/i.tsx": ("node", "yarn", "next", "14.0", 2), "web/x/y/z.js": ("node", "yarn", None, None, 1), "edge/m.ts": ("deno", "pnpm", "express", "^4.1", 1), "bunny/r.tsx": ("bun", "npm", "react-native", "0.7", 4),
        "api/v1/main.py": ("python", "uv", "fastapi", "0.100", 1), "lib/m.pyx": ("python", "pip", "django", None, 1), "m.py": ("python", None, None, None, 1), "a/b.js": ("node", "npm", None, None, 1),
    }
