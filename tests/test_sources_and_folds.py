import json

from palisade.operators import ordered
from palisade.sources import files, lockfiles
from palisade.streaming import windows

LOCKS = [
    ("a/package-lock.json", json.dumps({"packages": {"": {}, "node_modules/lodash": {"version": "4.17.4"}, "node_modules/a/node_modules/b": {"version": "1.0.0"}, "node_modules/l": {"link": True}}})),
    ("b/package-lock.json", json.dumps({"dependencies": {"axios": {"version": "0.21.0", "dependencies": {"c": {"version": "2.0.0"}}}}})),
    ("c/yarn.lock", '# yarn lockfile v1\n\n"@x/y@^1.0.0", "@x/y@^1.1.0":\n  version "1.2.3"\n  resolved "u"\n\nlodash@^4:\n  version "4.17.4"\n'),
    ("d/pnpm-lock.yaml", "dependencies:\n  foo: 1.0.0\npackages:\n  /foo@1.0.0(peer@2):\n    dev: false\n  bar@3.1.0: {}\n"),
    ("e/Pipfile.lock", json.dumps({"default": {"django": {"version": "==3.2"}}, "develop": {"pytest": {}}})),
    ("f/requirements.txt", "# c\nFlask_Cors==3.0.1 # x\nrequests>=2.0\n-r other.txt\nhttps://x/y.whl\nnumpy ; python_version>'3'\n"),
    ("g/package-lock.json", "not json"), ("h/yarn.lock", None), ("i/readme.md", "x"),
]


def test_lockfiles(spark):
    found = lockfiles.packages(spark.createDataFrame(LOCKS, "path string, text string"))
    got = {(r.name, r.version, r.direct, r.unresolved) for r in found.collect()}
    assert got == {
        ("lodash", "4.17.4", True, False), ("b", "1.0.0", False, False), ("axios", "0.21.0", True, False), ("c", "2.0.0", False, False), ("@x/y", "1.2.3", True, False), ("foo", "1.0.0", True, False),
        ("bar", "3.1.0", False, False), ("django", "3.2", True, False), ("pytest", None, True, True), ("flask-cors", "3.0.1", True, False), ("requests", None, True, True), ("numpy", None, True, True),
    }
    adv = [("OSV", "G1", "npm", "lodash", "4.17.4", 7.2, None, False, False, "4.17.21"), ("GHSA", "G1", "npm", "lodash", "4.17.4", 7.2, None, False, False, "4.17.21"), ("OSV", "G2", "npm", "lodash", "4.17.4", 5.0, 90.0, True, True, "4.17.9")]
    r = lockfiles.audited(found, spark.createDataFrame(adv, "source string, id string, ecosystem string, name string, version string, cvss double, epss double, kev boolean, exploit boolean, fixed string")).collect()
    assert [(x.name, x.advisories, x.sources, x.min_safe, x.worst, x.priority, x.label) for x in r] == [("lodash", 2, 2, "4.17.9", "G1", 34, "medium")]


def test_read_admission_and_merge(spark):
    assert ordered.merged([[1, 5], [9, 12]], 6, 7) == [[1, 7], [9, 12]]
    rows = [("r", "f", 1, 1, 10), ("r", "f", 2, 1, 10), ("r", "f", 3, 5, 12), ("r", "f", 4, 11, 20), ("r", "g", 5, 1, 3)]
    got = [(r.seq, r.admitted, r.covered) for r in ordered.read_admission(spark.createDataFrame(rows, "run string, file string, seq long, start_line long, end_line long")).orderBy("seq").collect()]
    assert got == [(1, True, 10), (2, False, 10), (3, False, 10), (4, True, 20), (5, True, 3)]


def test_greedy_matches(spark):
    schema = "file string, id long, line long, type string"
    got = ordered.greedy_matches(spark.createDataFrame([("f", 1, 10, "x"), ("f", 2, 12, "x"), ("f", 3, 90, "x")], schema), spark.createDataFrame([("f", 7, 11, "x"), ("f", 8, 15, "y")], schema)).collect()
    assert sorted((r.found, r.expected, r.score) for r in got) == [(1, 7, 19), (2, 8, 7)]


def test_capped_blast(spark):
    edges = spark.createDataFrame([("utils", "auth"), ("auth", "handler"), ("handler", "routes"), ("routes", "app")], "src string, dst string")
    assert ordered.capped_blast(spark, edges, ["utils"]) == ([("utils", 0), ("auth", 1), ("handler", 2), ("routes", 3)], 3, False)
    assert ordered.capped_blast(spark, edges, ["utils"], most=2)[1:] == (2, True)


def test_budget(spark):
    rows = [("r", "a", 0, 40_000), ("r", "b", 1, 20_000), ("r", "c", 2, 10)]
    assert [(r.path, r.taken) for r in ordered.budgeted(spark.createDataFrame(rows, "run string, path string, rank int, bytes long")).collect()] == [("a", 40_000), ("b", 9152)]


def test_logs_and_workspace(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.ts").write_text("eval(x)")
    (tmp_path / "src/b.md").write_text("x")
    (tmp_path / "src/node_modules/c.js").write_text("eval(x)")
    (tmp_path / "src/d.py").write_text("")
    got = {r.path.rpartition("/")[2]: (r.lang, r.text, r.skip_reason) for r in files.workspace(spark, str(tmp_path / "src")).collect()}
    assert got == {"a.ts": ("typescript", "eval(x)", None)}  # Spark's file source leaves empty files out
    (tmp_path / "log.jsonl").write_text('{"timestamp": "1", "x": 1}\nbroken\n\n{"timestamp": "2", "x": 2}\n')
    assert [r.x for r in files.json_lines_tail(spark, str(tmp_path / "log.jsonl"), "timestamp string, x int", 5).collect()] == [2, 1]
    assert files.json_lines_tail(spark, str(tmp_path / "log.jsonl"), "timestamp string, x int", 5, strict=True).count() == 0
    log = spark.createDataFrame([("h|2024-01-02T03:04|A <a@b.com>|fix | it",), ("bad",)], "value string")
    assert [tuple(r) for r in files.git_log(log).collect()] == [("h", "2024-01-02", "A <redacted>", "fix | it")]


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    out = windows.tumbling(windows.events(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(90)
    assert spark.table("tumbling").agg({"n": "sum"}).first()[0] == src.count()
    rows = [("h", "p", 1, "t", "e", "2024-01-01", "rejected"), ("h", "p", 2, "t", "e", "2024-01-01", None)]
    schema = "file_hash string, path string, line int, finding_type string, evidence_hash string, updated_at string, decision string"
    queue, new = spark.createDataFrame(rows, schema), spark.createDataFrame([("h", "p", 1, "t", "e", "2024-02-01")], schema.replace(", decision string", ""))
    assert sorted((r.line, r.updated_at, r.decision) for r in windows.upserted(queue, new).collect()) == [(1, "2024-02-01", None), (2, "2024-01-01", None)]
    assert windows.upserted(queue, new.limit(0), cap=1).first().line == 2


def test_a_broken_pnpm_file_gives_no_packages_and_no_error(spark):
    rows = [("a/pnpm-lock.yaml", "packages: [unclosed"), ("b/pnpm-lock.yaml", "packages:\n  /x@1.0.0: {}\n"), ("c/package-lock.json", "{")]
    got = lockfiles.packages(spark.createDataFrame(rows, "path string, text string")).collect()
    assert [(r.name, r.version) for r in got] == [("x", "1.0.0")]


def test_the_least_fixed_version_is_by_numbers(spark):
    found = spark.createDataFrame([("npm", "x", "1.0.0", True, False, "m")], "ecosystem string, name string, version string, direct boolean, unresolved boolean, manifest string")
    kind = "source string, id string, ecosystem string, name string, version string, cvss double, epss double, kev boolean, exploit boolean, fixed string"
    advisories = spark.createDataFrame([("a", "i", "npm", "x", "1.0.0", 5.0, 0.0, False, False, "10.0.0"), ("b", "i", "npm", "x", "1.0.0", 5.0, 0.0, False, False, "9.0.0")], kind)
    assert lockfiles.audited(found, advisories).first().min_safe == "9.0.0"


def test_workspace_leaves_out_ignored_and_secret_files(spark, tmp_path):
    for name, body in {"a.ts": "x", "gen/b.ts": "y", "keep/c[1].ts": "z", "big.py": "q" * 3000, "node_modules/d.ts": "w"}.items():
        (tmp_path / "w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / name).write_text(body)
    got = {r.path.rpartition("/")[2]: (r.text, r.skip_reason) for r in files.workspace(spark, str(tmp_path / "w"), largest=2000, ignore=["gen/"]).collect()}
    assert got == {"a.ts": ("x", None), "c[1].ts": ("z", None), "big.py": (None, "too_large")}
