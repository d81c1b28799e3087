"""Gates, verdicts and policies over recorded outcomes, as column expressions: the first reason that applies wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.scoring import first_reason

#: Hosts that count as local.
LOCAL_HOSTS = ["127.0.0.1", "localhost", "::1", "0:0:0:0:0:0:0:1"]
#: Runners of tests, and what their arguments may not hold.
RUNNERS = ["npm", "pnpm", "yarn", "bun", "pytest"]
SHELL_OPERATORS = ["&&", "||", ";", "|", ">", "<", "$(", "`", ">&", "<&"]
BLOCKED_FLAGS = ["--shell", "--script-shell", "--foreground-scripts", "--no-shell", "-S", "--bash", "--sh", "--cmd", "--exec", "--host"]
#: Modules that a test script may not load.
BLOCKED_MODULES = "child_process net http https http2 dgram dns dns/promises tls fs fs/promises os vm worker_threads cluster repl process inspector perf_hooks".split()
#: Calls and names that a test script may not use, in order of reporting.
BLOCKED_CODE = [
    ("(^|[^A-Za-z0-9_$])eval\\s*\\(", "eval"),
    ("(^|[^A-Za-z0-9_$])new\\s+(Async|Generator)?Function\\s*\\(", "function constructor"),
    ("(^|[^A-Za-z0-9_$])(setTimeout|setInterval|setImmediate)\\s*\\(\\s*['\"`]", "timer with a string"),
    ("(^|[^A-Za-z0-9_$])process[.](env|argv|execPath)([^A-Za-z0-9_$]|$)", "process access"),
    ("(^|[^A-Za-z0-9_$])process[.](cwd|getuid|getgid)\\s*\\(", "process access"),
    ("(^|[^A-Za-z0-9_$])fetch\\s*\\(", "network"),
    ("(^|[^A-Za-z0-9_$])navigator([^A-Za-z0-9_$]|$)", "navigator"),
    ("(^|[^A-Za-z0-9_$])import\\s*\\(\\s*[^\"'\\s`]", "dynamic import"),
    ("(^|[^A-Za-z0-9_$])require\\s*\\(\\s*[^\"'\\s`)]", "dynamic require"),
]


def proof_marker(output: Column, start: str, end: str) -> Column:
    """The JSON between the first pair of sentinels as a struct; null where there is none or it can't be read."""
    s = F.instr(output, start)
    rest = F.substring(output, s + len(start), F.length(output))
    body = F.when((s > 0) & (F.instr(rest, end) > 0), F.trim(F.substring_index(rest, end, 1)))
    kind = "baseline string, exploit string, impact string, targetReached boolean, assertion string, mockedVulnerablePath boolean, sourceMode string"
    return F.when(body.startswith("{") & body.endswith("}"), F.from_json(body, kind))


def proof_gates(found: Column, marker: dict[str, Column], runs: Column, passes: Column, least_runs: int = 3) -> Column:
    """Names of the gates that a proof fails, in order. Without a marker that is all there is to say.

    Three-valued on purpose: target and mock count only when said to be false and true; baseline, exploit, impact and
    assertion fail unless they say what they must.
    """
    said = lambda c, v: F.coalesce(c == v, F.lit(False))
    gates = [
        ("synthetic-source", said(marker["sourceMode"], "synthetic")),
        ("extracted-logic-source", said(marker["sourceMode"], "extracted-logic")),
        ("mock-vulnerable-path", said(marker["mockedVulnerablePath"], True)),
        ("target-not-reached", said(marker["targetReached"], False)),
        ("baseline-failed", ~said(marker["baseline"], "pass")),
        ("exploit-failed", ~said(marker["exploit"], "pass")),
        ("impact-not-observed", ~said(marker["impact"], "observed")),
        ("non-deterministic-assertion", ~said(marker["assertion"], "deterministic")),
        ("insufficient-repeats", runs < least_runs),
        ("flaky-proof", passes < runs),
    ]
    failed = F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in gates]), lambda x: x.isNotNull())
    return F.when(F.coalesce(found, F.lit(False)), failed).otherwise(F.array(F.lit("proof-marker-missing")))


def proof_verdict(failed: Column) -> Column:
    missed = F.array_contains(failed, "exploit-failed") | F.array_contains(failed, "impact-not-observed")
    return F.when(F.size(failed) == 0, "PROVEN").when(missed, "UNPROVEN").otherwise("INCONCLUSIVE")


def closure(original: Column, fixed: Column) -> Column:
    """Whether a fix closes a finding: only a proven one that no longer reproduces is closed."""
    return F.when((original == "PROVEN") & (fixed == "UNPROVEN"), "closed").when((original == "PROVEN") & (fixed == "PROVEN"), "still-vulnerable").otherwise("inconclusive")


def run_verdict(output: Column, timed_out: Column) -> Column:
    return F.when(timed_out, "timeout").when(output.rlike("(?m)^PASS:\\s*.+$"), "pass").when(output.rlike("(?m)^FAIL:\\s*.+$"), "fail").otherwise("error")


def exit_verdict(code: Column, timed_out: Column) -> Column:
    return F.when(timed_out, "timeout").when(code == 0, "pass").otherwise("fail")


def needs_review(proven: Column, verdict: Column, severity: Column, confidence: Column) -> Column:
    dropped = proven.isin("PROVEN", "NOT_REPRODUCIBLE") | F.coalesce(verdict.isin("cancelled", "aborted"), F.lit(False))
    return F.when(dropped, False).when(proven == "INCONCLUSIVE", True).when(proven == "SKIPPED", severity.isin("critical", "high", "medium")).otherwise((proven == "UNPROVEN") & (confidence >= 60))


def review_reason(verdict: Column) -> Column:
    #: Fixed values.
    named = {"sandbox-unavailable": "sandbox-unavailable", "budget-exhausted": "verification-budget-exhausted", "runtime-blocked": "runtime-blocked", "cannot-test": "test-generation-failed", "blocked": "runtime-blocked"}
    return F.coalesce(*[F.when(verdict == k, F.lit(v)) for k, v in named.items()], F.lit("inconclusive-verification"))


def spliced(code: Column, fixed: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """(code with lines first..last replaced, error): lines from 1, both inclusive; an empty fix removes them."""
    lines = F.split(code, "\n")
    error = first_reason([(first.isNull() | last.isNull(), "lines must be integers"), (first < 1, "start_line must be at least 1"), (last < first, "end_line before start_line"), (last > F.size(lines), "end_line past the end")])
    new = F.when(F.length(fixed) > 0, F.split(fixed, "\n")).otherwise(F.array().cast("array<string>"))
    head, tail = F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0))), F.slice(lines, F.greatest(last + 1, F.lit(1)), F.greatest(F.size(lines) - last, F.lit(0)))
    return F.when(error.isNull(), F.array_join(F.concat(head, new, tail), "\n")), error


def ref_ok(ref: Column) -> Column:
    return F.coalesce(ref.rlike("^[a-zA-Z0-9._~^/-]{1,100}$") & ~ref.contains(".."), F.lit(False))


def target_error(host: Column, port: Column, path: Column) -> Column:
    """Why a probe target isn't allowed; null: it is."""
    return first_reason([
        (~F.coalesce(F.lower(host).isin(LOCAL_HOSTS), F.lit(False)), "host"), (F.coalesce((port < 1) | (port > 65535), F.lit(True)), "port"),
        (~F.coalesce(path.startswith("/"), F.lit(False)), "path"), (path.contains(".."), "traversal"),
    ])


def leaves_localhost(status: Column, location: Column) -> Column:
    """Whether a recorded redirect goes to another host."""
    host = F.lower(F.regexp_replace(F.regexp_extract(location, "^(?:https?:)?//(?:[^/@]*@)?(\\[[^\\]]*\\]|[^/:?#]*)", 1), "[\\[\\]]", ""))
    return F.coalesce((status >= 300) & (status < 400) & location.rlike("^(https?:)?//") & ~host.isin(LOCAL_HOSTS), F.lit(False))


def command_error(runner: Column, files: Column, pattern: Column, flags: Column) -> Column:
    """Why a recorded test command isn't allowed; null: it is. files and flags: arrays."""
    shell = lambda s: F.exists(F.array(*[F.lit(o) for o in SHELL_OPERATORS]), lambda o: F.coalesce(F.contains(s, o), F.lit(False)))
    outside = lambda f: f.startswith("/") | f.contains("..") | f.startswith("~") | (f == "") | f.rlike("^[A-Za-z]:")
    none = F.array().cast("array<string>")
    return first_reason([
        (~F.coalesce(F.lower(runner).isin(RUNNERS), F.lit(False)), "unsupported runner"), (F.size(F.coalesce(files, none)) > 50, "too many files"), (F.length(pattern) > 200, "pattern too long"),
        (shell(pattern), "shell operator"), (F.exists(F.coalesce(files, none), shell), "shell operator"), (F.exists(F.coalesce(files, none), outside), "path outside the workspace"),
        (F.exists(F.coalesce(flags, none), lambda f: f.isin(BLOCKED_FLAGS)), "blocked flag"),
    ])


def command_timeout(ms: Column) -> Column:
    return F.when(F.coalesce(ms <= 0, F.lit(True)), 60_000).otherwise(F.least(F.floor(ms), F.lit(300_000))).cast("int")


def script_error(script: Column) -> Column:
    """Why a test script isn't safe to run; null: nothing found. A static check of its text."""
    named = "|".join(m.replace("/", "[/]") for m in sorted(BLOCKED_MODULES, key=len, reverse=True))
    load = f"(from|import|require\\s*\\()\\s*['\"`](node:)?({named})['\"`]"
    return first_reason([*((script.rlike(p), why) for p, why in BLOCKED_CODE), (script.rlike(load), "blocked module")])
