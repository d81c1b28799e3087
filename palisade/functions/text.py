"""String, hash and redaction scalars. Patterns of findings avoid word boundaries and look-around: engines differ on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"

#: Fixed values: (rule, type, severity, pattern), in order of reporting.
SECRET_RULES = [
    (1, "private_key", "Critical", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    (2, "aws_access_key", "Critical", "AKIA[0-9A-Z]{16}"),
    (3, "github_token", "Critical", "ghp_[A-Za-z0-9]{36}"),
    (4, "api_key", "Critical", "sk-[A-Za-z0-9]{20,}"),
    (5, "slack_token", "High", "xox[a-z]-[A-Za-z0-9-]+"),
    (6, "jwt", "High", "eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+"),
    (7, "database_url", "Critical", "(postgres|postgresql|mysql|mongodb|redis)://[^ ]+:[^ ]+@[^ ]+"),
    (8, "credential", "High", "(?i)(password|passwd|secret|token|api_key) *[=:] *[\"'][^\"']{8,}[\"']"),
    (9, "email", "Medium", EMAIL),
    (10, "credit_card", "High", "(^|[^0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}([^0-9]|$)"),
    (11, "phone", "Low", "[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"),
    (12, "ip_address", "Low", "(^|[^0-9.])[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}([^0-9.]|$)"),
]

#: By rule, texts of which a line that it matches holds one (any case where the last item is "i").
SECRET_NEEDS = {
    1: ["-----BEGIN "], 2: ["AKIA"], 3: ["ghp_"], 4: ["sk-"], 5: ["xox"], 6: ["eyJ"], 7: ["://"], 8: ["password", "passwd", "secret", "token", "api_key", "i"],
    9: ["@"], 10: ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9"], 11: ["+1 ("], 12: ["."],
}
CARD = "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"

#: An ASCII word boundary (the engine's own one counts letters of other scripts).
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

#: Redactions of report text, in this order; {edge} stands for a word boundary.
REDACT_A = [
    ("(?i)Bearer\\s+[A-Za-z0-9._-]+", "Bearer [REDACTED]"),
    ("eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", "[JWT_REDACTED]"),
    ("[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}", "[EMAIL_REDACTED]"),
    ("{edge}(?:[A-Za-z0-9]{64}|[A-Za-z0-9]{40}|[A-Za-z0-9]{32}){edge}", "[REDACTED]"),
]

#: Redactions of version-control output, in this order.
REDACT_B = [
    ("<[^>]+@[^>]+>", "<redacted>"),
    ("{edge}[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+{edge}", "redacted@email"),
    ("(?i)sk-[A-Za-z0-9_]{20,}", "sk-REDACTED"),
    ("AKIA[A-Za-z0-9_]{16}", "AKIA-REDACTED"),
    ("ghp_[A-Za-z0-9_]{36}", "ghp-REDACTED"),
    ("xox[baprs]-[A-Za-z0-9_-]+", "xox-REDACTED"),
]


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern.replace("{edge}", _EDGE), to)
    return text


def replaced_sql(text: str, rules: list[tuple[str, str]]) -> str:
    """The same for DuckDB, whose word boundary is that of ASCII."""
    for pattern, to in rules:
        text = f"regexp_replace({text}, '{pattern.replace('{edge}', chr(92) + 'b').replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return text


def sha16(text: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def truncated(text: Column, n: int, marker: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def normal_type(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[ \\t\\n\\r-]+", "_")


def env_redacted(line: Column) -> Column:
    """A line of an environment file without its value: what stands before the first = is the key, whatever its signs.

    Secret-like keys get REDACTED, others `set`; comments, blank lines and lines without = stay as they are.
    """
    key = F.regexp_replace(F.substring_index(line, "=", 1), "^\\s+|\\s+$", "")
    secret = key.rlike("(?i)SECRET|KEY|TOKEN|PASSWORD|PRIVATE|CREDENTIAL")
    return F.when(line.rlike("^\\s*(#|$)") | ~line.contains("="), line).otherwise(F.concat(key, F.when(secret, "=REDACTED").otherwise("=set")))


def headers_redacted(headers: Column) -> Column:
    """A map of headers with sensitive ones' values taken out."""
    return F.transform_values(headers, lambda k, v: F.when(k.rlike("(?i)authorization|cookie|x-api-key|api-key"), F.lit("[REDACTED]")).otherwise(v))


def sampled(key: Column, rate: float) -> Column:
    """True for a fixed share of keys: the leading 32 bits of their SHA-256 as a fraction lie under the rate."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0) < F.lit(rate)


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def version_key(version: Column) -> Column:
    """Sortable key of a loose version: its numbers, however many (zeros at the end don't count), then releases after pre-releases, then the pre-release text."""
    core = F.regexp_replace(F.regexp_extract(version, "^[vV=]*([0-9]+(?:[.][0-9]+)*)", 1), "(?:[.]0+)+$", "")
    numbers = F.transform(F.split(core, "[.]"), lambda p: F.coalesce(p.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))
    pre = F.regexp_extract(version, "^[vV=]*[0-9]+(?:[.][0-9]+)*[.-]?([A-Za-z].*)$", 1)
    return F.struct(numbers.alias("numbers"), (pre == "").alias("release"), pre.alias("pre"))


def pip_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")
