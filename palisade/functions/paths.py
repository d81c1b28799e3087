"""Predicates on workspace paths: ignore patterns, files that hold secrets, test files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and extensions of files that hold secrets, in lower case.
SECRET_NAMES = [
    ".env", ".env.local", ".env.development", ".env.production", ".env.test", ".env.staging", ".env.dev", ".env.prod", "id_rsa", "id_rsa.pub", "id_dsa", "id_ecdsa", "id_ed25519",
    ".npmrc", ".pypirc", ".netrc", ".htpasswd", "credentials", "credentials.json", "serviceaccount.json", "gcloud-service-key.json", "azure.json",
]
SECRET_EXTENSIONS = [".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".ppk", ".ovpn", ".crt", ".cer", ".der"]


def ignore_patterns(text: str | None) -> list[str]:
    """The patterns of an ignore file: its lines without blank ones and comments, each once."""
    lines = (line.strip() for line in (text or "").split("\n"))
    return list(dict.fromkeys(line for line in lines if line and not line.startswith("#")))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path is one of the patterns, lies under a pattern that ends in a slash, or under one without a dot."""
    tests = [path == F.lit(p) for p in patterns]
    tests += [path.startswith(p) for p in patterns if p.endswith("/")]
    tests += [path.startswith(p + "/") for p in patterns if "." not in p]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "([^/\\\\]*)$", 1))


def secret_file(path: Column) -> Column:
    base = base_name(path)
    ext = F.regexp_extract(base, "^.+([.][^.]*)$", 1)
    return base.isin(SECRET_NAMES) | base.rlike("^[.]env[.][A-Za-z0-9_.-]+$") | ext.isin(SECRET_EXTENSIONS)
