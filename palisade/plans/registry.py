"""Registration of queries: a DataFrame function, or SQL that Spark and the oracle both read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """text names tables as {table}; the oracle is the same text unless given."""
        used = [t for t in TABLES if "{" + t + "}" in text]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

        run.__name__ = name
        run.__doc__ = text
        self.queries[name] = run
        self.oracles[name] = oracle or re.sub(r"\{(\w+)\}", r"\1", text)

    def frame(self, oracle: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
