"""The registry of checkable jobs: a Spark query and, where SQL can say it, its check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from eventloom.plans import fixtures
from eventloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


@dataclass(frozen=True)
class Inputs:
    """The fixture views at one scale."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name == "limits":
            return fixtures.limits(self.spark)
        if name == "registry":
            return fixtures.registry(self.spark, self.sf_dir)
        if f"fx_{name}" in fixtures.VIEWS:
            return fixtures.view(self.spark, self.sf_dir, f"fx_{name}")
        raise AttributeError(name)

    def stream(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, f"fx_{name}", stream=True)


def job(name: str, *views: str, sql: str | None = None):
    """Register a job; ``sql`` may use the named views."""

    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Inputs(tune(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if views:
                clause = fixtures.ctes(*views)
                if text.startswith("WITH RECURSIVE "):
                    text = f"WITH RECURSIVE {clause[5:]},\n{text[15:]}"
                else:
                    text = f"{clause},\n{text[5:]}" if text.startswith("WITH ") else f"{clause}\n{text}"
            CHECKS[name] = text
        return build

    return register
