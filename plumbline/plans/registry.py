"""One registry of named plans: a Spark builder and, where SQL can say it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.tables import Tables


@dataclass(frozen=True)
class Plan:
    build: Callable[[Tables], DataFrame]
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None):
    def wrap(build: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"plan registered twice: {name}")
        PLANS[name] = Plan(build, sql)
        return build

    return wrap


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(p: Plan):
        return lambda spark, sf_dir: p.build(Tables(spark, sf_dir))

    return {name: bind(p) for name, p in PLANS.items()}


def oracle_queries() -> dict[str, str]:
    return {name: p.sql for name, p in PLANS.items() if p.sql is not None}
