"""Where queries register themselves, each with DuckDB SQL for the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketloom.sources.tables import rounded
from marketloom.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """The views over one folder's tables, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a function of ``Views`` under a name; columns in ``doubles`` are rounded on both sides."""

    def register(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(Views(spark, sf_dir)), doubles, digits)

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            rounds = ", ".join(f"round({c}::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c in doubles.split())
            ORACLES[name] = with_views(f"SELECT * REPLACE ({rounds}) FROM ({sql}) q" if rounds else sql)
        return f

    return register
