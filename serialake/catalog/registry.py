"""A tiny registry: query name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


# Tables whose queries spend their time in expressions, with their row key.
_TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}
TASKS_A_CORE = 4


class Tables:
    """Lazy access to the tables of one data directory.

    A text table that arrives in fewer splits than there are cores (one small file) is spread by its
    key, so that expressions run in parallel; a table with enough splits is read as it is.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name in _TEXT_TABLES and table.rdd.getNumPartitions() < cores:
            return table.repartition(cores, _TEXT_TABLES[name])
        return table

    def spread(self, name: str, key: str) -> DataFrame:
        """A table of short rows that each cost much work: dealt by ``key`` to several tasks a core, however few splits its bytes make."""
        table = getattr(self, name)
        tasks = TASKS_A_CORE * self.spark.sparkContext.defaultParallelism
        return table if table.rdd.getNumPartitions() >= tasks else table.repartition(tasks, key)


class Catalog:
    def __init__(self) -> None:
        self.entries: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}

    def query(self, name: str, oracle: str | None = None):
        def register(build: Callable[[Tables], DataFrame]):
            if name in self.entries:
                raise ValueError(f"query {name} registered twice")
            self.entries[name] = (build, oracle)
            return build
        return register

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return {
            name: (lambda spark, sf_dir, build=build: build(Tables(spark, sf_dir)))
            for name, (build, _) in self.entries.items()
        }

    def oracles(self) -> dict[str, str]:
        return {name: sql for name, (_, sql) in self.entries.items() if sql is not None}
