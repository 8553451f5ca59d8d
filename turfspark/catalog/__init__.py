"""All registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turfspark.catalog import base

MODULES = ("history", "market", "ingest", "merging", "ranking", "training", "layers", "wagering", "checks")


class Catalog:
    def runnable(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(function: base.Query) -> Callable[[SparkSession, str], DataFrame]:
            return lambda spark, folder: function(base.Tables(spark, folder))

        return {name: bind(function) for name, function in base.QUERIES.items()}

    def oracle(self) -> dict[str, str]:
        return dict(base.ORACLE)


def load() -> Catalog:
    for module in MODULES:
        importlib.import_module(f"turfspark.catalog.{module}")
    return Catalog()
