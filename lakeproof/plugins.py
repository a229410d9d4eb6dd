"""Extension points (E-01 to E-05): callables from (spark, context) to coverage results."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

Plugin = Callable[[SparkSession, Mapping], DataFrame]
log = logging.getLogger(__name__)


def run(spark: SparkSession, plugins: Mapping[str, Plugin], context: Mapping) -> DataFrame | None:
    """E-01: results of all plugins together; one that fails, or gives no table, is reported and left out. None without results."""
    found = []
    for name, plugin in plugins.items():
        try:
            out = plugin(spark, context)
            out.schema  # analysis errors show here
            found.append(out)
        except Exception as e:  # an extension must not end the run
            log.warning("plugin %s was left out: %s", name, e)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None


Stage = Callable[[Mapping[str, DataFrame]], Mapping[str, DataFrame]]


def run_stages(stages: list[tuple[str, Stage, bool]], tables: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """E-05: stages (name, function, optional) in turn, each adding tables; the error of an optional one is recorded, any other ends the run."""
    out, errors = dict(tables), {}
    for name, stage, optional in stages:
        try:
            out |= stage(out)
        except Exception as e:
            if not optional:
                raise
            errors[name] = str(e)
    return out, errors
