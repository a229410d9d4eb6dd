"""Ordered enumerations: confidence levels, coverage classes (P-11 to P-13, A-16, P-15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The orders of the enumerations and the class of each test layer.
CONFIDENCE = ("low", "medium", "high", "verified")
CLASSES = ("uncovered", "mock-covered", "unit-covered", "component-covered", "integration-covered", "api-covered", "e2e-covered")
LAYER_CLASS = {
    "unit": "unit-covered",
    "component": "component-covered",
    "integration": "integration-covered",
    "api": "api-covered",
    "e2e": "e2e-covered",
    "performance": "api-covered",
    "security": "api-covered",
}


def rank(value: Column, order: Sequence[str]) -> Column:
    """Position of a value in its order, from 0; -1 for an unknown one."""
    return (F.array_position(F.array(*[F.lit(x) for x in order]), value) - 1).cast("int")


def name(rank_: Column, order: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in order]), rank_)


def cap(level: Column, most: str) -> Column:
    """P-11: the lower of a level and a cap."""
    return name(F.least(rank(level, CONFIDENCE), F.lit(CONFIDENCE.index(most))), CONFIDENCE)


def base_confidence(ast: Column, tia: Column, iast: Column, dast: Column, asserted: Column) -> Column:
    """P-12: level from the stages that have seen an item."""
    static = ast & tia
    return F.when(static & iast & dast & asserted, "verified").when(static & (iast | dast), "high").when(static, "medium").otherwise("low")


def confidence(ast: Column, tia: Column, iast: Column, dast: Column, asserted: Column, *caps: Column) -> Column:
    """P-12: the base level, medium at most if any cap (mock, partial, symbolic, static-only) holds."""
    base = base_confidence(ast, tia, iast, dast, asserted)
    limited = F.lit(False)
    for c in caps:
        limited = limited | c
    return F.when(limited, cap(base, "medium")).otherwise(base)


def coverage_class(layer: Column, mocked: Column) -> Column:
    """P-13: a mock on the way wins over the layer."""
    table = F.create_map(*[F.lit(x) for kv in LAYER_CLASS.items() for x in kv])
    return F.when(mocked, "mock-covered").otherwise(F.coalesce(F.try_element_at(table, layer), F.lit("uncovered")))


def least_level(level: Column, order: Sequence[str] = CONFIDENCE) -> Column:
    """A-16: aggregate, lowest level of a group."""
    return name(F.min(rank(level, order)), order)


def highest_level(level: Column, order: Sequence[str] = CONFIDENCE) -> Column:
    """A-16: aggregate, highest level of a group."""
    return name(F.max(rank(level, order)), order)
