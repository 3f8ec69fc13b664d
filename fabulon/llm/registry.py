"""Queries of the training-data operators, by name; SQL twins where SQL can express the result.

All modules are imported with this one, so a missing package shows as an ImportError here and not inside a query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, defects, encoding, mixing, packing, repetition, sentences, splitting, truncation, visual
from .sql import ORACLES

_MODULES = (alignment, defects, visual, splitting, repetition, packing, mixing, encoding, truncation, sentences)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        out |= {k: v for k, v in vars(module).items() if k[0] == "p" and k[1].isdigit() and callable(v)}
    return out


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
