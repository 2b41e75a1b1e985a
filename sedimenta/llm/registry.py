"""Queries of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

NAMES = ("pii", "markup", "handwritten", "neighbours", "pieces", "tokens", "leaks", "lookalikes")


def _modules() -> list:
    return [import_module(f"sedimenta.llm.{n}") for n in NAMES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.ORACLES.items()}
