"""Functions that users add to the query language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register(name: str, make: Callable[..., Column]) -> None:
    """Make ``name(...)`` available; ``make`` gets and returns Columns."""
    FUNCTIONS[name.lower()] = make
