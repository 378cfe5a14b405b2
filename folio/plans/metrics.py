"""Counts of what passes through a stage, taken by the action that writes it."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation


class Metrics:
    """Named observations of plans; their values are there once an action has read the plans to the end."""

    def __init__(self) -> None:
        self._seen: dict[str, tuple[Observation, list[str]]] = {}

    def watch(self, name: str, rows: DataFrame, /, **counted: Column) -> DataFrame:
        """rows, whose aggregates counted are observed under name when an action reads them."""
        seen = Observation(name)
        self._seen[name] = seen, list(counted)
        return rows.observe(seen, *(value.alias(key) for key, value in counted.items()))

    def values(self) -> dict[str, dict]:
        """{name: {aggregate: value}}; waits for the actions that read what is watched."""
        return {name: _told(seen, keys) for name, (seen, keys) in self._seen.items()}


def _told(seen: Observation, keys: list[str]) -> dict:
    try:
        return dict(seen.get) or dict.fromkeys(keys, 0)
    except Py4JJavaError:  # Spark knew that there are no rows, left the plan out, and gives a row without names
        return dict.fromkeys(keys, 0)
