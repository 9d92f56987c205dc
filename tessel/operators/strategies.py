"""Kinds of search by name, behind one interface."""

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame

from ..errors import InvalidRecord, UnsupportedMetric
from . import search


class Search(Protocol):
    def __call__(self, rows: DataFrame, query: Column, k: int, metric: str, key: str, vector: str) -> DataFrame:
        """The columns of rows with rank and distance, of the k nearest."""


def approximate(rows: DataFrame, query: Column, k: int, metric: str, key: str, vector: str) -> DataFrame:
    """By random projections, for l2 alone. Only the nearest rows that it names are read whole."""
    if metric != "l2":
        raise UnsupportedMetric(f"{metric}: the approximate search compares by l2")
    point = rows.sparkSession.range(1).select(query.alias("q")).first().q
    near = search.approximate(rows, point, k, key, vector)
    # The distances of at most k rows are measured anew, so that both kinds give the same figures.
    return search.knn(search.hydrate(near.select(key), rows, key), query, k, metric, key, vector)


#: Kind of search by name; register() adds to it.
STRATEGIES: dict[str, Search] = {"exact": search.knn, "approximate": approximate}


def register(name: str) -> Callable[[Search], Search]:
    def add(f: Search) -> Search:
        STRATEGIES[name] = f
        return f

    return add


def strategy(name: str) -> Search:
    if name not in STRATEGIES:
        raise InvalidRecord(f"unknown kind of search {name}: one of {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name]
