"""The engine's queries by name: a function of the study tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conformance import duck, study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: How many queries may stand built and unread: the kept tables of an older one are released.
STANDING = 3
_held: list[list[DataFrame]] = [[]]


def keep(df: DataFrame) -> DataFrame:
    """A table that several parts of a query read, computed once; it is released when STANDING newer queries have been built."""
    if not _held:
        _held.append([])
    _held[-1].append(df.persist())
    return df


def release(standing: int = 0) -> None:
    """Release the kept tables of all queries but the last `standing` ones."""
    while len(_held) > standing:
        for df in _held.pop(0):
            if df.sparkSession.sparkContext._jsc is not None:  # its session may have ended
                df.unpersist()


def query(name: str, sql: str | None = None, *ctes: str, cut: int | None = None):
    """Register a function of the study tables (a dict of DataFrames) under a name, with its SQL over them (as known at a cut, if given)."""

    def register(f: Callable[[dict], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            release(STANDING - 1)
            _held.append([])
            return f(study(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duck(sql, *ctes, cut=cut)
        return f

    return register
