"""Every query of the panel engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Register a function of the panel inputs under its name; `sql` gives DuckDB's rows, None if it can't."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(inputs(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return f

    return register


def inputs(spark, sf_dir: str):
    from tideline.plans.panel import Inputs
    from tideline.session import compilable

    return Inputs(compilable(spark), sf_dir)


def load() -> None:
    """Import the modules that register queries."""
    from tideline.plans import audit, contracts, panel  # noqa: F401
