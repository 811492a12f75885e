"""Registry of named queries: ``name -> (spark callable, oracle SQL or None)``.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole given
tables. Double outputs are rounded with the fixed rule of ``round_doubles`` on both
sides so that results compare bit for bit."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "q_bureau_two_level"


def register(name: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql() if callable(sql) else sql
        return fn
    return deco


def forget() -> None:
    """Drops everything that plans remember of data folders in this session (resolved tables, fitted
    categories, written tables, models), e.g. after a folder was rewritten or to time a cold run."""
    from riskweave.plans import features, models, roles
    from riskweave.sources import tables
    tables.forget()
    models.forget()
    features._SPECS.clear()
    features._WIDE_TABLES.clear()
    roles._ENTITY_TABLES.clear()


def load_all() -> None:
    """Import the query modules (each registers itself)."""
    from riskweave.plans import (  # noqa: F401
        q_features,
        q_rows,
        q_select,
        q_metrics,
        q_model,
        q_trees,
        q_serve,
    )
