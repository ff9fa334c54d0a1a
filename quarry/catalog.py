"""Every registered query of the engine and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from quarry.plans.tables import with_tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under ``name``."""

    def add(f: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = with_tables(oracle)
        return f

    return add


from quarry.plans import composites, facts, graphs, joins, stores, structure, texts, usage, vectors  # noqa: E402, F401
