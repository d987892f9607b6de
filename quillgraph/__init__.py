"""Linked-data analytics on Spark: triples as DataFrames, entity extraction, identity, upserts and search."""

from __future__ import annotations

__all__ = ["BatchResult", "LinkedGraph", "Store", "save_graph"]


def __getattr__(name: str):
    """The main names, imported when asked for."""
    if name == "Store":
        from .plans.store import Store

        return Store
    if name in __all__:
        from .plans import save

        return getattr(save, name)
    raise AttributeError(name)
