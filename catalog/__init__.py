"""Queries over the given tables with the SQL that checks them."""


def all_queries():
    """Import every query module and return (queries, check SQL)."""
    from . import geometry, model, registry, screening, tables  # noqa: F401

    return registry.QUERIES, registry.ORACLES
