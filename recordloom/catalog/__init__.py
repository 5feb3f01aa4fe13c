"""The registered queries."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Catalog:
    queries: dict
    oracles: dict


def load() -> Catalog:
    from recordloom.catalog import chain_queries, field_queries, registry, source_queries  # noqa: F401

    return Catalog(registry.QUERIES, registry.ORACLES)
