"""All queries of the library (but those over corpora), by name."""

from marketloom.plans import catalog_features, catalog_market, catalog_models, catalog_tables  # noqa: F401  (they register their queries)
from marketloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
