"""Multi-step datasets, and the catalog of queries over all operators."""
