"""Spark jobs for market-event, energy, match, order-book and pricing tables.

Every public function takes DataFrames and returns a DataFrame; nothing is
executed until the caller runs an action, except where a docstring says that a
small aggregate is read back (a fitted statistic, a list of categories).
"""
