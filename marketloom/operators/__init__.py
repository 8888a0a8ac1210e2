"""Operators over whole tables: windows, aggregates, joins, scaling, ranking, books, pricing, evaluation, models."""
