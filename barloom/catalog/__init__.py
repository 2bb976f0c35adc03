"""Registered queries, one module per part of the inventory."""
from barloom.catalog import features, market, signals, trades, tests_and_scores, portfolio, pairs, streams, models  # noqa: F401
from barloom.catalog.registry import ENTRIES  # noqa: F401
