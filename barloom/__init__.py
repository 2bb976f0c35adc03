"""Barloom: market-data research on Spark DataFrames.

Ticks become bars, bars become features, features become rule-fired candidate
trades, and candidates are labelled, filtered, costed and tested.  Every
operator is a lazy ``DataFrame -> DataFrame`` function.
"""
