"""Layered change-data pipelines on PySpark DataFrames.

Raw append-only logs -> current state -> reports, plus the upkeep, health, quality and access views around
them.  Everything takes and returns DataFrames; see README.md for the map of operators.
"""
