"""Bindings of the library to the driver tables: fixtures, queries and SQL oracles."""
