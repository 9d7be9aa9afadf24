"""Binds the library to the driver's tables: fixtures, registered queries, oracle SQL."""
