"""Fixture views over the driver's tables, the query catalogue, and SQL to hold the queries against."""
