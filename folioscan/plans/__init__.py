"""Queries over the driver's tables: each plan beside the SQL that gives the same rows."""
