"""Registered queries: operators bound to the test tables, their SQL oracles, plan checks."""
