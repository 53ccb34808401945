"""Feeds, files and the binding of the test tables to the ledger model."""
