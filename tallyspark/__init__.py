"""Ledger analytics on Spark: ingest, reconcile, classify and report."""
