"""The ledger operators: extract, dedupe, reconcile, classify, report."""
