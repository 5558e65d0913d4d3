"""Change ledger, reconciliation and telemetry analytics on Spark."""
