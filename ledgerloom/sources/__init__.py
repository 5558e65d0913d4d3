"""Sources of the change-ledger engine."""
