"""Functions of the change-ledger engine."""
