"""Operators of the change-ledger engine."""
