"""Sinks of the ledger engine."""
