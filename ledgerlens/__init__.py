"""Ledgerlens: DataFrame operators and streaming jobs for ledgers of events."""
