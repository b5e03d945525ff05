"""Structured Streaming forms of the queue, ledger and event operators."""
