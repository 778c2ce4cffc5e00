"""Readers, writers and test-table adapters."""
