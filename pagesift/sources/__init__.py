"""Readers and writers (IO-01..IO-12)."""
