"""Streaming adapters for the stateless per-page operators."""
