"""Tickets derived from order tables, and a deterministic labeller, for tests and benchmarks."""
