"""Inputs: trace event schemas, CSV readers, the test-table adapter and a
seeded synthetic process."""
