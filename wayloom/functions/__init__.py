"""Part of the wayloom engine."""
