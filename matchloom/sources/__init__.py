"""Readers, contract checks and sinks."""
