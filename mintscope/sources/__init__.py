"""Readers, sinks and the run catalogue."""
