"""Structured Streaming forms of the operators that meet data as it arrives."""
