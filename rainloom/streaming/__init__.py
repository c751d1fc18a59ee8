"""Structured Streaming runs that end when the waiting files are read."""
