"""Structured Streaming fronts."""
