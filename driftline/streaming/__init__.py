"""Structured Streaming over per-generation rows."""
