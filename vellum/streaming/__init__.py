"""Structured Streaming: edits replayed as they come."""
