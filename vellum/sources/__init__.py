"""Readers of layout data, and layout views of the text tables."""
