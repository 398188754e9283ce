"""Bars as a stream."""
