"""Operators over the long panel."""
