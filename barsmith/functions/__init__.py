"""Expressions that all operators share."""
