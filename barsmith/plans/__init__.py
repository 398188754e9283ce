"""Staged plans, the factor expression compiler and factor evaluation."""
