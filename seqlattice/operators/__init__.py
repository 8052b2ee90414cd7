"""Operators of row-pattern queries as DataFrame plans."""
