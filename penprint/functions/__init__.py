"""Expressions and fixed lists."""
