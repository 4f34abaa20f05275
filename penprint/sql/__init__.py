"""Statements for an independent engine."""
