"""Operators over views and feature tables."""
