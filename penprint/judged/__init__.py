"""Annotations by a model, behind a provider."""
