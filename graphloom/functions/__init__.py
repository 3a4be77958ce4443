"""Deterministic random numbers and graph generators."""
