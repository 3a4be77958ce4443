"""Run configuration, checkpoints and the catalogue of queries."""
