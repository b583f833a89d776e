"""Numeric kernels that run inside a task; no Spark here."""
