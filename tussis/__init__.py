"""Tussis: acoustic health-screening analytics expressed as Spark jobs."""
