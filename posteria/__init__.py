"""Probabilistic catalog inference as Spark DataFrame operators."""
