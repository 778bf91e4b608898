"""Spectral identification and corpus preparation on Spark."""
