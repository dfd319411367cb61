"""Linguistic feature engine and data preparation on Spark."""
