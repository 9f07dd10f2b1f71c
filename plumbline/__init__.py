"""Claim verification analytics on Spark."""
