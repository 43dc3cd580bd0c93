"""Routing-registry analytics on Spark."""
