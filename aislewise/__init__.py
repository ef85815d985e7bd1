"""Retail space and assortment analytics as plain Spark DataFrame jobs."""
