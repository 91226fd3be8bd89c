"""Catalog matching and analytics as Spark DataFrame operators."""
