"""Catalogue and search of named, documented records in Spark."""
