"""Scholarly-document data jobs as PySpark DataFrame transformations."""
