"""Bibliographic data jobs for Spark: reshape, de-duplicate, merge, validate, load and analyse publication records."""
