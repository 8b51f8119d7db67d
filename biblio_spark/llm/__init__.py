"""Operators for preparing training data: search, scans, packing, de-duplication, archives and token files."""
