"""Incremental variants of the batch stages."""
