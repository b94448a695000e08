"""Readers and writers: bundles, parsed records, bronze tables, catalog."""
