"""Readers and writers: source trees, inventories and the report tables."""
