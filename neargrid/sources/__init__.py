"""Schemas, tables and shared storage."""
