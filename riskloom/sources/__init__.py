"""Readers and writers for logs, tables, settings and models."""
