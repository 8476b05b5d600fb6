"""Readers, writers and tables on storage."""
