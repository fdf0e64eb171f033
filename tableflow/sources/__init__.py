"""Readers: JSON files and documents, JDBC tables, declared schemas."""
