"""Readers of landed documents and tables, and writers of tables and reports."""
