"""Readers and writers: CSV, Parquet, file hashes, result tables and reports."""
