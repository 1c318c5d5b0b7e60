"""Readers and writers: CSV, JSON, NDJSON, Parquet, XLSX, databases, and frames in memory."""
