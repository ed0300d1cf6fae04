"""Scans and sinks: Parquet star tables, ragged CSV, registry tables, result sinks."""
