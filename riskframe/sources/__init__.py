"""Scans and sinks (CSV, Parquet, fitted models, metric reports)."""
