"""Incremental ingestion and the incremental detector."""
