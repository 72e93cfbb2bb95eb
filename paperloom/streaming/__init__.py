"""Structured Streaming versions of ingestion, status changes, activity and validation."""
