"""Resumable file ingestion and scoring with Structured Streaming."""
