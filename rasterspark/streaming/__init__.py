"""Structured Streaming: ingest, metrics over traces, rendering of fresh granules."""
