"""Batches: schedules, incremental views and Structured Streaming."""
