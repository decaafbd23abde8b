"""Streaming extras: new files and events, beyond the batch operators."""
