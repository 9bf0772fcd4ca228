"""Structured Streaming: serve query batches arriving as files against a prebuilt index."""
