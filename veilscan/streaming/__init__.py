"""Chunked sources as a stream, and edited documents."""
