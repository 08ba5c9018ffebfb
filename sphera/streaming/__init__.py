"""Structured Streaming: the stateless columns and joins of this library on a stream of events."""
