"""Structured Streaming: keyed game state, de-duplication, sessions."""
