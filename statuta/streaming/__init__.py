"""Structured Streaming forms of the harvest and of event windows."""
