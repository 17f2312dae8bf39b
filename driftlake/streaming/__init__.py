"""Streaming of driftlake."""
