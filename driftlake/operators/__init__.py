"""Operators of driftlake."""
