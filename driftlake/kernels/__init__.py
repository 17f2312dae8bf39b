"""Kernels of driftlake."""
