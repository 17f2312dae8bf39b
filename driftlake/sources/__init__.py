"""Sources of driftlake."""
