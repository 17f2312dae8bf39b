"""Plans of driftlake."""
