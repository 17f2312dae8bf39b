"""Functions of driftlake."""
