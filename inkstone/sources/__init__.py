"""Part of the inkstone engine: sources."""
