"""Part of the inkstone engine: plans."""
