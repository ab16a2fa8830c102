"""Part of the inkstone engine: streaming."""
