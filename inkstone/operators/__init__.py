"""Part of the inkstone engine: operators."""
