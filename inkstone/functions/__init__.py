"""Part of the inkstone engine: functions."""
