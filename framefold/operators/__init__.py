"""Operators over ordered telemetry: windows, aggregates, joins and folds."""
