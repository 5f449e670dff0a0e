"""Analytics over ordered game telemetry on Spark: votes, filters, sessions, statistics, evaluation and recordings."""
