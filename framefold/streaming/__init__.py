"""The folds as streaming queries."""
