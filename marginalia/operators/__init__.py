"""Operators over DataFrames: joins, windows, folds, ranking, audits."""
