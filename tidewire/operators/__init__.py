"""Operators over DataFrames: latest rows, change state, limits, rules, quality levels."""
