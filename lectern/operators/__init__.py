"""Operators: functions from DataFrames to a DataFrame, with explicit position columns."""
