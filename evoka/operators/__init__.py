"""Operators on DataFrames: segments, statistics, effects, evaluation, signals, models."""
