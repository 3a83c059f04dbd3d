"""Operators on long tables (keys, node, freq, trial, t_idx, value)."""
