"""Operators on edge DataFrames (src, dst[, weight])."""
