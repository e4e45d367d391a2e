"""Operators over samples, blocks and frames; each takes and returns DataFrames."""
